"""``python -m residua``."""

from residua.cli import main

raise SystemExit(main())
