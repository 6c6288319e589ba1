"""Submissions: a solver's source with what is said of it, as a few documents.

A submission is a mapping of file names to bytes.  ``documents`` makes one of an
offer, ``faults`` says what is wrong with one, wherever it comes from; writing and
checking are these two with a folder at one end.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from pathlib import Path

from residua.operators.cases import SUBMISSION_NAME

# The files of a submission, the fields of its description, and their version.
SOURCE, DETAILS, README, VERSION = "solver.py", "submission.json", "README.md", 2
#: What a plug-in offers: a function ``make(tolerance)`` that gives a solver.
INTERFACE = "residua-solver-1"
FAMILIES = ("mesh", "replay")
MOST_BYTES = 65_536


@dataclass(frozen=True)
class Offer:
    """What its author says of a solver, and its source."""

    name: str
    submitter: str
    families: tuple[str, ...]
    source: bytes


@dataclass(frozen=True)
class Field:
    """What a description states of an offer, and whether a stated value will do for a source."""

    of: Callable[[Offer], object]
    fits: Callable[[object, bytes], bool]


def _always(value: object) -> Field:
    return Field(lambda offer: value, lambda stated, source: stated == value)


def _digest(source: bytes) -> str:
    return hashlib.sha256(source).hexdigest()


def _text(rule: Callable[[str], object]) -> Callable[[object, bytes], bool]:
    return lambda stated, source: isinstance(stated, str) and bool(rule(stated))


def _known(stated: object, source: bytes) -> bool:
    return isinstance(stated, list) and 0 < len(stated) == sum(stated.count(f) == 1 for f in FAMILIES)


FIELDS: dict[str, Field] = {
    "schema_version": _always(VERSION),
    "candidate_abi": _always(INTERFACE),
    "source": _always(SOURCE),
    "source_sha256": Field(lambda offer: _digest(offer.source), lambda stated, source: stated == _digest(source)),
    "name": Field(lambda offer: offer.name, _text(re.compile(SUBMISSION_NAME).fullmatch)),
    "submitter": Field(lambda offer: offer.submitter.strip(), _text(str.strip)),
    "families": Field(lambda offer: [f for f in (*FAMILIES, *sorted(set(offer.families) - set(FAMILIES))) if f in offer.families], _known),
}


def source_faults(source: bytes, most: int = MOST_BYTES) -> list[str]:
    """Why a source may not be run."""
    out = []
    if len(source) > most:
        out.append(f"{SOURCE} is over {most} bytes")
    if b"\r" in source or b"\0" in source:
        out.append(f"{SOURCE} holds NUL or line ends other than LF")
    try:
        defined = compile(source.decode(), SOURCE, "exec", dont_inherit=True).co_names
        if "make" not in defined:
            out.append(f"{SOURCE} has no make()")
    except (SyntaxError, ValueError) as error:
        out.append(f"{SOURCE} is no Python: {error}")
    return out


def documents(offer: Offer) -> dict[str, bytes]:
    """The files of an offer's submission."""
    stated = {name: field.of(offer) for name, field in FIELDS.items()}
    about = f"# {offer.name}\n\nWhat the solver does and how it came about.\n"
    return {SOURCE: offer.source, DETAILS: (json.dumps(stated, indent=2, sort_keys=True) + "\n").encode(), README: about.encode()}


def description(found: Mapping[str, bytes]) -> object:
    """What a submission's description states; None if it is no JSON."""
    try:
        return json.loads(found[DETAILS])
    except (KeyError, ValueError):
        return None


def faults(found: Mapping[str, bytes]) -> list[str]:
    """What keeps some files from being a submission; all of it, not the first."""
    out = [f"{name} is missing" for name in (SOURCE, DETAILS, README) if name not in found]
    out += [f"{name} does not belong there" for name in sorted({*found} - {SOURCE, DETAILS, README})]
    stated, source = description(found), found.get(SOURCE, b"")
    if not isinstance(stated, dict):
        return [*out, f"{DETAILS} is no JSON object"]
    out += [f"{DETAILS}: {name} is unknown" for name in sorted({*stated} - {*FIELDS})]
    out += [f"{DETAILS}: {name} does not hold" for name, field in FIELDS.items() if name not in stated or not field.fits(stated[name], source)]
    if SOURCE in found:
        out += source_faults(source)
    if not found.get(README, b"-").strip():
        out.append(f"{README} is empty")
    return out


def _sound(found: Mapping[str, bytes]) -> dict:
    if wrong := faults(found):
        raise ValueError("not a submission: " + "; ".join(wrong))
    return description(found)


def package(source: str | Path, folder: str | Path, name: str, families: Iterable[str], submitter: str) -> dict:
    """Write a solver's submission into a folder that is not there yet; its description."""
    made = documents(Offer(name, submitter, tuple(families), Path(source).read_bytes()))
    stated = _sound(made)
    Path(folder).mkdir(parents=True)
    for file, content in made.items():
        (Path(folder) / file).write_bytes(content)
    return stated


def check(folder: str | Path) -> dict:
    """The description of a submission in a folder, if everything holds."""
    if not Path(folder).is_dir():
        raise ValueError(f"no folder: {folder}")
    return _sound({p.name: p.read_bytes() if p.is_file() else b"" for p in Path(folder).iterdir()})
