"""Commands of ``python -m residua``, as a table.

A command has options and a function that gets their values and tells its lines;
what an error or the outcome means for the exit code stands in one place.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from pathlib import Path

from residua.operators.solve import SOLVERS
from residua.sources import loading, submission

# The exit codes.
FINE, CASE_FAILED, WRONG, CANCELLED = 0, 1, 2, 130
#: Errors that are told in a line rather than by a trace.
TOLD: tuple[tuple[type[BaseException], int], ...] = ((KeyboardInterrupt, CANCELLED), (OSError, WRONG), (RuntimeError, WRONG), (ValueError, WRONG))


@dataclass(frozen=True)
class Command:
    """``work`` gets the options by name, yields lines, and returns the exit code."""

    about: str
    operand: str
    work: Callable[..., Iterator[str]]
    options: dict[str, dict] = field(default_factory=dict)


def _needed(**more: object) -> dict:
    return {"required": True, **more}


def lines_of(report: dict) -> Iterator[str]:
    """A report in words: the score, then what failed, then each case with its speed."""
    cases = report["cases"]
    if report["family"] == loading.REPLAY:
        value = report["value"]
        yield "no score: a case is missing or failed" if value is None else f"{value:.3f} times as fast as the reference"
    else:
        whole = "" if report["complete"] else f", a part of {report['total_cases']}"
        yield f"{report['solved_cases']} solved of {report['evaluated_cases']} cases{whole}"
    yield from (f"failed {c['case_id']}: {(c.get('candidate') or {}).get('failure') or 'no reason given'}" for c in cases if not c["passed"])
    yield from (f"passed {c['case_id']}" + (f" at {c['speedup']:.3f}" if c.get("speedup") is not None else "") for c in cases if c["passed"])


def _evaluate(operand: str, manifest: str, pinned: str | None, case: list[str] | None, cache: str, bundles: str | None, capture_kind: str, output: str) -> Iterator[str]:
    from pyspark.sql import SparkSession

    from residua.evaluate import evaluate

    stated = loading.read_authentic(manifest, pinned)
    report = evaluate(SparkSession.builder.getOrCreate(), operand, stated, cache, case, capture_kind=capture_kind, bundle_cache=bundles, progress=lambda text: print(text, file=sys.stderr))
    target = Path(output)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(json.dumps(report, indent=2, sort_keys=True, allow_nan=False) + "\n", encoding="utf-8")
    yield from lines_of(report)
    yield f"written to {target}"
    return CASE_FAILED if report["family"] == loading.REPLAY and not report["all_passed"] else FINE


def _submit(operand: str, name: str, family: list[str], submitter: str, output: str) -> Iterator[str]:
    stated = submission.package(operand, output, name, family, submitter)
    yield f"{stated['name']} for {', '.join(stated['families'])} is in {output}"
    return FINE


def _check(operand: str) -> Iterator[str]:
    yield json.dumps(submission.check(operand), indent=2, sort_keys=True)
    return FINE


COMMANDS = {
    "run": Command("evaluate a solver on the cases of a manifest", f"a Python file with make(tolerance), or one of {', '.join(SOLVERS)}", _evaluate, {
        "manifest": _needed(), "pinned": {"help": "the digest that the manifest must have"}, "case": {"action": "append", "help": "only this case; may be repeated"},
        "cache": {"default": str(Path.home() / ".cache" / "residua")}, "bundles": {"help": "a folder that all executors share, for packed inputs"},
        "capture-kind": {"default": ""}, "output": {"default": "result.json"},
    }),
    "submit": Command("write a submission", "a Python file with make(tolerance)", _submit, {"name": _needed(), "family": _needed(action="append", choices=submission.FAMILIES), "submitter": _needed(), "output": _needed()}),
    "check": Command("check a submission", "its folder", _check),
}


def parsed(argv: Sequence[str] | None) -> tuple[Command, dict]:
    """The command of a command line, and its options by name."""
    top = argparse.ArgumentParser(prog="residua")
    chosen = top.add_subparsers(dest="chosen", required=True)
    for name, command in COMMANDS.items():
        own = chosen.add_parser(name, help=command.about)
        own.add_argument("operand", help=command.operand)
        for option, how in command.options.items():
            own.add_argument(f"--{option}", **how)
    options = vars(top.parse_args(argv))
    return COMMANDS[options.pop("chosen")], options


def told(lines: Iterator[str]) -> int:
    """Print lines as they come; the code that their source returns."""
    while True:
        try:
            print(next(lines))
        except StopIteration as end:
            return end.value


def main(argv: Sequence[str] | None = None) -> int:
    command, options = parsed(argv)
    try:
        return told(command.work(**options))
    except tuple(kind for kind, _ in TOLD) as error:
        print(f"residua: {str(error) or type(error).__name__}", file=sys.stderr)
        return next(code for kind, code in TOLD if isinstance(error, kind))
