"""Evasion detectors as pairs: what a category looks like in a file, and what a run shows that confirms it.

A pair is planned into the two passes there are anyway: its ``static`` signals are one more array in the row of a file, its ``marks`` one
more partial aggregate per run and kind of event.  A list of pairs is all that the operators take; add to :data:`PAIRS` for your own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkwarden import values as V
from sparkwarden.operators import evasion as EV


@dataclass(frozen=True)
class Detector:
    """A category of evasion.

    ``static`` gives the signals of a staged file at an instant (as the functions of :mod:`evasion` do); ``marks`` are named tests of one
    event, true of a run if true of any of its events; ``observed`` says from marks, and ``drift``, whether a run shows the category.
    """

    category: str
    static: Callable[[int], Column] | None = None
    marks: dict[str, Callable[[], Column]] = field(default_factory=dict)
    observed: Callable[[], Column] | None = None


def _target() -> Column:
    return F.coalesce("target", F.lit(""))


def _kind(kind: str) -> Column:
    return F.col("kind") == kind


CONNECTS = {"connects": lambda: _kind("connect")}

PAIRS: list[Detector] = [
    Detector("env_mutation", EV.env_mutation),
    Detector(
        "time_bomb", EV.time_bomb,
        {"long_sleep": lambda: _kind("sleep") & F.coalesce(_target().try_cast("bigint") > V.LONG_SLEEP_SECONDS, F.lit(False))}, lambda: F.col("long_sleep"),
    ),
    Detector(
        "build_hooks", EV.build_hooks,
        {"hook_exec": lambda: _kind("exec") & F.lower(_target()).contains("postinstall"), **CONNECTS}, lambda: F.col("hook_exec") & F.col("connects"),
    ),
    Detector(
        "derived_exfil", EV.derived_exfil,
        {"tmp_write": lambda: _kind("write") & _target().startswith("/tmp"), **CONNECTS}, lambda: F.col("tmp_write") & F.col("connects"),
    ),
    Detector("direct_xpc", EV.direct_xpc, {"dbus": lambda: _kind("connect") & F.lower(_target()).contains("dbus")}, lambda: F.col("dbus")),
    Detector("anti_debug", EV.anti_debug, {"ptrace": lambda: _kind("exec") & F.lower(_target()).contains("ptrace")}, lambda: F.col("ptrace")),
    Detector("parser_partial_drift", observed=lambda: F.col("drift")),
]


def statics(detectors: list[Detector]) -> list[Callable[[int], Column]]:
    """The file half, as :func:`evasion.evasion_static` takes it."""
    return [d.static for d in detectors if d.static is not None]


def mark_names(detectors: list[Detector]) -> list[str]:
    """Names of all marks, each once; the same name must mean the same test."""
    return list(dict.fromkeys(name for d in detectors for name in d.marks))


def mark_tests(detectors: list[Detector]) -> list[Column]:
    """Partial aggregates over events: whether any event has a mark."""
    tests = {name: test for d in detectors for name, test in d.marks.items()}
    return [F.coalesce(F.bool_or(test()), F.lit(False)).alias(name) for name, test in tests.items()]


def mark_sums(detectors: list[Detector]) -> list[Column]:
    return [F.bool_or(name).alias(name) for name in mark_names(detectors)]


def observed(detectors: list[Detector]) -> Column:
    """Categories that a run's marks (and ``drift``) show; co-occurrence is enough, order is not considered."""
    tests = [F.when(F.coalesce(d.observed(), F.lit(False)), d.category) for d in detectors if d.observed is not None]
    return F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")
