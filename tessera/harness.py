"""Trials of a kernel: run, time, analyse the last one, verify, average."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tessera.plans.graph import Graph

log = logging.getLogger("tessera")


class Timer:
    """Seconds between ``start`` and ``stop``."""

    def __init__(self):
        self._start = self._end = 0.0

    def start(self) -> None:
        self._start = self._end = time.perf_counter()

    def stop(self) -> None:
        self._end = time.perf_counter()

    def seconds(self) -> float:
        return self._end - self._start

    def milliseconds(self) -> float:
        return self.seconds() * 1e3

    def microseconds(self) -> float:
        return self.seconds() * 1e6


def print_label(label: str, value: str) -> None:
    print(f"{label + ':':<21}{value:>7}")


def print_time(label: str, seconds: float) -> None:
    print(f"{label + ':':<21}{seconds:3.5f}")


def print_step(step: object, seconds: float, count: int | None = None) -> None:
    print(f"{step!s:>5}{'' if count is None else f'{count:11}'}  {seconds:10.5f}")


@dataclass
class Report:
    seconds: list[float] = field(default_factory=list)
    verified: list[bool] = field(default_factory=list)

    @property
    def average(self) -> float:
        return sum(self.seconds) / len(self.seconds) if self.seconds else 0.0


def timed(label: str, make: Callable):
    t = Timer()
    t.start()
    out = make()
    t.stop()
    print_time(label, t.seconds())
    return out


def run_trials(graph: Graph, kernel: Callable[[int], DataFrame], *, trials: int = 16, analysis: Callable[[DataFrame], DataFrame] | None = None, verifier: Callable[[DataFrame, int], DataFrame] | None = None, sink: Callable[[DataFrame, int], None] | None = None) -> Report:
    """Times ``kernel(trial)`` and a full evaluation of its result. A verifier's row must be all zeros."""
    print(graph.describe())
    report = Report()
    for trial in range(trials):
        t = Timer()
        t.start()
        result = kernel(trial)
        result.write.format("noop").mode("overwrite").save()
        t.stop()
        report.seconds.append(t.seconds())
        print_time("Trial Time", t.seconds())
        if analysis is not None and trial == trials - 1:
            analysis(result).show(truncate=False)
        if verifier is not None:
            row = verifier(result, trial).first()
            good = not any(row)
            report.verified.append(good)
            print_label("Verification", "PASS" if good else f"FAIL {row.asDict()}")
        if sink is not None:
            sink(result, trial)
    print_time("Average Time", report.average)
    return report
