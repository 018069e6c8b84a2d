"""Timings of actions, benchmark suites, plans as data, and a scope that lets go of cached frames."""

from __future__ import annotations

import json
import statistics
import time
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass
class Metrics:
    """Seconds by operation, in the order taken."""

    seconds: list[tuple[str, float]] = field(default_factory=list)

    @contextmanager
    def timed(self, operation: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds.append((operation, time.perf_counter() - began))

    def totals(self) -> dict[str, float]:
        out: dict[str, float] = {}
        for name, s in self.seconds:
            out[name] = out.get(name, 0.0) + s
        return out

    def report(self) -> str:
        lines = ["| operation | seconds |", "|---|---|"]
        return "\n".join([*lines, *(f"| {n} | {s:.3f} |" for n, s in sorted(self.totals().items()))])


@dataclass
class Suite:
    """Named pieces of work that are timed in turn; each runs once more before, so that code is compiled."""

    work: dict[str, Callable[[], object]] = field(default_factory=dict)
    results: dict[str, list[float]] = field(default_factory=dict)

    def add(self, name: str, run: Callable[[], object]) -> None:
        self.work[name] = run

    def run(self, times: int = 3, warm: bool = True) -> dict[str, list[float]]:
        for name, work in self.work.items():
            if warm:
                work()
            taken = Metrics()
            for _ in range(times):
                with taken.timed(name):
                    work()
            self.results[name] = [s for _, s in taken.seconds]
        return self.results

    def report(self) -> str:
        lines = ["| benchmark | runs | least | mean | most |", "|---|---|---|---|---|"]
        return "\n".join([*lines, *(f"| {n} | {len(s)} | {min(s):.4f} | {statistics.mean(s):.4f} | {max(s):.4f} |" for n, s in self.results.items())])

    def to_json(self) -> str:
        return json.dumps(self.results)


def plan_of(df: DataFrame, physical: bool = False) -> list[dict]:
    """The nodes of a frame's optimised or physical plan, parents before children: class, number of children, and arguments."""
    execution = df._jdf.queryExecution()
    return json.loads((execution.executedPlan() if physical else execution.optimizedPlan()).toJSON())


@contextmanager
def cached(*frames: DataFrame):
    """Frames kept in memory and on disk for the length of a block."""
    held = [f.persist() for f in frames]
    try:
        yield held[0] if len(held) == 1 else tuple(held)
    finally:
        for f in held:
            f.unpersist()
