"""Progress of a run: phases with their seconds, and steps inside the phase that runs. A callback may write it where it is watched."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

#: The phases that plans.pipeline.run enters, in order; growth and repair are steps of each iteration of the relaxation.
PHASES = ("normalize", "ingest", "triage", "bridges", "dual_graph", "seed", "relax", "extract")
#: Least seconds between two reports.
EVERY = 0.25


class Progress:
    def __init__(self, report: Callable[[dict], None] | None = None, clock: Callable[[], float] = time.monotonic):
        self.report, self.clock, self.timings, self.now, self.step, self.last = report, clock, {}, None, None, None

    def snapshot(self) -> dict:
        done = len(self.timings)
        step = dict(zip(("current", "total", "label"), self.step, strict=True)) if self.step else None
        return {"phase": self.now, "done": done, "phases": len(PHASES), "substep": step, "timings": dict(self.timings)}

    def _tell(self, force: bool) -> None:
        if self.report and (force or self.last is None or self.clock() - self.last >= EVERY):
            self.last = self.clock()
            self.report(self.snapshot())

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        self.now, self.step, began = name, None, self.clock()
        self._tell(True)
        try:
            yield
        finally:
            self.timings[name] = self.clock() - began
            self.now = self.step = None
            self._tell(True)

    def substep(self, current: int, total: int, label: str = "") -> None:
        self.step = (current, total, label)
        self._tell(current >= total)


def to_file(spark, path: str) -> Callable[[dict], None]:
    """A report that replaces one JSON file."""
    from ..sources.sinks import write_bytes

    return lambda state: write_bytes(spark, path, json.dumps(state).encode())
