"""The stages of the corpus run in order over the ledger, and limits on calls to outside services."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from corpusloom.operators.operations import STAGES

DONE = ("succeeded", "skipped")


@dataclass
class Outcome:
    stage: str
    status: str
    elapsed_ms: int = 0
    error: str | None = None


@dataclass
class Pipeline:
    """Runs stage functions one after another; each takes and returns a DataFrame of all pending sources.

    A stage that has succeeded is skipped unless forced. A failure ends the run, or leaves the rest to run
    with ``continue_on_error``. A stage that answers "waiting" stops the run without failing it.
    """

    stages: dict[str, Callable[[DataFrame], DataFrame | str]]
    ledger: dict[str, str] = field(default_factory=dict)

    def plan(self, start: str | None = None, stop: str | None = None) -> list[str]:
        names = [s for s in STAGES if s in self.stages]
        for name in (start, stop):
            if name is not None and name not in names:
                raise ValueError(f"unknown stage: {name}")
        first = names.index(start) if start else 0
        last = names.index(stop) if stop else len(names) - 1
        return names[first : last + 1]

    def run(self, df: DataFrame, *, start: str | None = None, stop: str | None = None, force: bool = False, continue_on_error: bool = False) -> list[Outcome]:
        out: list[Outcome] = []
        for name in self.plan(start, stop):
            if not force and self.ledger.get(name) == "succeeded":
                out.append(Outcome(name, "skipped"))
                continue
            began = time.monotonic()
            try:
                made = self.stages[name](df)
                status, error = ("waiting", None) if isinstance(made, str) else ("succeeded", None)
                df = df if isinstance(made, str) else made
            except Exception as e:
                status, error = "failed", str(e)
            self.ledger[name] = status
            out.append(Outcome(name, status, int((time.monotonic() - began) * 1000), error))
            if status == "waiting" or status == "failed" and not continue_on_error:
                break
        return out


def succeeded(outcomes: list[Outcome]) -> bool:
    return bool(outcomes) and all(o.status in DONE for o in outcomes)


class RateLimiter:
    """At most ``quota`` calls in any 60 seconds and a least pause between calls; one for each partition, so
    the quota of a service is divided by their number."""

    def __init__(self, quota: int, pause: float = 0.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.quota, self.pause, self.clock, self.sleep = quota, pause, clock, sleep
        self.calls: deque[float] = deque()

    def wait(self) -> None:
        now = self.clock()
        while self.calls and now - self.calls[0] >= 60:
            self.calls.popleft()
        need = self.pause - (now - self.calls[-1]) if self.calls else 0.0
        if len(self.calls) >= self.quota:
            need = max(need, 60 - (now - self.calls[0]))
        if need > 0:
            self.sleep(need)
        self.calls.append(self.clock())
