"""The stages of a run as a small state machine: fork, join, and caches keyed by what made them."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

STATES = ("waiting", "running", "done", "pending", "blocked", "error")


@dataclass
class Stage:
    """make computes the stage's table from those of the stages it needs. cached gives a kept result or None."""

    name: str
    make: Callable[[dict[str, DataFrame]], DataFrame]
    needs: tuple[str, ...] = ()
    cached: Callable[[], DataFrame | None] = lambda: None
    blocked: Callable[[], str | None] = lambda: None


@dataclass
class Event:
    stage: str
    state: str
    note: str = ""
    seconds: float = 0.0


@dataclass
class Run:
    """Runs stages as soon as what they need is there, side by side. A stage that fails stops only those that need it.
    cache_only computes nothing: a stage without a kept result stays pending. Events come as they happen; while stages run,
    `tick` is asked every `every` seconds for figures to report."""

    stages: list[Stage]
    cache_only: bool = False
    force: frozenset[str] = frozenset()
    tick: Callable[[], str] | None = None
    every: float = 1.0
    results: dict[str, DataFrame] = field(default_factory=dict)

    def events(self) -> Iterator[Event]:
        left = {s.name: s for s in self.stages}
        failed: set[str] = set()
        jobs: dict[Future, tuple[str, float]] = {}
        yield from (Event(s, "waiting") for s in left)
        with ThreadPoolExecutor(max(1, len(self.stages))) as pool:
            while left or jobs:
                ready = [s for s in left.values() if all(n in self.results or n in failed for n in s.needs)]
                if not ready and not jobs:
                    raise ValueError(f"stages need what no stage makes: {sorted(left)}")
                for s in ready:
                    del left[s.name]
                    state, note = self._without_work(s, failed)
                    if state is None:
                        yield Event(s.name, "running")
                        jobs[pool.submit(s.make, dict(self.results))] = s.name, time.monotonic()
                    else:
                        yield Event(s.name, state, note)
                if ready or not jobs:
                    continue  # what is settled now may let others start
                over, _ = wait(jobs, self.every if self.tick else None, FIRST_COMPLETED)
                if not over:
                    yield Event("", "running", self.tick())
                for job in over:
                    name, began = jobs.pop(job)
                    try:
                        self.results[name] = job.result()
                        yield Event(name, "done", seconds=round(time.monotonic() - began, 2))
                    except Exception as e:  # one branch's failure is its own
                        failed.add(name)
                        yield Event(name, "error", f"{type(e).__name__}: {e}"[:160])

    def _without_work(self, s: Stage, failed: set[str]) -> tuple[str | None, str]:
        """The state of a stage that needs no work or can't be done, and why; (None, "") if it is to run."""
        kept = None if s.name in self.force else s.cached()
        if kept is not None:
            self.results[s.name] = kept
            return "done", "cached"
        failed.add(s.name)
        if any(n in failed - {s.name} for n in s.needs):
            return "pending", "needs a stage that did not finish"
        if self.cache_only:
            return "pending", ""
        if why := s.blocked():
            return "blocked", why
        failed.discard(s.name)
        return None, ""
