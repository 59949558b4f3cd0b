"""What a remote reader needs around it: pacing, retries, settings, and shapes of what it is sent."""

from __future__ import annotations

import os
import threading
import time
from collections.abc import Callable
from pathlib import Path
from typing import Any

import pandas as pd

from drawlake.sources.readers import Reader, ReaderSpec


class Pace:
    """At least `seconds` between two calls, over all threads of a process."""

    def __init__(self, seconds: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.seconds, self.clock, self.sleep = seconds, clock, sleep
        self.next, self.lock = 0.0, threading.Lock()

    def wait(self) -> None:
        with self.lock:
            now = self.clock()
            start = max(now, self.next)
            self.next = start + self.seconds
        if start > now:
            self.sleep(start - now)

    def __getstate__(self):
        return {"seconds": self.seconds}

    def __setstate__(self, state):
        self.__init__(state["seconds"])


def paced(read: Reader, seconds: float, workers: int = 1) -> Reader:
    """At least `seconds` between two calls over all workers: each of at most `workers` tasks (observe's bound) keeps to its
    share of the rate, since no lock reaches over machines."""
    pace = Pace(seconds * workers)

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        pace.wait()
        return read(batch)

    return run


def is_rate_limit(error: BaseException) -> bool:
    return "429" in str(error) or "RESOURCE_EXHAUSTED" in str(error)


def retried(read: Reader, tries: int = 3, wait: float = 2.0, limited_wait: float = 20.0, sleep: Callable[[float], None] = time.sleep) -> Reader:
    """Tries again after an error, longer each time, and longer still when the service says that there were too many calls."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        for k in range(tries):
            try:
                return read(batch)
            except Exception as e:
                if k == tries - 1:
                    raise
                sleep((limited_wait if is_rate_limit(e) else wait) * (k + 1))
        raise AssertionError("no tries")

    return run


def completed(answer: dict[str, Any], most_tokens: int | None = None) -> str | None:
    """Why an answer can't be used, or None: cut off, blocked or empty."""
    if answer.get("stop") == "max_tokens" or most_tokens is not None and answer.get("output_tokens", 0) >= most_tokens:
        return "the answer was cut off"
    if answer.get("stop") in ("blocked", "refusal"):
        return "the answer was blocked"
    return None if answer.get("text") else "the answer was empty"


def settings(path: str | None = None, environment: dict[str, str] | None = None) -> dict[str, str]:
    """Settings of a file of NAME=value lines, under those that the environment has already."""
    out = {}
    if path and Path(path).exists():
        for line in Path(path).read_text().splitlines():
            name, sign, value = line.strip().partition("=")
            if sign and not name.startswith("#"):
                out[name.strip()] = value.strip().strip("'\"")
    return out | dict(os.environ if environment is None else environment)


def with_availability(reader: ReaderSpec, needed: str, have: dict[str, str]) -> ReaderSpec:
    """The reader, blocked if the setting that it needs is not there."""
    return reader if have.get(needed) else ReaderSpec(reader.name, reader.read, reader.thousandths, f"{needed} is not set")


def chosen(names: list[str], default: str, override: str | None, have: dict[str, str], variable: str) -> str:
    """A reader's name: the call's, else the environment's, else the default; an unknown one is an error."""
    name = override or have.get(variable) or default
    if name not in names:
        raise KeyError(f"unknown reader {name!r}; known: {sorted(names)}")
    return name


def clamped_effort(effort: str, allowed: list[str]) -> str | None:
    """The asked effort or the highest allowed below it; None where a reader takes none."""
    order = ["low", "medium", "high", "xhigh"]
    under = [e for e in order[: order.index(effort) + 1] if e in allowed]
    return under[-1] if under else None


def without_keys(schema: Any, keys: set[str]) -> Any:
    """A nested document without certain keys, at any depth."""
    if isinstance(schema, dict):
        return {k: without_keys(v, keys) for k, v in schema.items() if k not in keys}
    return [without_keys(v, keys) for v in schema] if isinstance(schema, list) else schema
