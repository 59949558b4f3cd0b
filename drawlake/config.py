"""The knobs of a run in one place."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields


@dataclass(frozen=True)
class RunConfig:
    """reader and second name the models that read; cascade reads with both and adjudicates. workers bounds the tiles read at
    a time, seconds_between the calls of a provider. cache_only computes nothing, fresh forgets what is cached."""

    pages: tuple[int, ...] = ()
    reader: str = "first"
    second: str | None = None
    judge: str | None = None
    cascade: bool = False
    document_id: str | None = None
    tile: int = 1250
    overlap: float = 0.15
    workers: int = 8
    seconds_between: float = 0.0
    min_confidence: float = 0.35
    include_admin_tables: bool = False
    cache_only: bool = False
    fresh: bool = False
    quiet: bool = False

    def __post_init__(self):
        if self.cascade and not (self.second and self.judge):
            raise ValueError("a cascade needs a second reader and a judge")
        if self.workers < 1 or not 0 <= self.overlap < 1:
            raise ValueError("workers must be 1 or more, overlap from 0 to below 1")

    @classmethod
    def of(cls, settings: dict[str, str], **own) -> RunConfig:
        """From settings named DRAWLAKE_<FIELD>, under the values given here."""
        read = {bool: lambda x: x.lower() in ("1", "true", "yes"), int: int, float: float, str: str}
        out = {}
        for f in fields(cls):
            kind = type(f.default) if f.default is not None else str
            if (text := settings.get(f"DRAWLAKE_{f.name.upper()}")) is not None:
                out[f.name] = tuple(map(int, text.split(","))) if kind is tuple else read[kind](text)
        return cls(**(out | own))

    def told(self) -> dict[str, str]:
        """Fields that differ from their defaults, as text."""
        return {k: str(v) for k, v in asdict(self).items() if v != getattr(RunConfig, k)}
