"""Metadata filters: a value that becomes a predicate."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import BadRequest


def _tag(t: str) -> str:
    return t.strip().lower()


@dataclass(frozen=True)
class SearchFilter:
    """All given conditions must hold; a null field meets none of them."""

    source: str | None = None
    mode: str | None = None
    tags: tuple[str, ...] = ()
    updated_at_gte: dt.date | None = None
    updated_at_lte: dt.date | None = None

    def __post_init__(self):
        if self.mode not in (None, "none", "any", "all"):
            raise BadRequest(f"unknown tag filter mode: {self.mode}")
        object.__setattr__(self, "tags", tuple(sorted({_tag(t) for t in self.tags or ()})))

    @classmethod
    def from_dict(cls, d: dict | None) -> SearchFilter | None:
        if d is None:
            return None
        days = {}
        for k in ("updated_at_gte", "updated_at_lte"):
            if d.get(k) is not None:
                try:
                    days[k] = dt.datetime.strptime(d[k], "%Y-%m-%d").date()
                except (TypeError, ValueError) as e:
                    raise BadRequest(f"{k}: not a date: {d[k]!r}") from e
        return cls(source=d.get("source"), mode=d.get("mode"), tags=tuple(d.get("tags") or ()), **days)

    def to_dict(self) -> dict:
        out: dict = {} if self.source is None else {"source": self.source}
        out["mode"] = self.mode or "none"
        if out["mode"] != "none":
            out["tags"] = list(self.tags)
        for k in ("updated_at_gte", "updated_at_lte"):
            if (v := getattr(self, k)) is not None:
                out[k] = v.isoformat()
        return out

    def column(self) -> Column:
        """The predicate over source, tags and updated_at."""
        out = F.lit(True)
        if self.source is not None:
            out &= F.col("source") == self.source
        if self.mode in ("any", "all") and self.tags:
            have = F.coalesce(F.col("tags"), F.array().cast("array<string>"))
            wanted = F.array(*map(F.lit, self.tags))
            out &= F.arrays_overlap(have, wanted) if self.mode == "any" else F.size(F.array_except(wanted, have)) == 0
        if self.updated_at_gte is not None:
            out &= F.col("updated_at") >= F.lit(self.updated_at_gte)
        if self.updated_at_lte is not None:
            out &= F.col("updated_at") <= F.lit(self.updated_at_lte)
        return F.coalesce(out, F.lit(False))
