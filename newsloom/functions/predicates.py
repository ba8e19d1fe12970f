"""Predicates and orders that are built from optional parameters."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def matches_any(col: str | Column, patterns: Iterable[str]) -> Column:
    """Any of the patterns, capitals or not. They are expressions and are not escaped; none at all match nothing."""
    joined = "|".join(patterns)
    return F.rlike(_col(col), F.lit(f"(?iU){joined}")) if joined else F.lit(False)


def within(col: str | Column, now: str, hours: float, start: str | None = None, end: str | None = None) -> Column:
    """Between ``start`` and ``end``, both included, if both are given; else in the last ``hours``. Rows without a time pass."""
    c = _col(col).cast("timestamp")
    at = lambda s: F.lit(s).cast("timestamp")
    if start is not None and end is not None:
        return c.isNull() | c.between(at(start), at(end))
    return c.isNull() | (c >= at(now) - F.expr(f"INTERVAL '{int(hours * 3600)}' SECOND"))


def optional(col: str | Column, value: object) -> Column:
    """Equal to the value; everything if there is none."""
    return F.lit(True) if value is None else _col(col) == F.lit(value)


def all_open(*gates: Column) -> Column:
    """Every gate is true; one that is null is shut."""
    out = F.lit(True)
    for g in gates:
        out = out & F.coalesce(g, F.lit(False))
    return out


def sort_keys(key: str, allowed: dict[str, float], default: str | None = None) -> list[Column]:
    """Descending by ``key`` if it is allowed, else by ``default`` or the first allowed one; ``allowed`` says what a missing value counts as."""
    chosen = key if key in allowed else default or next(iter(allowed))
    return [F.desc(F.coalesce(F.col(chosen).cast("double"), F.lit(float(allowed[chosen]))))]
