"""Conditional and row-wise column expressions with explicit NULL rules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _as(c) -> Column:
    return F.col(c) if isinstance(c, str) else (c if isinstance(c, Column) else F.lit(c))


def floor_at(x, lo) -> Column:
    """``max(x, lo)`` that keeps NULL (``greatest`` alone would return ``lo``)."""
    x = _as(x)
    return F.when(x.isNotNull(), F.greatest(x, _as(lo)))


def cap_at(x, hi) -> Column:
    x = _as(x)
    return F.when(x.isNotNull(), F.least(x, _as(hi)))


def clip(x, lo=None, hi=None) -> Column:
    x = _as(x)
    y = x
    if lo is not None:
        y = F.greatest(y, _as(lo))
    if hi is not None:
        y = F.least(y, _as(hi))
    return F.when(x.isNotNull(), y)


def inside(x, lo, hi) -> Column:
    """Inclusive range test; NULL counts as outside."""
    return F.coalesce(_as(x).between(lo, hi), F.lit(False))


def row_max(*cols) -> Column:
    return F.greatest(*[_as(c) for c in cols])


def row_min(*cols) -> Column:
    return F.least(*[_as(c) for c in cols])


def row_mean(*cols) -> Column:
    """Mean over the non-NULL columns of a row."""
    total = reduce(lambda a, b: a + b, [F.coalesce(_as(c).cast("double"), F.lit(0.0)) for c in cols])
    n = reduce(lambda a, b: a + b, [_as(c).isNotNull().cast("int") for c in cols])
    return F.when(n > 0, total / n)


def strict_mean(cols: Sequence, lo=None, hi=None) -> Column:
    """Mean only if every column is present (and inside ``[lo, hi]``)."""
    parts = [_as(c) for c in cols]
    ok = reduce(lambda a, b: a & b,
                [(inside(p, lo, hi) if lo is not None else p.isNotNull()) for p in parts])
    return F.when(ok, reduce(lambda a, b: a + b, parts) / F.lit(float(len(parts))))


def cut(x, edges: Sequence[float], labels: Sequence[str], missing: str | None = None) -> Column:
    """Right-closed binning: ``edges[i] < x <= edges[i+1]`` gets ``labels[i]``."""
    x = _as(x)
    out = None
    for lo, hi, name in zip(edges[:-1], edges[1:], labels, strict=True):
        test = F.lit(True)
        if lo != float("-inf"):
            test = x > F.lit(float(lo))
        if hi != float("inf"):
            test = test & (x <= F.lit(float(hi)))
        test = x.isNotNull() & test
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    if missing is not None:
        out = F.when(x.isNull(), F.lit(missing)).otherwise(out)
    return out


def floor_bucket(x, width: float, lowest: float = 0.0) -> Column:
    return floor_at(F.floor(_as(x) / F.lit(float(width))) * F.lit(float(width)), lowest)


def lookup(key, table: dict, default=None) -> Column:
    """Constant dictionary lookup, resolved in generated code."""
    key = _as(key)
    out = None
    for k, v in table.items():
        out = F.when(key == F.lit(k), F.lit(v)) if out is None else out.when(key == F.lit(k), F.lit(v))
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def flag(test: Column) -> Column:
    """1/0 integer flag; NULL tests count as 0."""
    return F.when(test, F.lit(1)).otherwise(F.lit(0))


def ordered_union(*lists: Sequence[str]) -> list[str]:
    """Concatenate column-name lists, first occurrence wins."""
    return list(dict.fromkeys(name for names in lists for name in names))


def available(names: Sequence[str], columns: Sequence[str]) -> list[str]:
    have = set(columns)
    return [n for n in names if n in have]


def without(names: Sequence[str], drop: Sequence[str]) -> list[str]:
    gone = set(drop)
    return [n for n in names if n not in gone]
