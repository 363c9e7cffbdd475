"""Filling gaps, scaling, and sample weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from skycadence.functions.exprs import lookup
from skycadence.functions.timeline import DAY
from skycadence.operators.chunks import KEYS, carry_last, carry_next
from skycadence.operators.ranks import exact_quantiles
from skycadence.operators.windows import backward_fill, forward_fill


def constant_fill(col: str, value, flag: str | None = None) -> list[Column]:
    out = [F.coalesce(F.col(col), F.lit(value)).alias(col)]
    return out + ([F.col(col).isNotNull().cast("int").alias(flag)] if flag else [])


def bounded_fill(g: DataFrame, col: str, w: WindowSpec, forward: int, backward: int = 0, default=None,
                 out: str | None = None) -> DataFrame:
    """Forward at most ``forward`` slots, then backward at most ``backward``, then a constant."""
    name = out or f"{col}_clean"
    g = g.withColumn(name, forward_fill(col, forward, w))
    if backward:
        g = g.withColumn(name, backward_fill(name, backward, w))
    return g if default is None else g.withColumn(name, F.coalesce(name, F.lit(default)))


def fill_within(df: DataFrame, col: str, group: Sequence[str], *, order: Sequence[str] = ("ts",), ts: str = "ts",
                width_s: int = 7 * DAY, fallback: str | float | None = None, out: str | None = None) -> DataFrame:
    """Nearest earlier value inside the group, else the nearest later one, else a fallback.

    A row without group or time keeps its own value, or takes the fallback.

    ``fallback`` is a constant, or ``"median"`` for the exact median of the series.
    """
    name = out or f"{col}_filled"
    d = carry_last(df, {"_f": F.col(col)}, width_s=width_s, order=order, keys=group, ts=ts)
    d = carry_next(d, {"_b": F.col(col)}, width_s=width_s, order=order, keys=group, ts=ts)
    value = F.coalesce("_f", "_b", col)
    if fallback == "median":
        d = d.join(exact_quantiles(df, col, group[:1], {"_m": 0.5}), list(group[:1]), "left")
        value = F.coalesce(value, "_m")
    elif fallback is not None:
        value = F.coalesce(value, F.lit(fallback))
    return d.select(*df.columns, value.alias(name))


def climatology_fill(df: DataFrame, col: str, dims: Sequence[str], train: Column, *, keys: Sequence[str] = KEYS,
                     out: str | None = None) -> DataFrame:
    """Missing values from the training median of (series, dims), else of the series."""
    name = out or f"{col}_clean"
    seen = df.where(train & F.col(col).isNotNull())
    cells = exact_quantiles(seen, col, [*keys, *dims], {"_cell": 0.5})
    overall = exact_quantiles(seen, col, keys, {"_all": 0.5})
    j = df.join(cells, [*keys, *dims], "left").join(overall, list(keys), "left")
    return j.select(*df.columns, F.coalesce(col, "_cell", "_all").alias(name), F.col(col).isNotNull().cast("int").alias(f"{col}_available"))


def ratio_fill(df: DataFrame, col: str, base: str, base_clean: str, *, keys: Sequence[str] = KEYS, out: str | None = None) -> DataFrame:
    """A derived column from its base times the median ratio of the series."""
    r = df.withColumn("_r", F.col(col) / F.nullif(F.col(base), F.lit(0.0)))
    med = exact_quantiles(r, "_r", keys, {"_ratio": 0.5})
    return df.join(med, list(keys), "left").select(*df.columns, F.coalesce(F.col(col), F.col(base_clean) * F.col("_ratio")).alias(out or f"{col}_clean"))


def train_medians(df: DataFrame, cols: Sequence[str], train: Column, keys: Sequence[str] = KEYS) -> DataFrame:
    """Exact training medians of many columns, one row per series."""
    long = df.where(train).unpivot(list(keys), list(cols), "column", "value")
    q = exact_quantiles(long, "value", [*keys, "column"], {"median": 0.5})
    return q.groupBy(*keys).pivot("column", list(cols)).agg(F.first("median"))


def median_impute(df: DataFrame, cols: Sequence[str], train: Column, keys: Sequence[str] = KEYS) -> DataFrame:
    med = train_medians(df, cols, train, keys).select(*keys, *[F.col(c).alias(f"_m_{c}") for c in cols])
    j = df.join(med, list(keys), "left")
    return j.select(*[F.coalesce(c, f"_m_{c}").alias(c) if c in cols else F.col(c) for c in df.columns])


def scale(df: DataFrame, cols: Sequence[str], train: Column, kind: str = "standard", keys: Sequence[str] = KEYS) -> DataFrame:
    """Training-only scaling: zero mean and unit population std, or min-max to [-1, 1].
    Constant columns become 0."""
    aggs = []
    for c in cols:
        x = F.when(train, F.col(c))
        aggs += ([F.avg(x).alias(f"_a_{c}"), F.stddev_pop(x).alias(f"_b_{c}")] if kind == "standard"
                 else [F.min(x).alias(f"_a_{c}"), F.max(x).alias(f"_b_{c}")])
    j = df.join(df.groupBy(*keys).agg(*aggs), list(keys), "left")
    out = []
    for c in df.columns:
        if c not in cols:
            out.append(F.col(c))
        elif kind == "standard":
            z = (F.col(c) - F.col(f"_a_{c}")) / F.col(f"_b_{c}")
            out.append(F.when(F.col(f"_b_{c}") == 0, F.lit(0.0)).otherwise(z).alias(c))
        else:
            span = F.col(f"_b_{c}") - F.col(f"_a_{c}")
            z = F.lit(2.0) * (F.col(c) - F.col(f"_a_{c}")) / span - F.lit(1.0)
            out.append(F.when(span == 0, F.lit(0.0)).otherwise(z).alias(c))
    return j.select(*out)


def tier_weight(tier, table: dict[str, float], default: float = 0.6) -> Column:
    return lookup(tier, table, default)


def composite_weight(tier_w: Column, quality: Column, contradictory: Column, ground_truth: Column) -> Column:
    """tier x (0.5 + 0.5 quality) x 0.7 when products disagree x 1.15 with ground truth."""
    return (tier_w * (F.lit(0.5) + F.lit(0.5) * F.coalesce(quality, F.lit(0.7)))
            * F.when(contradictory, F.lit(0.7)).otherwise(F.lit(1.0))
            * F.when(ground_truth, F.lit(1.15)).otherwise(F.lit(1.0)))
