"""Category encodings that see the past only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skycadence.functions.timeline import DAY, shift
from skycadence.operators.chunks import KEYS, running_total

C = F.col
NO_CATEGORY = "\x00"


def ordered_target_mean(df: DataFrame, category: str, label: str, *, delay_s: int = 0, prior: float = 20.0, keys: Sequence[str] = KEYS,
                        ts: str = "ts", width_s: int = 30 * DAY, out: str | None = None, count: str = "n_before") -> DataFrame:
    """Mean of the target over earlier rows of the same category, drawn towards the mean of all earlier rows.

    Adds ``out`` (default ``<category>_mean``) and ``count``, the number of earlier targets in the category. A target that is
    observed at ``ts`` counts for rows from ``ts + delay_s`` on, so neither a row's own target nor one that was not yet known
    leaks in; with no delay, rows of the same time do not see each other. The mean is (sum + prior x mean of all) /
    (count + prior), NULL while nothing is known of the series. A NULL category is a category; a NULL target adds nothing; a
    row without key or time gets NULL.

    Targets and rows become one ordered stream whose running sums are taken by chunks, per category and per series, so a
    category with most of the rows is not one task's work.
    """
    name = out or f"{category}_mean"
    asked = df.select(*keys, ts, C(category).alias("_c"), F.lit(1).alias("_kind"), F.struct(*df.columns).alias("_row"), F.lit(None).cast("double").alias("_y"))
    shown = df.where(C(label).isNotNull()).select(*keys, shift(ts, delay_s).alias(ts), C(category).alias("_c"), F.lit(0 if delay_s else 2).alias("_kind"),
                                                  C(label).cast("double").alias("_y"))
    stream = asked.unionByName(shown, allowMissingColumns=True).withColumn("_c", F.coalesce(C("_c").cast("string"), F.lit(NO_CATEGORY)))
    known = F.coalesce(C("_y"), F.lit(0.0))
    one = C("_y").isNotNull().cast("long")
    order = (ts, "_kind")
    both = running_total(stream, {"_cs": known, "_cn": one}, width_s=width_s, order=order, keys=[*keys, "_c"], ts=ts)
    both = running_total(both, {"_gs": known, "_gn": one}, width_s=width_s, order=order, keys=keys, ts=ts)
    overall = C("_gs") / F.nullif(C("_gn"), F.lit(0))
    mean = (C("_cs") + F.lit(float(prior)) * overall) / (C("_cn") + F.lit(float(prior)))
    return both.where(C("_kind") == 1).select("_row.*", C("_cn").alias(count), mean.alias(name))
