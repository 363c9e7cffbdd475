"""Reading: fallback locations, canonical columns, local time, wide views."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skycadence.functions.timeline import shift, year_range
from skycadence.spec import SiteSpec


def first_available(spark: SparkSession, paths: Sequence[str], fmt: str = "parquet", **options) -> DataFrame:
    """The first location that can be opened (local copy before remote)."""
    problem = None
    for path in paths:
        try:
            return spark.read.format(fmt).options(**options).load(path)
        except AnalysisException as e:
            problem = e
    raise FileNotFoundError(f"none of {list(paths)} can be read") from problem


def table_or_path(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name) if spark.catalog.tableExists(name) else spark.read.parquet(name)


def to_canonical(df: DataFrame, spec: SiteSpec, *, ts_source: str, measures_as_double: bool = True) -> DataFrame:
    """Source columns renamed to the canonical schema, time shifted to local, years cut.

    The year limit is a range on the source column, so it reaches the file scan.
    """
    if spec.first_year is not None:
        lo = spec.first_year
        hi = spec.last_year or lo
        raw = shift(ts_source, spec.utc_shift_hours * 3600) if spec.utc_shift_hours else F.col(ts_source)
        df = df.where(year_range(raw, lo, hi))
    local = shift(ts_source, spec.utc_shift_hours * 3600) if spec.utc_shift_hours else F.col(ts_source)
    cols = [F.col(src).cast("double").alias(name) if measures_as_double else F.col(src).alias(name)
            for name, src in spec.columns.items()]
    return df.select(F.lit(spec.name).alias("site"), local.alias("ts"), *cols)


def zoned_to_local(ts: Column, zone: str) -> Column:
    """Instant to wall time of ``zone``, zone-free afterwards."""
    return F.from_utc_timestamp(ts, zone).cast("timestamp_ntz")


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = {c for c, t in df.dtypes if t in ("double", "float")}
    return df.select(*[F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) if c in floats else F.col(c)
                       for c in df.columns])


def to_number(col: str) -> Column:
    """Text to double, anything unreadable to NULL."""
    return F.col(col).try_cast("double")


def wide_view(parts: Sequence[DataFrame], keys: Sequence[str] = ("site", "ts")) -> DataFrame:
    return reduce(lambda a, b: a.join(b, list(keys), "inner"), parts)


def read_metrics_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)
