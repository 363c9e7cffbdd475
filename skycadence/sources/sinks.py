"""Writing: staged datasets, tables, reports, incremental append, verification."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skycadence.session import delete_at_end, scratch_path


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def materialize(df: DataFrame, stem: str = "stage") -> DataFrame:
    """Write once to the shared folder and read back.

    For results several branches or many fits read: a written table survives lost
    executors and keeps the pipeline behind it from being recomputed per reader.
    """
    path = scratch_path(df.sparkSession, stem)
    df.write.parquet(path)
    delete_at_end(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_sorted(df: DataFrame, path: str, keys: Sequence[str] = ("site", "ts"), partitions: int | None = None) -> None:
    """Range-partitioned and sorted inside files, so readers can skip row groups."""
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def write_stages(df: DataFrame, path: str, stages: dict[str, Sequence[str]], split: str = "split") -> None:
    """One dataset per column list, each partitioned by split."""
    for name, cols in stages.items():
        write_parquet(df.select(split, *cols), f"{path}/{name}", [split])


def create_or_replace(df: DataFrame, table: str, path: str | None = None) -> None:
    w = df.write.mode("overwrite").format("parquet")
    (w.option("path", path) if path else w).saveAsTable(table)


def write_bucketed(df: DataFrame, table: str, buckets: int, keys: Sequence[str] = ("site",), path: str | None = None) -> None:
    """Hash-bucketed table: later joins on ``keys`` need no shuffle of this side."""
    w = df.write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    (w.option("path", path) if path else w).saveAsTable(table)


def stored(df: DataFrame, keys: Sequence[str], buckets: int, stem: str = "stored") -> DataFrame:
    """A source kept in the layout of its joins: bucketed and sorted by the join keys, below the shared folder.

    Two sources that are stored with the same keys and number of buckets are joined on those keys, and grouped by them,
    without a shuffle of either side, however often. The table's name is unique; dropping the table leaves its files."""
    path = scratch_path(df.sparkSession, stem)
    name = f"{stem}_{path.rsplit('-', 1)[1]}"
    write_bucketed(df, name, buckets, keys, path)
    delete_at_end(df.sparkSession, path)
    return df.sparkSession.table(name)


def patch_partitions(patch: DataFrame, path: str, partition_by: Sequence[str], keys: Sequence[str], *, replace: bool = False) -> list[dict]:
    """Merge rows into the partitions they touch; the files of all other partitions are neither read nor written.

    A row with the keys of an existing one fills its missing values, or with ``replace`` gives it its own values where they
    are not NULL; other rows are added. Keys match where both are NULL. The merged partitions are written aside first, then
    they replace the old ones in one dynamic overwrite, so a job that fails before leaves the table as it was. Returns the
    touched partitions. The patch must have one row per key; columns the patch lacks keep their values.
    """
    spark: SparkSession = patch.sparkSession
    patch = materialize(patch, "patch")
    touched = [r.asDict() for r in patch.select(*partition_by).distinct().collect()]  # as many as there are partitions
    if not touched:
        return []
    target = spark.read.parquet(path)
    names = target.columns

    def all_of(conditions):
        return reduce(lambda a, b: a & b, conditions)
    hit = reduce(lambda a, b: a | b, [all_of([F.col(k).eqNullSafe(F.lit(v)) for k, v in t.items()]) for t in touched])
    same = list(dict.fromkeys([*partition_by, *keys]))
    new = patch.select([F.col(c).alias(f"_n_{c}") for c in patch.columns] + [F.lit(True).alias("_new")])
    old = target.where(hit).withColumn("_old", F.lit(True))
    both = old.join(new, all_of([old[k].eqNullSafe(new[f"_n_{k}"]) for k in same]), "full")

    def value(c: str):
        if c not in patch.columns:
            return F.col(c)
        if c in same:
            return F.when(F.col("_old"), F.col(c)).otherwise(F.col(f"_n_{c}")).alias(c)
        pair = (f"_n_{c}", c) if replace else (c, f"_n_{c}")
        return F.coalesce(*pair).alias(c)
    merged = materialize(both.select(*[value(c) for c in names]), "merged")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)
    return touched


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """One file; only the report's rows meet in one task, not the work that makes them."""
    w = df.repartition(1).write.mode("overwrite")
    w.option("header", "true").csv(path) if fmt == "csv" else w.json(path)


def append_since(df: DataFrame, path: str, ts: str = "ts", by: Sequence[str] = (), key: Sequence[str] = ()) -> None:
    """Append what is new since the target's high-water mark; without a target, write all.

    Every series (``by``) has its own mark, so one that lags behind loses nothing. Rows at the
    mark are compared on ``key`` (all columns by default), so a row that shares the last time
    is neither lost nor written twice. Any error but a missing path is raised.
    """
    spark: SparkSession = df.sparkSession
    try:
        target = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        df.write.mode("append").parquet(path)
        return
    if ts not in target.columns:
        raise ValueError(f"{path} has no column {ts}: replace it as a whole")
    key = list(dict.fromkeys([*(key or df.columns), *by, ts]))
    marks = target.groupBy(*by).agg(F.max(ts).alias("_mark"))
    if by:
        marks = marks.withColumnsRenamed({k: f"_m_{k}" for k in by})
        on = reduce(lambda a, b: a & b, [df[k].eqNullSafe(marks[f"_m_{k}"]) for k in by])
        late = df.join(marks, on, "left").drop(*[f"_m_{k}" for k in by])
        late = late.where(F.col("_mark").isNull() | (F.col(ts) >= F.col("_mark"))).drop("_mark")
    else:  # one mark: as a literal it reaches the scan
        mark = marks.first()["_mark"]
        late = df if mark is None else df.where(F.col(ts) >= F.lit(mark))
        target = target if mark is None else target.where(F.col(ts) >= F.lit(mark))
    there = target.select(*[F.col(k).alias(f"_t_{k}") for k in key]).distinct()
    on = reduce(lambda a, b: a & b, [late[k].eqNullSafe(there[f"_t_{k}"]) for k in key])
    late.join(there, on, "left_anti").write.mode("append").parquet(path)


def verification(df: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(key).alias("n_keys"),
                  F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def counts_match(a: DataFrame, b: DataFrame) -> DataFrame:
    """Row counts of a copy and its original side by side."""
    tagged = a.select(F.lit("a").alias("side")).unionAll(b.select(F.lit("b").alias("side")))
    n = tagged.agg(F.count_if(F.col("side") == "a").alias("n_a"), F.count_if(F.col("side") == "b").alias("n_b"))
    return n.withColumn("matches", F.col("n_a") == F.col("n_b"))


def backfill(df: DataFrame, other: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("site", "ts")) -> DataFrame:
    """Fill missing values of ``cols`` (or add the columns) from another table."""
    o = other.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in cols])
    joined = df.join(o, list(keys), "left")
    rest = [c for c in df.columns if c not in cols]
    return joined.select(*rest, *[(F.coalesce(c, f"_n_{c}") if c in df.columns else F.col(f"_n_{c}")).alias(c) for c in cols])


def null_profile(df: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Percent of non-NULL values per column (and group), in long form."""
    cols = list(cols or [c for c in df.columns if c not in by])
    one = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in cols])
    return (one.unpivot([*by, "_n"], cols, "column", "n_nonnull")
            .select(*by, "column", "n_nonnull", (F.lit(100.0) * F.col("n_nonnull") / F.col("_n")).alias("pct_nonnull")))


def coverage_by_period(df: DataFrame, period, value: str, lo: float, hi: float, by: Sequence[str] = ()) -> DataFrame:
    """Rows, NULLs and in-range values per calendar period."""
    v = F.col(value)
    return df.groupBy(*by, period.alias("period")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(v.isNull()).alias("n_null"), F.count_if(v.between(lo, hi)).alias("n_in_range"))
