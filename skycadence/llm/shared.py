"""Helpers the text operators share: input columns, and tables written once to the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skycadence.session import delete_at_end


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a private one only on a local master, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = set_dir.get() if set_dir.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="llm-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """Write `df` once to the shared folder and return it as read back: lineage ends there.

    The table is removed when the application ends."""
    path = f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_at_end(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join rows, of which one key may hold any share, with a table of one row per key.

    A table that an aggregate left partitioned by the keys would be joined in place, and a hot key would stay in one
    task. The hash of the keys that is added here makes both sides shuffle for this join alone, so adaptive execution
    can split the rows of a hot key."""
    table = table.withColumnsRenamed({k: f"__r_{k}" for k in keys}).withColumn("__r_key", F.xxhash64(*[f"__r_{k}" for k in keys]))
    rows = rows.withColumn("__key", F.xxhash64(*keys))
    on = rows["__key"] == table["__r_key"]
    for k in keys:
        on = on & (rows[k] == table[f"__r_{k}"])
    return rows.join(table, on, how).drop("__key", "__r_key", *[f"__r_{k}" for k in keys])


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
