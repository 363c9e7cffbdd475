"""Exact de-duplication: a 128-bit content hash groups, the bytes themselves decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skycadence.llm.shared import documents, join_hot, text_or_empty

# The characters [\x20\x09-\x0D] that do not count.
BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return text


def _rank(length: Column, doc_id: Column) -> Column:
    """One number that is largest for the longest text, then the smallest id; a NULL id comes last.

    Primitive and fixed in width, so the aggregate stays a hash aggregate with map-side combining."""
    wide = "decimal(38,0)"
    return (length.cast(wide) * F.lit("100000000000000000000").cast(wide)
            + F.coalesce(F.lit("10000000000000000000").cast(wide) - doc_id, F.lit(0).cast(wide))).cast(wide)


def _id_of(rank: Column) -> Column:
    low = rank % F.lit("100000000000000000000").cast("decimal(38,0)")
    return F.when(low != 0, (F.lit("10000000000000000000").cast("decimal(38,0)") - low).cast("long"))


def exact_groups(docs: DataFrame) -> DataFrame:
    """For each document: the row that stays of its group, the group's size, and the hash of its text.

    Texts are equal when they are the same bytes without blanks. The longest original text stays, then the
    smallest doc_id. NULL text counts as empty, and all empty texts are one group; rows with the same doc_id
    are separate rows; a NULL doc_id stays only where no row of its length has an id. An empty table gives an
    empty result; columns other than doc_id and text are not read.

    Copies combine on the map side, so a group with a third of all rows sends one row per task. Grouping on
    hash and text compares bytes: texts that differ never share a group, and a pair that collided in both
    hashes would raise an error instead of being merged.
    """
    norm = normalised(text_or_empty())
    rows = docs.select("doc_id", F.char_length(text_or_empty()).alias("length"), norm.alias("norm"),
                       F.unhex(F.md5(norm)).alias("h"), F.sha2(norm, 256).alias("text_sha256"))
    same_bytes = rows.groupBy("h", "text_sha256", "norm").agg(
        F.count("*").alias("n"), F.max(_rank(F.col("length"), F.col("doc_id"))).alias("best"))
    groups = same_bytes.groupBy("h", "text_sha256").agg(
        F.sum("n").alias("n"), F.max("best").alias("best"), F.count("*").alias("texts"))
    groups = groups.select("h", "text_sha256", "best", F.when(F.col("texts") == 1, F.col("n")).otherwise(
        F.raise_error(F.lit("two texts share both hashes")).cast("long")).alias("group_size"))
    return (join_hot(rows.select("doc_id", "length", "h", "text_sha256"), groups, ["h", "text_sha256"])
            .select("doc_id", _id_of(F.col("best")).alias("keep_id"), "group_size",
                    (F.col("best") == _rank(F.col("length"), F.col("doc_id"))).alias("kept"), "text_sha256"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS len,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
w AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY len DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY norm) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w
"""
