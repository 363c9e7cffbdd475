"""Bounded training samples and the columns the classifiers share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BYTES = 1 << 16  # longer texts are scored whole, but are not fitted on


def remainder(modulus: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def held_out(modulus: int, rest: int) -> Column:
    return F.coalesce(remainder(modulus) == rest, F.lit(False))


def labelled_sample(labels: DataFrame, label: str, modulus: int, rest: int, per_class: int) -> DataFrame:
    """(doc_id, label): at most `per_class` ids of each class outside the held-out remainder, by hash of the id.

    Repeated ids count once, with their largest label; NULL ids and labels are left out."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(modulus) != rest))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    return known.where("label = 0").orderBy(*order).limit(per_class).union(
        known.where("label = 1").orderBy(*order).limit(per_class))


def sample_of(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """Documents of a bounded sample of ids; the sample's row limit bounds the broadcast."""
    return docs.where(F.octet_length("text") <= MAX_BYTES).join(F.broadcast(sample), "doc_id")
