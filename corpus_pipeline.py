"""The training-data pipeline: documents pass through the stages in order, each reading what the last one wrote.

Toxic documents go; lines that recur across documents go; one document of each group of near duplicates (five-word
shingles, similarity 0.8) stays; documents that contain a benchmark item go; what is left is repeated to the target
weights of its sources and dealt out at random. All stages but the last return the columns of documents; the last adds
copy, repeats and rate. NULL ids and texts pass every filter that cannot judge them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skycadence.llm import decontamination, line_templates, mixing, setsketch, toxicity
from skycadence.llm.shared import documents, written


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, documents(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = line_templates.drop_recurring_lines(docs, verbatim=True)
    length = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", length).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return setsketch.one_of_each(docs, width=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminated(docs, documents(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("toxicity", toxicity_filter),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mixture),
]
ORACLE_SQL = None  # a trained classifier is not a SQL expression


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{name.replace(' ', '-')}")
    return docs
