"""Mixing sources to target weights by Poisson replication, in DataFrame functions only."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skycadence.llm.shared import documents

# Target weights of the production mixture: integer parts per mass (UTF-8 bytes). REST is all other sources.
REST = "*"
WEIGHTS = {"src0": 10, "src1": 12, "src2": 12, "src3": 8, "src4": 8, REST: 50}
SEED = 20
PIECE = 16  # a Poisson count of a larger mean is a sum of counts of means up to this
TAIL = 90  # P(count > 90) < 1e-32 at mean 16: beyond the 52 bits of the uniform number
MAX_WEIGHTS = 10_000


def uniform(doc_id: Column, seed: int, part: Column) -> Column:
    """A number in [0, 1) of 52 bits, the same on every engine that has MD5."""
    key = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(str(seed)), part.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def target_rates(docs: DataFrame, weights: dict[str, int]) -> DataFrame:
    """(bucket, rate): the mean number of times a document of the bucket is repeated.

    rate = weight * total mass / (weights of buckets that have mass * mass of the bucket), so the expected mass of
    the mixture is the mass of the input and present buckets share it by weight. The table has one row per weight
    at most, whatever the number of sources."""
    mass = docs.groupBy(bucket(weights).alias("bucket")).agg(F.sum(F.octet_length("text")).alias("mass"))
    parts = F.from_json(F.lit(json.dumps(weights)), "map<string,bigint>")
    mass = mass.withColumn("weight", F.element_at(parts, F.col("bucket")).cast("double")).filter(
        (F.col("mass") > 0) & (F.col("weight") > 0))
    whole = mass.agg(F.sum("mass").cast("double").alias("total"), F.sum("weight").alias("weights"),
                     F.collect_list(F.struct("bucket", "mass", "weight")).alias("buckets"))
    return whole.select("total", "weights", F.inline("buckets")).select(
        "bucket", (F.col("weight") * F.col("total") / (F.col("weights") * F.col("mass").cast("double"))).alias("rate"))


def bucket(weights: dict[str, int]) -> Column:
    named = [name for name in weights if name != REST]
    return F.when(F.col("source").isin(named), F.col("source")).otherwise(F.lit(REST)) if named else F.lit(REST)


def with_cdf(rates: DataFrame) -> DataFrame:
    """Add `pieces` and `cdf`, the distribution function at 0..TAIL of a Poisson count of mean rate / pieces."""
    pieces = F.greatest(F.lit(1), F.ceil(F.col("rate") / PIECE)).cast("int")
    step = F.aggregate(
        F.sequence(F.lit(1), F.lit(TAIL)),
        F.struct(F.exp(-F.col("mean")).alias("p"), F.array(F.exp(-F.col("mean"))).alias("cdf")),
        lambda acc, k: F.struct(
            (acc["p"] * F.col("mean") / k.cast("double")).alias("p"),
            F.array_append(acc["cdf"], F.element_at(acc["cdf"], -1) + acc["p"] * F.col("mean") / k.cast("double"))
            .alias("cdf")), lambda acc: acc["cdf"])
    return rates.withColumn("pieces", pieces).withColumn("mean", F.col("rate") / F.col("pieces")).withColumn("cdf", step)


def mix(docs: DataFrame, weights: dict[str, int] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """Documents repeated to target weights and dealt out at random: all input columns, then copy, repeats and rate.

    Each document draws a Poisson count from its own id and the seed: the count does not depend on partitions or
    row order, and a rerun after a lost executor gives the same rows. Rows with count 0 are left out. Each copy goes
    to a random partition and a random place in it. Weights of absent sources fall to the present ones; sources
    without a weight and NULL sources share the weight of REST (none given: they are left out). Equal doc_ids draw
    equal counts, NULL ids draw as one id, and NULL texts have no mass but draw like others. If no text has any
    mass, or the table is empty, the result is empty. Input columns named like an added one are replaced.

    Only the table of rates is broadcast: at most MAX_WEIGHTS rows. No shuffle has the source as key but the sums.
    """
    if len(weights) > MAX_WEIGHTS or any(int(w) != w or w < 0 for w in weights.values()):
        raise ValueError(f"weights are at most {MAX_WEIGHTS} non-negative integers")
    own = [c for c in docs.columns if c not in ("copy", "repeats", "rate")]
    rates = with_cdf(target_rates(docs, weights)).select(
        F.col("bucket").alias("__bucket"), F.col("rate").alias("__rate"), F.col("pieces").alias("__pieces"),
        F.col("cdf").alias("__cdf"))
    drawn = docs.select(*own, bucket(weights).alias("__bucket")).join(F.broadcast(rates), "__bucket")
    count = F.aggregate(
        F.sequence(F.lit(1), F.col("__pieces")), F.lit(0),
        lambda acc, part: acc + F.aggregate(
            F.transform(F.array(uniform(F.col("doc_id"), seed, part)), lambda u: F.size(F.filter(
                F.col("__cdf"), lambda c: c <= u))), F.lit(0), lambda a, b: a + b))
    copies = drawn.withColumn("repeats", count).filter(F.col("repeats") > 0).select(
        *own, F.explode(F.sequence(F.lit(1), F.col("repeats"))).alias("copy"), "repeats", F.col("__rate").alias("rate"))
    parts = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    place = F.xxhash64(F.col("doc_id"), F.col("copy"), F.lit(seed))
    dealt = copies.withColumn("__place", place).repartition(int(parts), "__place")
    return dealt.sortWithinPartitions("__place").drop("__place")


def op3_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


SQL = f"""
WITH RECURSIVE w(bucket, weight) AS (VALUES {', '.join(f"('{k}', {v}::DOUBLE)" for k, v in WEIGHTS.items())}),
d AS (SELECT *, CASE WHEN source IN (SELECT bucket FROM w WHERE bucket <> '{REST}') THEN source ELSE '{REST}' END AS bucket
      FROM documents),
m AS (SELECT bucket, sum(strlen(text))::DOUBLE AS mass, any_value(weight) AS weight FROM d JOIN w USING (bucket)
      GROUP BY bucket HAVING sum(strlen(text)) > 0),
r AS (SELECT bucket, weight * (SELECT sum(mass) FROM m) / ((SELECT sum(weight) FROM m) * mass) AS rate FROM m
      WHERE weight > 0),
p AS (SELECT bucket, rate, greatest(1, ceil(rate / {PIECE}))::INT AS pieces FROM r),
pm AS (SELECT *, rate / pieces AS mean FROM p),
cdf(bucket, k, mean, p, c) AS (
  SELECT bucket, 0, mean, exp(-mean), exp(-mean) FROM pm
  UNION ALL SELECT bucket, k + 1, mean, p * mean / (k + 1)::DOUBLE, c + p * mean / (k + 1)::DOUBLE FROM cdf WHERE k < {TAIL}),
u AS (SELECT doc_id, text, lang, source, n_chars, d.bucket, rate, unnest(generate_series(1, pieces)) AS part
      FROM d JOIN pm USING (bucket)),
v AS (SELECT *, ('0x' || substr(md5(concat_ws(':', coalesce(doc_id::VARCHAR, 'null'), '{SEED}', part)), 1, 13))::BIGINT::DOUBLE
             / {float(1 << 52)} AS x FROM u),
n AS (SELECT doc_id, text, lang, source, n_chars, rate,
             sum((SELECT count(*) FROM cdf WHERE cdf.bucket = v.bucket AND cdf.c <= v.x)) AS repeats
      FROM v GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, unnest(generate_series(1, repeats::INT)) AS copy, repeats::INT AS repeats, rate
FROM n WHERE repeats > 0
"""
