"""Near-duplicate documents: SetSketch registers propose pairs, full shingle sets confirm them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skycadence.llm import textkit as tk
from skycadence.llm.components import components
from skycadence.llm.shared import documents, join_hot, written

BASE, RATE, TOP = 1.005, 20.0, 65_534  # register scale: base, rate and largest value
BANDS, ROWS = 32, 4  # a pair at similarity 0.8 shares no band with probability 5e-8
REGISTERS = BANDS * ROWS
DOUBT = 15.0  # log-likelihood a pair may lack at the threshold: e^-15 of the true pairs are lost
FEW_EQUAL = 0.6  # of the registers that are equal at the threshold: fewer are 7 standard deviations off
TURNS = 2  # rounds with drawn centres before blocks are compared
BLOCK = 256  # members of a bucket compared at once
_rng = np.random.default_rng(7)
_MUL = _rng.integers(1, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
_END = np.uint32(0x85EBCA6B)


def registers(hashes: np.ndarray) -> np.ndarray:
    """Register i is floor(1 - log_b of the smallest exponential variable of its stream), truncated to [0, TOP].

    The smallest variable comes from the smallest uniform number of the stream, so one logarithm per register is
    enough. The maximum of two sketches' registers is the sketch of the union."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 512):
        h = x[k:k + 512, None] * _MUL
        h ^= h >> np.uint32(15)
        h *= _END
        h += _ADD
        np.minimum(low, h.min(axis=0), out=low)
    smallest = -np.log1p(-(low + 0.5) / 2.0 ** 32) / RATE
    return np.clip(np.floor(1 - np.log(smallest) / np.log(BASE)), 0, TOP).astype(">u2")


def merged(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.maximum(one, other)


_GRID = np.linspace(0.0, 1.0, 101)


def log_likelihoods(larger: np.ndarray, smaller: np.ndarray, equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Joint log-likelihood of the register comparisons for each similarity of the grid: one row per pair."""
    u, v = (n / (n + m))[:, None], (m / (n + m))[:, None]
    j = np.minimum(_GRID[None, :], np.minimum(u / v, v / u))

    def chance(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = chance(u - v * j), chance(v - u * j)
    tiny = 1e-12
    return (larger[:, None] * np.log(np.maximum(up, tiny)) + smaller[:, None] * np.log(np.maximum(down, tiny))
            + equal[:, None] * np.log(np.maximum(1 - up - down, tiny)))


def similarity(larger, smaller, equal, n, m) -> np.ndarray:
    """Maximum-likelihood estimate of the Jaccard similarity."""
    return _GRID[log_likelihoods(larger, smaller, equal, n, m).argmax(axis=1)]


def plausible(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs of register rows that may reach the threshold: those below it beyond any doubt are left out.

    At the threshold about that share of the registers is equal; a pair with less than 0.6 of it is 7 standard
    deviations off and is left out before the likelihood is worked out."""
    keep = (a == b).sum(axis=1) >= FEW_EQUAL * threshold * a.shape[1]
    at = np.flatnonzero(keep)
    a, b, n, m = a[at], b[at], n[at], m[at]
    larger, smaller = (a > b).sum(axis=1), (a < b).sum(axis=1)
    ll = log_likelihoods(larger, smaller, a.shape[1] - larger - smaller, n.astype(float), m.astype(float))
    keep[at] = ll[:, _GRID >= threshold - 1e-9].max(axis=1, initial=-np.inf) >= ll.max(axis=1, initial=-np.inf) - DOUBT
    return keep


def _row_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    buf, offs = tk.utf8(column)
    for lo, hi in tk.slices(offs):
        part, cut = buf[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        s, e, first = tk.words(part, cut)
        yield from tk.shingles(tk.span_hashes(part, s, e), first, width)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, sig_a, sig_b, regs): the size, a 128-bit signature and the registers of each set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, b, regs = [], [], [], []
            for found in _row_sets(batch.column("text"), width):
                n.append(len(found))
                a.append(found.sum(dtype=np.uint64))
                b.append(tk.scramble(found ^ np.uint64(0x5BD1E995)).sum(dtype=np.uint64))
                regs.append(registers(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(np.array(a, np.uint64).view(np.int64)),
                 pa.array(np.array(b, np.uint64).view(np.int64)), pa.array(regs, pa.binary())],
                ["doc_id", "n_shingles", "sig_a", "sig_b", "regs"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, sig_a long, sig_b long, regs binary")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, sig_a, sig_b, members): the whole set of 64-bit shingle hashes, sorted, as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_row_sets(batch.column("text"), width))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], ["id", "members"])

    return docs.select("doc_id", "text").mapInArrow(run, "id long, members binary")


def _shared_members(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                      for x, y in zip(a, b)], dtype="int64")


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row: components of the links of similarity >= percent / 100.

    A document's set holds its distinct shingles of `width` words (lower-cased A-Z, split at [\\x20\\x09-\\x0D]); with
    fewer words the whole sequence is one shingle; without words, or NULL, it is empty and linked with nothing. Links
    are confirmed on full sets. Documents with equal sets are one node from the start. Rows that repeat a doc_id share
    its component; a NULL doc_id is linked with nothing, its component is NULL and it is kept. Other columns are not
    read. An empty table gives an empty result.

    Bands of register values make buckets. First every member of a bucket is compared with the bucket's smallest id
    only, which is linear in the bucket. A bucket whose members are then of one component is done, whatever its size;
    in the others drawn centres get TURNS more rounds of the same kind, and what is still apart after that is compared
    block by block inside tasks, on registers and then on full sets, until each pair of components is linked or has
    no likely pair left. So no link that could join two components is lost, and no bucket is expanded into its pairs.
    """
    rows = written(sketches(docs, width), "sketches")
    nodes = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = written(nodes.groupBy("sig_a", "sig_b", F.col("n_shingles").alias("n")).agg(
        F.min("doc_id").alias("id"), F.min_by("regs", "doc_id").alias("regs")), "sets")
    copies = nodes.join(reps.select("sig_a", "sig_b", F.col("id").alias("rep")), ["sig_a", "sig_b"]).where("doc_id <> rep")
    copies = copies.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))

    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")
    bands = reps.select("id", "regs", band).select("id", F.xxhash64(
        "band", F.expr(f"substring(regs, band * {2 * ROWS} + 1, {2 * ROWS})")).alias("bucket"))
    sizes = bands.groupBy("bucket").agg(F.min("id").alias("centre"), F.count("*").alias("size")).where("size > 1")
    members = written(join_hot(bands, sizes, ["bucket"]).select("bucket", "id", "centre", "size"), "buckets")

    texts = docs.select("doc_id", "text").join(members.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = written(full_sets(texts, width), "members")
    head = reps.select("id", "n", "regs")

    stars = members.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    links = written(_confirmed(_likely(stars, head, percent), sets, percent).union(copies), "links")
    labels = components(links)
    several = members.where("size > 2")  # the one pair of a bucket of two has just been compared
    for turn in range(TURNS):
        pairs = _turn(_mixed(several, labels), turn)
        more = written(_confirmed(_likely(pairs, head, percent), sets, percent), "links")
        if more.isEmpty():
            break
        labels = _joined(labels, more)
    mixed = _mixed(several, labels)
    labels = _joined(labels, written(_cross_links(mixed, head.join(sets, "id"), percent), "links"))

    labels = labels.select(F.col("id").alias("doc_id"), F.col("component").alias("component_id"))
    found = rows.select("doc_id", "n_shingles").join(labels, "doc_id", "left").withColumn(
        "component_id", F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(
        F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Rows and columns of `docs` without the documents that a near duplicate of a smaller doc_id stands for."""
    gone = near_duplicates(docs, width, percent).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def _likely(pairs: DataFrame, head: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes allow the threshold and whose registers do not rule it out."""
    @F.pandas_udf("boolean")
    def may(x: pd.Series, y: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        keep = [np.zeros(0, bool)]
        for k in range(0, len(x), 1024):
            a, b = (np.frombuffer(b"".join(z[k:k + 1024]), ">u2").reshape(-1, REGISTERS) for z in (x, y))
            keep.append(plausible(a, b, n.to_numpy()[k:k + 1024], m.to_numpy()[k:k + 1024], percent / 100))
        return pd.Series(np.concatenate(keep))

    one = head.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("regs").alias("r_a"))
    two = head.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("regs").alias("r_b"))
    both = pairs.join(one, "a").join(two, "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    return both.where(may("r_a", "r_b", "n_a", "n_b")).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    common = F.pandas_udf(_shared_members, "long")
    one = sets.select(F.col("id").alias("a"), F.col("members").alias("s_a"))
    two = sets.select(F.col("id").alias("b"), F.col("members").alias("s_b"))
    both = pairs.join(one, "a").join(two, "b")
    counted = both.select("a", "b", common("s_a", "s_b").alias("shared"),
                          ((F.octet_length("s_a") + F.octet_length("s_b")) / 8).cast("long").alias("total"))
    return counted.where(f"100 * shared >= {percent} * (total - shared)").select("a", "b").distinct()


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, id, size, component) of the buckets whose members are not of one component yet."""
    seen = members.select("bucket", "id", "size").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = seen.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    return written(join_hot(seen, mixed.select("bucket"), ["bucket"]), "mixed")


def _turn(mixed: DataFrame, turn: int) -> DataFrame:
    """Each member of a mixed bucket with one centre of another component; every bucket draws its own centre."""
    drawn = F.xxhash64("id", "bucket", F.lit(turn))
    centres = mixed.groupBy("bucket").agg(F.min_by("id", drawn).alias("centre"), F.min_by("component", drawn).alias("of"))
    return join_hot(mixed, centres, ["bucket"]).where("component <> of").select(
        F.least("centre", "id").alias("a"), F.greatest("centre", "id").alias("b")).distinct()


def _joined(labels: DataFrame, more: DataFrame) -> DataFrame:
    """Labels after more links: only components are linked, then every member takes its component's new one."""
    if more.isEmpty():
        return labels
    ends = more.select("a", "b")
    for end in ("a", "b"):
        own = labels.select(F.col("id").alias(end), F.col("component").alias("of"))
        ends = ends.join(own, end, "left").withColumn(end, F.coalesce("of", end)).drop("of")
    merged = components(ends).select("id", F.col("component").alias("into"))
    both = labels.withColumnRenamed("id", "node").join(merged, F.col("component") == F.col("id"), "left").select(
        F.col("node").alias("id"), F.coalesce("into", "component").alias("component"))
    fresh = merged.join(labels.select("id"), "id", "left_anti").select("id", F.col("into").alias("component"))
    return written(both.union(fresh), "labels")


def _cross_links(mixed: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """Links between different components of one bucket, as many as it takes to join those that have any.

    Members meet block by block; a task compares registers of different components and confirms the pairs they do not rule
    out on full sets, one member against all the others at once. It stops at the first link between two components, so it
    puts out fewer links than its blocks have members. Counting what two sets share is cheaper here than the likelihood."""
    def block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf.block == key[1]], pdf[pdf.block == key[2]]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        a, b = (np.frombuffer(b"".join(x.regs), ">u2").astype(np.uint16).reshape(-1, REGISTERS) for x in (left, right))
        n, m, ids, others = left.n.to_numpy(), right.n.to_numpy(), left.id.to_numpy(), right.id.to_numpy()
        names, codes = np.unique(np.concatenate([left.component, right.component]), return_inverse=True)
        mine, theirs, root, out = codes[:len(left)], codes[len(left):], np.arange(len(names)), []
        sets = [np.frombuffer(x, np.uint64) for x in (*left.members, *right.members)]
        cuts = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
        universe, number = np.unique(np.concatenate(sets), return_inverse=True)
        here, shift = np.zeros(len(universe), bool), cuts[len(left)]
        held, first, last = number[shift:], cuts[len(left):-1] - shift, cuts[len(left) + 1:] - shift
        for k in range(len(left)):
            able = np.flatnonzero((root[theirs] != root[mine[k]]) & (100 * np.minimum(n[k], m) >= percent * np.maximum(n[k], m)))
            able = able[(b[able] == a[k]).sum(axis=1) >= FEW_EQUAL * percent / 100 * REGISTERS]
            if not len(able):
                continue
            own = number[cuts[k]:cuts[k + 1]]
            here[own] = True
            if 4 * len(able) > len(right):
                shared = np.add.reduceat(here[held], first, dtype=np.int64)[able]
            else:
                shared = np.array([np.count_nonzero(here[held[first[x]:last[x]]]) for x in able.tolist()])
            here[own] = False
            for x in able[100 * shared >= percent * (len(own) + (last - first)[able] - shared)].tolist():
                if root[theirs[x]] != root[mine[k]]:
                    root[root == root[theirs[x]]] = root[mine[k]]
                    out.append((ids[k], others[x]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    parts = F.greatest(F.lit(1), F.ceil(F.col("size") / BLOCK)).cast("int")
    dealt = mixed.select("bucket", "id", "component", parts.alias("parts")).join(held, "id")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "component", "n", "regs", "members", "block")
    return dealt.groupBy("bucket", "i", "j").applyInPandas(block, "a long, b long").distinct()


def op2_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [ws]
             ELSE list_transform(generate_series(1, len(ws) - 3), lambda i: ws[i:i + 3]) END AS sh FROM w),
e AS (SELECT doc_id, list_distinct(sh) AS sh FROM s),
n AS (SELECT doc_id, len(sh) AS n FROM e),
x AS (SELECT doc_id, unnest(sh) AS g FROM e),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
r(id, low) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.id WHERE r.low < l.b),
m AS (SELECT id, min(low) AS low FROM r GROUP BY id)
SELECT doc_id, n AS n_shingles, low AS component_id, doc_id = low AS kept FROM n JOIN m ON m.id = doc_id
"""
