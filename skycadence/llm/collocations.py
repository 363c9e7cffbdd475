"""Phrase collocations: phrases grow from counted prefixes, best bounds first, until the top of each language is settled.

Words and pairs are counted by 64-bit keys first, then those whose key occurs often enough by their text, then triples. A triple (1, 2, 3) can occur no more often than the
pairs it is made of, so with f12 and f23 counted its score is at most f12 / f1 and at most f23 / f3. Those bounds order
the frontier: a round admits the triples whose bounds reach a threshold per language, and those that may drop a pair whose
own score reaches it. The threshold sinks until enough phrases at or above it survive; whatever was not admitted then
scores below all of them, ties included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skycadence.llm.filters import flags, key_filter
from skycadence.llm.shared import documents, join_hot, written
from skycadence.llm.textkit import LOWER, scramble, slices, span_hashes, utf8, words

TOP, LEAST, UNIT = 2000, 10, 1_000_000
SLICE = 1 << 22
# Separators of pieces, [.,;:!?\x0A-\x0D], and of words, [\x20\x09].
PIECE = np.zeros(256, np.int32)
PIECE[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 1
WORD = PIECE == 0
WORD[[9, 32]] = False
# What a filter's slot says of a phrase.
FREQUENT, PREFIX, SUFFIX, RANKED = 1, 2, 4, 8

_rng = np.random.default_rng(20250611)
_ONE, _TWO = (t[LOWER] for t in _rng.integers(1, 1 << 63, (2, 256), dtype=np.uint64) | np.uint64(1))
_PLACE = _rng.integers(1, 1 << 63, 4, dtype=np.uint64) | np.uint64(1)


class _Words:
    """The words of a slice of rows, by occurrence: place, language, whether the next one follows in its piece, and a key."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, lang: np.ndarray, seeds: np.ndarray):
        self.buf = LOWER[buf]
        self.s, self.e, first = words(self.buf, offs, WORD)
        row = np.repeat(np.arange(len(lang), dtype=np.int32), np.diff(first))
        self.lang = lang[row]
        ends = np.cumsum(PIECE[self.buf], dtype=np.int32)
        self.joined = (row[1:] == row[:-1]) & (ends[self.s[1:]] == ends[self.e[:-1] - 1])
        none = np.zeros(0, np.uint64)
        self.key = scramble(span_hashes(self.buf, self.s, self.e, _ONE) + seeds[self.lang]) if len(row) else none

    def counted(self, grams: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Texts, languages and counts of the distinct phrases among rows of word occurrences.

        Words are numbered by their keys; a second hash makes sure that equal keys are equal words."""
        used, inside = np.unique(grams.reshape(-1), return_inverse=True)
        one = self.key[used]
        _, at, number = np.unique(one, return_index=True, return_inverse=True)
        two = span_hashes(self.buf, self.s[used], self.e[used], _TWO) if len(used) else one
        if (two != two[at][number]).any():
            _, at, number = np.unique(np.stack([one, two]), axis=1, return_index=True, return_inverse=True)
        distinct, n = _distinct(number.reshape(-1).astype(np.int64)[inside.reshape(-1)].reshape(grams.shape), max(len(at), 1))
        occurrence = used[at][distinct] if len(used) else distinct
        return self._texts(occurrence), self.lang[occurrence[:, 0]], n

    def _texts(self, occurrence: np.ndarray) -> pa.Array:
        """Texts of phrases, a row of word occurrences each; words are parted by one space."""
        n, k = occurrence.shape
        if not n:
            return pa.array([], pa.string())
        start = self.s[occurrence].reshape(-1)
        size = self.e[occurrence].reshape(-1) - start + 1
        ends = np.cumsum(size)
        out = self.buf[np.minimum(np.arange(ends[-1]) + np.repeat(start - (ends - size), size), len(self.buf) - 1)]
        out[ends - 1] = 32
        keep = np.ones(len(out), bool)
        keep[ends[k - 1::k] - 1] = False  # no space after the last word
        offsets = np.concatenate([[0], np.cumsum(size.reshape(n, k).sum(axis=1) - 1)]).astype(np.int64)
        return pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(out[keep])).cast(pa.string())


def _distinct(grams: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of word numbers below `size`, and how often each occurs; nothing is hashed."""
    head, heads = grams[:, 0], None
    for k in range(1, grams.shape[1]):
        if k > 1 and size ** 3 >= 1 << 62:
            heads, head = np.unique(head, return_inverse=True)
        head = head * size + grams[:, k]
    keys, n = np.unique(head, return_counts=True)
    out = np.empty((len(keys), grams.shape[1]), np.int64)
    for k in range(grams.shape[1] - 1, 0, -1):
        out[:, k] = keys % size
        keys = keys // size
        if k == 2 and heads is not None:
            keys = heads[keys]
    out[:, 0] = keys
    return out, n


def _pair(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return scramble(one * _PLACE[0] + two * _PLACE[1])


def _seeds(langs: list[str]) -> np.ndarray:
    raws = [np.frombuffer(x.encode() + b"\x00", np.uint8) for x in langs]
    return np.array([span_hashes(raw, np.zeros(1, np.int64), np.array([len(raw)]), _TWO)[0] for raw in raws], np.uint64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Words, list[str]]]:
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        names, of_row = langs.dictionary.to_pylist(), langs.indices.to_numpy()
        seeds = _seeds(names)
        buf, offs = utf8(batch.column(1))
        for lo, hi in slices(offs, SLICE):
            yield _Words(buf[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo], of_row[lo:hi], seeds), names


def _frequent_keys(docs: DataFrame) -> DataFrame:
    """(key, a): 64-bit keys of words and of pairs that occur LEAST times; different phrases may share one."""
    def keys(batches):
        for w, _ in _slices(batches):
            for some in (w.key, _pair(w.key[:-1][w.joined], w.key[1:][w.joined])):
                key, n = np.unique(some, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])
    return docs.mapInArrow(keys, "key long, n long").groupBy("key").agg(F.sum("n").alias("a")).where(F.col("a") >= LEAST)


def _phrases(docs: DataFrame, filters, triples: bool) -> DataFrame:
    """(lang, phrase, a): exact counts of the words and pairs, or of the triples, that the filter admits.

    With the words comes one row for each language whose phrase is NULL: the number of all its words."""
    def count(batches):
        table = np.frombuffer(filters.value, np.uint8)
        for w, names in _slices(batches):
            found = []
            at = np.flatnonzero(w.joined)
            pair = np.zeros(len(w.key), np.uint8)
            pair[at] = flags(table, _pair(w.key[at], w.key[at + 1]))
            if triples:
                at = at[:-1][np.diff(at) == 1]
                one, two = pair[at], pair[at + 1]
                at = at[(one & two & FREQUENT != 0) & (((one & PREFIX != 0) & (two & SUFFIX != 0)) | ((one | two) & RANKED != 0))]
                found.append(w.counted(at[:, None] + np.arange(3)))
            else:
                found.append((pa.nulls(len(names), pa.string()), np.arange(len(names)), np.bincount(w.lang, minlength=len(names))))
                known = flags(table, w.key) & FREQUENT != 0
                found.append(w.counted(np.flatnonzero(known)[:, None]))
                at = at[known[at] & known[at + 1] & (pair[at] & FREQUENT != 0)]
                found.append(w.counted(at[:, None] + np.arange(2)))
            for texts, lang, n in found:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(lang)), texts, pa.array(n.astype(np.int64))],
                                                 ["lang", "phrase", "n"])
    found = docs.mapInArrow(count, "lang string, phrase string, n long")
    return found.groupBy("lang", "phrase").agg(F.sum("n").alias("a"))


def _keyed(pairs: DataFrame, marks: Column) -> DataFrame:
    """(key, flag) of pairs of words."""
    def keys(batches):
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            seeds = _seeds(names.dictionary.to_pylist())[names.indices.to_numpy()]
            buf, offs = utf8(batch.column(1))
            s, e, _ = words(buf, offs, WORD)
            word = scramble(span_hashes(buf, s, e, _ONE) + np.repeat(seeds, 2))
            yield pa.RecordBatch.from_arrays([pa.array(_pair(word[::2], word[1::2]).view(np.int64)), batch.column(2)], ["key", "flag"])
    return pairs.select("lang", "phrase", marks.cast("long").alias("flag")).mapInArrow(keys, "key long, flag long")


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)) in exact decimals: counts up to 1e15 fit."""
    return F.expr(f"(cast({UNIT} as decimal(7,0)) * cast(cast({a} as decimal(15,0)) * cast({a} as decimal(15,0)) as decimal(31,0)))"
                  f" div cast(cast({left} as decimal(19,0)) * cast({right} as decimal(19,0)) as decimal(38,0))")


def _word(k: int) -> Column:
    return F.split_part("phrase", F.lit(" "), F.lit(k))


def _thresholds(pairs: DataFrame, langs: DataFrame, wanted: int) -> DataFrame:
    """(lang, least): a score that about `wanted` pairs of the language reach; 0 where it has no more.

    Scores are counted by powers of 2 ** (1/8), 160 cells a language at most."""
    cell = F.floor(F.log2(F.col("score") + 1) * 8).cast("int")
    sizes = pairs.groupBy("lang", cell.alias("cell")).agg(F.count("*").alias("n"))
    above = F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("cell")))
    reached = sizes.withColumn("above", above).where(F.col("above") >= wanted).groupBy("lang").agg(F.max("cell").alias("cell"))
    least = F.coalesce(F.floor(F.pow(F.lit(2.0), F.col("cell") / 8) - 1), F.lit(0)).cast("long")
    return langs.join(reached, "lang", "left").select("lang", least.alias("least"))


def _triples(docs: DataFrame, pairs: DataFrame, entries: int) -> DataFrame:
    """Triples that the bounds admit, with the counts of their parts; pairs carry the threshold of their language."""
    marks = (F.lit(FREQUENT) + F.when(F.floor(F.col("a") * F.lit(1.0) * UNIT / F.col("l")) + 1 >= F.col("least"), PREFIX).otherwise(0)
             + F.when(F.floor(F.col("a") * F.lit(1.0) * UNIT / F.col("r")) + 1 >= F.col("least"), SUFFIX).otherwise(0)
             + F.when(F.col("score") >= F.col("least"), RANKED).otherwise(0))
    counted = _phrases(docs, key_filter(_keyed(pairs, marks), entries), True).where(F.col("a") >= LEAST)
    counted = counted.select("*", F.concat_ws(" ", _word(1), _word(2)).alias("head"), F.concat_ws(" ", _word(2), _word(3)).alias("tail"))
    parts = pairs.select("lang", "phrase", "a", "l", "r")
    heads = parts.select("lang", F.col("phrase").alias("head"), F.col("a").alias("f12"), F.col("l").alias("f1"))
    tails = parts.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("f23"), F.col("r").alias("f3"))
    both = join_hot(join_hot(counted, heads, ["lang", "head"]), tails, ["lang", "tail"])
    one, two = _score("a", "f1", "f23"), _score("a", "f12", "f3")
    both = both.select("lang", "phrase", "a", "head", "tail", "f1", "f23", "f12", "f3", one.alias("one"), two.alias("two"))
    first = F.col("one") <= F.col("two")
    return both.select("lang", "phrase", "a", F.when(first, F.col("f1")).otherwise(F.col("f12")).alias("l"),
                       F.when(first, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("one", "two").alias("score"), "head", "tail")


def _first(rows: DataFrame, top: int) -> DataFrame:
    """The first `top` rows of each language; ranks are taken in 64 parts of a language before they meet."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    few = rows.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """The `top` best-scoring phrases of 2 and 3 words of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase counts from 10 occurrences on. Its score is that of its weakest cut (the first one on ties); a pair goes when
    a triple around it occurs at least half as often. Order: score, then count, both falling, then the phrase's bytes.

    Texts are read whole; NULL and empty texts have no words, a NULL lang is `und`, repeated rows count again, an empty
    table or one without phrases gives no rows, and columns other than text and lang are not read. Phrases meet as
    strings; only inside a slice of some megabytes words are told apart by two 64-bit hashes. A word or phrase with any
    share of all occurrences is one row per task before it is shuffled.
    """
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    frequent = written(_frequent_keys(docs), "keys")
    known = key_filter(frequent.select("key", F.lit(FREQUENT).alias("flag")), frequent.count())
    counted = written(_phrases(docs, known, False).where(F.col("phrase").isNull() | (F.col("a") >= LEAST)), "phrases")
    known.destroy()
    langs = counted.where(F.col("phrase").isNull()).select("lang", F.col("a").alias("n"))
    is_pair = F.instr("phrase", " ") > 0
    single = counted.where(~is_pair)
    left = single.select("lang", F.col("phrase").alias("one"), F.col("a").alias("l"))
    right = single.select("lang", F.col("phrase").alias("two"), F.col("a").alias("r"))
    pairs = counted.where(is_pair).select("*", _word(1).alias("one"), _word(2).alias("two"))
    pairs = join_hot(join_hot(pairs, left, ["lang", "one"]), right, ["lang", "two"])
    pairs = written(pairs.select("lang", "phrase", "a", "l", "r", _score("a", "l", "r").alias("score")), "pairs")

    open_langs, settled, wanted = langs.select("lang"), None, 2 * top
    while True:
        least = written(_thresholds(join_hot(pairs, open_langs, ["lang"]), open_langs, wanted), "least")
        here = written(join_hot(pairs, least, ["lang"]), "frontier")  # settled languages are not in the filter and count nothing
        triples = written(_triples(docs, here, here.count()), "triples")
        over = triples.select("lang", F.explode(F.array("head", "tail")).alias("phrase"), F.col("a").alias("longer"))
        over = over.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
        ranked = here.where("score >= least").drop("least")
        alone = join_hot(ranked, over, ["lang", "phrase"], "left").where("longer is null or 100 * longer < 50 * a")
        alive = alone.select("lang", "phrase", "a", "l", "r", "score").unionByName(
            join_hot(triples, least, ["lang"]).where("score >= least").select("lang", "phrase", "a", "l", "r", "score"))
        best = written(_first(alive, top), "best")
        settled = best if settled is None else settled.join(open_langs, "lang", "left_anti").unionByName(best)
        reached = best.groupBy("lang").agg(F.max("rank").alias("reached"))
        open_langs = written(least.join(reached, "lang", "left").where(
            (F.col("least") > 0) & (F.coalesce("reached", F.lit(0)) < top)).select("lang"), "open")
        if open_langs.isEmpty():
            break
        wanted *= 4
    return settled.join(langs, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS k,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, k, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece,
             generate_subscripts(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]'), 1) AS j FROM d),
w AS (SELECT lang, k, j, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
      FROM (SELECT lang, k, j, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p)),
g AS (SELECT lang, w, lead(w, 1) OVER s AS w2, lead(w, 2) OVER s AS w3 FROM w WINDOW s AS (PARTITION BY k, j ORDER BY i)),
u AS (SELECT lang, w, count(*) AS f FROM g GROUP BY ALL),
tot AS (SELECT lang, count(*) AS n FROM g GROUP BY 1),
b AS (SELECT lang, w, w2, count(*) AS f FROM g WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT lang, w, w2, w3, count(*) AS f FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
longer AS (SELECT lang, x, y, max(f) AS f FROM (SELECT lang, w AS x, w2 AS y, f FROM c UNION ALL SELECT lang, w2, w3, f FROM c) GROUP BY ALL),
two AS (SELECT b.lang, b.w || ' ' || b.w2 AS phrase, b.f AS a, x.f AS l, y.f AS r,
               1000000::HUGEINT * b.f * b.f // (x.f::HUGEINT * y.f) AS score
        FROM b JOIN u x ON x.lang = b.lang AND x.w = b.w JOIN u y ON y.lang = b.lang AND y.w = b.w2
        LEFT JOIN longer o ON o.lang = b.lang AND o.x = b.w AND o.y = b.w2 WHERE o.f IS NULL OR 100 * o.f < 50 * b.f),
cuts AS (SELECT c.lang, c.w || ' ' || c.w2 || ' ' || c.w3 AS phrase, c.f AS a, x.f AS f1, t.f AS f23, h.f AS f12, y.f AS f3,
                1000000::HUGEINT * c.f * c.f // (x.f::HUGEINT * t.f) AS s1, 1000000::HUGEINT * c.f * c.f // (h.f::HUGEINT * y.f) AS s2
         FROM c JOIN u x ON x.lang = c.lang AND x.w = c.w JOIN u y ON y.lang = c.lang AND y.w = c.w3
         JOIN b h ON h.lang = c.lang AND h.w = c.w AND h.w2 = c.w2 JOIN b t ON t.lang = c.lang AND t.w = c.w2 AND t.w2 = c.w3),
both_ AS (SELECT * FROM two UNION ALL SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN f1 ELSE f12 END,
                 CASE WHEN s1 <= s2 THEN f23 ELSE f3 END, least(s1, s2) FROM cuts),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM both_)
SELECT z.lang, z.rank, z.phrase, z.a, z.l, z.r, tot.n, z.score::BIGINT AS score FROM z JOIN tot USING (lang) WHERE rank <= 2000
"""
