"""Language identification with one bit-sliced Bloom filter: a lookup returns all languages that use an n-gram."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skycadence.llm import textkit as tk
from skycadence.llm.learning import MAX_BYTES, held_out, remainder
from skycadence.llm.shared import documents

PER_LANGUAGE = 300  # documents of each language that are fitted on, at most
SLOTS = 18  # log2 of the filter's number of masks
TYPICAL = 0.1  # a language's filter holds an n-gram used at least this often relative to its most frequent user
GAP = b"    "
_MUL = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77))
# Letters as they are (lower case for A-Z); all other ASCII is a gap between words.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def grams(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, start of each row): four bytes each, at every position; 0x20202020 says nothing."""
    raw = np.frombuffer(GAP.join([b"", *rows, b""]), np.uint8)
    x = _FOLD[raw].astype(np.uint32)
    g = x[:-3] << np.uint32(24)
    g |= x[1:-2] << np.uint32(16)
    g |= x[2:-1] << np.uint32(8)
    g |= x[3:]
    lengths = np.array([len(r) + len(GAP) for r in rows], np.int64)
    return g[:int(lengths.sum())], np.concatenate([[0], np.cumsum(lengths)[:-1]]) if rows else lengths


def slots(g: np.ndarray) -> Iterator[np.ndarray]:
    for mul in _MUL:
        h = g * mul
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        yield h >> np.uint32(32 - SLOTS)


@dataclass
class Filters:
    names: list[str]  # most frequent first
    planes: list[np.ndarray]  # masks of 64 languages each, in the narrowest type
    false_rate: np.ndarray

    def predict(self, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, score): hit counts, less the hits a filter gives by chance."""
        g, start = grams(rows)
        seen = g != 0x20202020
        n = np.maximum(np.add.reduceat(seen, start, dtype=np.int64), 1)
        where = list(slots(g))
        hits = np.zeros((len(rows), len(self.names)))
        for k, plane in enumerate(self.planes):
            mask = plane[where[0]]
            for other in where[1:]:
                mask &= plane[other]
            mask *= seen
            for bit in range(min(64, len(self.names) - 64 * k)):
                hits[:, 64 * k + bit] = np.add.reduceat((mask >> plane.dtype.type(bit)) & plane.dtype.type(1), start, dtype=np.int64)
        share = np.clip((hits / n[:, None] - self.false_rate) / (1 - self.false_rate), 0, 1)
        best = share.argmax(axis=1)
        total = share.sum(axis=1)
        top = np.take_along_axis(share, best[:, None], axis=1)[:, 0]
        return best, np.where(total > 0, top / np.maximum(total, 1e-12), 1 / len(self.names))


def fit(texts: list[str], langs: list[str]) -> Filters:
    texts = [t.encode() for t in texts]
    count = {}
    for name in sorted(set(langs)):
        g, _ = grams([t for t, x in zip(texts, langs) if x == name])
        kinds, n = np.unique(g[g != 0x20202020], return_counts=True)
        count[name] = (kinds, n / max(1, n.sum()))
    names = sorted(count, key=lambda x: (-langs.count(x), x))
    kinds = np.unique(np.concatenate([k for k, _ in count.values()]))
    most = np.zeros(len(kinds))
    for k, p in count.values():
        at = np.searchsorted(kinds, k)
        most[at] = np.maximum(most[at], p)
    planes, false = [], []
    for k in range(0, len(names), 64):
        part = names[k:k + 64]
        kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if np.dtype(t).itemsize * 8 >= len(part))
        plane = np.zeros(1 << SLOTS, kind)
        for bit, name in enumerate(part):
            g, p = count[name]
            g = g[p >= TYPICAL * most[np.searchsorted(kinds, g)]]
            for where in slots(g):
                plane[np.unique(where)] |= kind(1 << bit)
            false.append(float(((plane >> kind(bit)) & kind(1)).mean()) ** len(_MUL))
        planes.append(plane)
    return Filters(names, planes, np.minimum(np.array(false), 0.99))


def training_rows(docs: DataFrame, modulus: int, rest: int, per_language: int) -> DataFrame:
    """Bounded sample per language, by hash of the id, outside the held-out remainder."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(modulus) != rest)
                       & (F.octet_length("text") <= MAX_BYTES))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = known.select("doc_id", "lang").withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_language)
    return known.select("doc_id", "lang", "text").join(F.broadcast(picked.select("doc_id").distinct()), "doc_id")


def identify(docs: DataFrame, modulus: int = 4, rest: int = 2, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row, from the whole text alone.

    Fitted on at most `per_language` documents of each non-NULL language whose crc32(doc_id) % modulus is not `rest`.
    NULL text, or text without a letter, is 'und' with score 0, and so is every text where nothing can be learned. A
    text whose n-grams no language knows gets the most frequent language with an even share as score; ties go to the
    more frequent language. A NULL doc_id is not held out and not learned from; repeated ids are scored row by row.
    Other columns are not read; an empty table gives an empty result.
    """
    rows = sorted(training_rows(docs, modulus, rest, per_language).collect(), key=lambda r: (r.lang, r.doc_id, r.text))
    spread = docs.sparkSession.sparkContext.broadcast(fit([r.text for r in rows], [r.lang for r in rows]) if rows else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = spread.value
        for batch in batches:
            buf, offs = tk.utf8(batch.column("text"))
            names, scores = [], []
            for lo, hi in tk.slices(offs):
                raw = buf[offs[lo]:offs[hi]].tobytes()
                rows = [raw[a - offs[lo]:b - offs[lo]] for a, b in zip(offs[lo:hi].tolist(), offs[lo + 1:hi + 1].tolist())]
                lettered = [any(map(str.isalpha, r.decode("utf-8", "replace"))) for r in rows]
                best, score = filters.predict(rows) if filters else ([], [])
                names += [filters.names[best[k]] if filters and ok else "und" for k, ok in enumerate(lettered)]
                scores += [float(score[k]) if filters and ok else 0.0 for k, ok in enumerate(lettered)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             ["doc_id", "lang_pred", "score"])

    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out(modulus, rest).alias("held_out"), "lang_pred", "score")


def op6_bitmask_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))
