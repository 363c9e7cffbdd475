"""Benchmark decontamination: a random-walk embedding turns edit distance into Hamming distance for bit-sampling LSH."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skycadence.llm import textkit as tk
from skycadence.llm.shared import documents

SIMILARITY = 0.8  # 1 - edits / words of the item
WALKS, SAMPLES, COORDINATES = 10, 8, 3  # walks, samplings of each walk, coordinates of a sampling
HITS = 1 << 21  # (place, item) pairs that are counted at once
BLOCK_BYTES = 16 << 20  # text of the benchmark that one pass holds in each task
_PLACES = np.random.default_rng(3).integers(1, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)


def folded(buf: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and for the accented capitals of two bytes that start with 0xC3."""
    low = tk.LOWER[buf]
    at = np.flatnonzero(buf[:-1] == 0xC3) + 1
    at = at[(buf[at] >= 0x80) & (buf[at] <= 0x9E) & (buf[at] != 0x97)]
    low[at] += 32
    return low


def word_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words, index of each row's first word): letters and digits only, without case."""
    low = folded(buf)
    s, e, first = tk.words(low, offs, tk.WORD)
    return tk.span_hashes(low, s, e, tk.BYTE), first


def edits(n: int, similarity: float) -> int:
    return int(np.floor((1 - similarity) * n + 1e-9))


def _grams(words: np.ndarray, q: int) -> np.ndarray:
    n = len(words) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n] * _PLACES[0]
    for k in range(1, q):
        h = h + words[k:k + n] * _PLACES[k]
    return tk.scramble(h)


def walk(words: np.ndarray, start: np.ndarray, end: np.ndarray, steps: int, seed: int) -> np.ndarray:
    """The embedding: at step j put out the word under the cursor, and move on if the coin of (j, word) says so.

    One column per step; words past the end are 0. Equal stretches give equal output, and after an edit two walks
    fall into step again after a random time."""
    coins = np.random.default_rng(seed).integers(1, 1 << 63, steps, dtype=np.uint64) | np.uint64(1)
    padded = np.append(words, np.uint64(0))
    at, out = start.copy(), np.empty((steps, len(start)), np.uint64)
    for j in range(steps):
        out[j] = padded[np.where(at < end, at, len(words))]
        at += ((out[j] * coins[j]) >> np.uint64(63)).astype(np.int64)
    return out


class SizeClass:
    """Items of similar length (a factor of two at most): their phrases and their LSH tables."""

    def __init__(self, items: list[tuple[int, np.ndarray]], similarity: float, number: int):
        self.items, self.number = items, number
        sizes = [len(w) for _, w in items]
        self.low, self.high = min(sizes), max(sizes)
        self.slack = edits(self.high, similarity)

        def shared(q):  # phrases of q words that any window within the edits must share with its item
            return min(n - q + 1 - q * edits(n, similarity) for n in sizes)

        self.q = next((q for q in (3, 2) if shared(q) >= 1), 1)
        self.need = max(1, shared(self.q))
        self.least = np.array([max(1, n - self.q + 1 - self.q * edits(n, similarity)) for n in sizes])
        self.longest = np.array([n + edits(n, similarity) for n in sizes])
        held = [np.unique(_grams(w, self.q)) for _, w in items]
        phrases, holder = np.concatenate(held), np.repeat(np.arange(len(items)), [len(h) for h in held])
        order = np.argsort(phrases, kind="stable")
        self.phrases, first = np.unique(phrases[order], return_index=True)
        self.holders, self.holder_at = holder[order], np.append(first, len(order))
        self.steps = 2 * self.low
        rng = np.random.default_rng(100 + number)
        self.samples = [[np.sort(rng.choice(self.steps, min(COORDINATES, self.steps), replace=False)) for _ in range(SAMPLES)]
                        for _ in range(WALKS)]
        words = np.concatenate([w for _, w in items])
        ends = np.cumsum(sizes)
        self.tables = []
        for w in range(WALKS):
            out = walk(words, ends - sizes, ends, self.steps, self.seed(w))
            for picked in self.samples[w]:
                keys = self._keys(out, picked)
                order = np.argsort(keys, kind="stable")
                self.tables.append((keys[order], order))

    def seed(self, w: int) -> int:
        return 1000 * self.number + w

    @staticmethod
    def _keys(out: np.ndarray, picked: np.ndarray) -> np.ndarray:
        h = out[picked[0]] * _PLACES[0]
        for k, j in enumerate(picked[1:], 1):
            h = h + out[j] * _PLACES[k]
        return h

    def phrase_of(self, words: np.ndarray) -> np.ndarray:
        """For each word the benchmark phrase that starts there, or -1."""
        out, grams = np.full(len(words), -1), _grams(words, self.q)
        if len(grams):
            near = np.minimum(np.searchsorted(self.phrases, grams), len(self.phrases) - 1)
            out[:len(grams)] = np.where(self.phrases[near] == grams, near, -1)
        return out

    def windows(self, phrase: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, end of row) of the windows with as many benchmark phrases as the edits must leave. Nothing is lost."""
        words, hit = phrase, np.append(0, np.cumsum(phrase >= 0))
        end = np.repeat(first[1:], np.diff(first))
        at = np.arange(len(words))
        reach = np.minimum(at + self.high + self.slack, end)
        start = np.flatnonzero(hit[reach] - hit[at] >= self.need)
        return start, end[start]

    def counted(self, phrase: np.ndarray, first: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[np.ndarray]:
        """(place, item) pairs where as many phrases of that item as its edits must leave start within its reach.

        Each edit breaks q phrases at most, so every stretch within the edits has a pair: nothing is lost."""
        inside = np.bincount(start, minlength=len(phrase) + 1) - np.bincount(
            np.minimum(start + self.high + self.slack, end), minlength=len(phrase) + 1)
        place = np.flatnonzero((phrase >= 0) & (np.cumsum(inside[:-1]) > 0))
        many = np.diff(self.holder_at)[phrase[place]]
        total = np.append(0, np.cumsum(many))
        lo = 0
        while lo < len(place):
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + HITS, "right")) - 1)
            top = int(np.searchsorted(place, place[hi - 1] + self.high + self.slack, "right"))
            n = many[lo:top]
            which = np.repeat(self.holder_at[phrase[place[lo:top]]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            item, at = self.holders[which], np.repeat(place[lo:top], n)
            order = np.argsort(item, kind="stable")
            item, at = item[order], at[order]
            last = np.arange(len(item)) + self.least[item] - 1
            k = np.flatnonzero(last < len(item))
            last = last[k]
            row = np.searchsorted(first, at, "right")
            k = k[(item[last] == item[k]) & (row[last] == row[k]) & (at[last] - at[k] <= self.longest[item[k]] - self.q)]
            yield np.column_stack([at[k], item[k]])
            lo = hi

    def candidates(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Distinct (start, item) pairs that share a sampling of a walk, or enough phrases.

        Walks lose step over many insertions and deletions, the more so the longer the item; the phrases do not."""
        phrase = self.phrase_of(words)
        start, end = self.windows(phrase, first)
        found = [np.zeros((0, 2), np.int64), *self.counted(phrase, first, start, end)]
        for lo in range(0, len(start), 1 << 14):
            s, e = start[lo:lo + (1 << 14)], end[lo:lo + (1 << 14)]
            table = iter(self.tables)
            for w in range(WALKS):
                out = walk(words, s, e, self.steps, self.seed(w))
                for picked in self.samples[w]:
                    keys, order = next(table)
                    own = self._keys(out, picked)
                    a, b = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
                    at = np.flatnonzero(b > a)
                    n = (b - a)[at]
                    which = np.repeat(a[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    found.append(np.column_stack([np.repeat(s[at], n), order[which]]))
        return np.unique(np.concatenate(found), axis=0)


def closest(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(edits, end) of the stretch of `text` closest to the item, by bit-parallel dynamic programming over words."""
    n = len(item)
    masks: dict[int, int] = {}
    for k, word in enumerate(item.tolist()):
        masks[word] = masks.get(word, 0) | 1 << k
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score, best, at = full, 0, n, n, 0
    for j, word in enumerate(text.tolist(), 1):
        eq = masks.get(word, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | ~(diagonal | plus) & full, plus & diagonal
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | ~(diagonal | up) & full, up & diagonal
        if score < best:
            best, at = score, j
    return best, at


class Benchmark:
    """The items of one block, in classes of sizes."""

    def __init__(self, rows: list[tuple[int, str]], similarity: float):
        self.similarity = similarity
        buf, offs = tk.utf8(pa.array([text for _, text in rows], pa.large_string()))
        words, first = word_hashes(buf, offs)
        items = [(item, words[a:b]) for (item, _), a, b in zip(rows, first[:-1], first[1:]) if b > a]
        by_size: dict[int, list] = {}
        for item, w in items:
            by_size.setdefault(len(w).bit_length(), []).append((item, w))
        self.classes = [SizeClass(group, similarity, k) for k, group in sorted(by_size.items())]

    def matches(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, edits, first word of the closest stretch's last word) for every item in reach of a row."""
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for group in self.classes:
            pairs = group.candidates(words, first)
            pairs = pairs[np.lexsort((pairs[:, 0], pairs[:, 1]))]
            rows = np.searchsorted(first, pairs[:, 0], "right") - 1
            gap = np.ones(len(pairs), bool)
            gap[1:] = (pairs[1:, 1] != pairs[:-1, 1]) | (rows[1:] != rows[:-1]) | (pairs[1:, 0] - pairs[:-1, 0] > group.high)
            at = np.flatnonzero(gap)
            for a, b in zip(at, np.append(at[1:], len(pairs))):
                row, (item, w) = int(rows[a]), group.items[pairs[a, 1]]
                n, most = len(w), edits(len(w), self.similarity)
                low = max(first[row], pairs[a, 0] - most - n)
                high = min(first[row + 1], pairs[b - 1, 0] + 2 * n + most)
                d, end = closest(w, words[low:high])
                if d <= most:
                    best[row, item] = min(best.get((row, item), (n, 0)), (d, int(low + end - first[row])))
        for (row, item), (d, end) in sorted(best.items()):
            yield row, item, d, end


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, edits, end_word): each benchmark item that a document's text contains, and how closely.

    Words are runs of letters and digits without case. A document contains an item if some stretch of its words is
    within floor((1 - similarity) * n) word edits of the item's n words; `edits` is the smallest number found and
    `end_word` the number of words up to that stretch's end. Windows of the item's size that share as many phrases with
    the benchmark as that many edits must leave are embedded by walks. Items that share a sampled key with a window, and
    items of which as many phrases stand together as their own edits must leave, are verified exactly over the whole
    neighbourhood. The phrases alone propose every stretch within the edits, so recall is 1 whatever the edits are.

    Items or texts that are NULL, empty or without words match nothing; the same item_id with two texts matches by
    either; a NULL item_id is left out and a NULL doc_id is reported as NULL; rows that repeat a doc_id are searched
    one by one and reported once, with the best match. The benchmark is held in blocks of BLOCK_BYTES, one pass each.
    An empty table on either side gives an empty result. Other columns are not read.
    """
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = 1 + 2 * size // BLOCK_BYTES if size > BLOCK_BYTES else 1
    passes = [_matches(docs, items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k), similarity) for k in range(parts)]
    best = F.min(F.struct("edits", "end_word")).alias("best")
    return reduce(DataFrame.union, passes).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.edits", "best.end_word")


def _matches(docs: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    rows = sorted((r.item_id, r.text) for r in items.collect())  # one block
    spread = docs.sparkSession.sparkContext.broadcast(Benchmark(rows, similarity) if rows else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = spread.value
        for batch in batches:
            found, ids = [], batch.column("doc_id").to_pylist()
            buf, offs = tk.utf8(batch.column("text"))
            for lo, hi in tk.slices(offs):
                if held:
                    words, first = word_hashes(buf[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo])
                    found += [(ids[lo + row], item, d, end) for row, item, d, end in held.matches(words, first)]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)],
                                             ["doc_id", "item_id", "edits", "end_word"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, item_id long, edits int, end_word long")


def decontaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Rows and columns of `docs` without the documents that contain a benchmark item; a NULL doc_id stays."""
    found = contaminated(docs, benchmark, similarity).select("doc_id").where("doc_id IS NOT NULL").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def op5_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
