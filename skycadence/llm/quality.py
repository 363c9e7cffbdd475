"""Quality: a sparse ensemble of rules over text statistics, compiled into Spark column expressions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skycadence.llm import textkit as tk
from skycadence.llm.learning import held_out, labelled_sample, sample_of
from skycadence.llm.shared import documents

PER_CLASS = 6000  # documents of each class that are fitted on, at most
TREES, DEPTH, LEAF, BINS = 40, 3, 15, 32
STATISTICS = ("log_bytes", "log_words", "word_bytes", "letters", "capitals", "digits", "stops", "bangs", "symbols", "bars",
              "repeats", "distinct", "log_lines", "line_words", "line_copies")

_LETTER, _CAPITAL, _DIGIT, _STOP, _BANG, _SYMBOL, _BAR, _BLANK = range(1, 9)
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123] = _CLASS[128:] = _LETTER
_CLASS[65:91] = _CAPITAL
_CLASS[48:58] = _DIGIT
_CLASS[list(b".,;:?'\"()-")] = _STOP
_CLASS[list(b"!")] = _BANG
_CLASS[list(b"#$%&*@^~<>{}[]\\/_=+")] = _SYMBOL
_CLASS[list(b"|")] = _BAR
_CLASS[~tk.NOT_BLANK] = _BLANK
_NOT_NEWLINE = np.arange(256) != 10


def statistics(column: pa.Array) -> np.ndarray:
    """One row of STATISTICS per text; a text without words has zeros, and no value is ever NULL or NaN."""
    buf, offs = tk.utf8(column)
    out = np.zeros((len(offs) - 1, len(STATISTICS)))
    for lo, hi in tk.slices(offs):
        part, cut = buf[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        s, e, first = tk.words(part, cut)
        h = tk.span_hashes(part, s, e)
        ls, le, line_first = tk.words(part, cut, _NOT_NEWLINE)
        lh = tk.span_hashes(part, ls, le)
        again = np.zeros(len(h) + 1, np.int64)
        np.cumsum(np.concatenate([[False], h[1:] == h[:-1]])[:len(h)], out=again[1:])
        code = _CLASS[part]
        for r in range(hi - lo):
            a, b, n = first[r], first[r + 1], cut[r + 1] - cut[r]
            words, lines = b - a, line_first[r + 1] - line_first[r]
            if not words:
                continue
            kinds = np.bincount(code[cut[r]:cut[r + 1]], minlength=9)
            solid = n - kinds[_BLANK]
            alpha = kinds[_LETTER] + kinds[_CAPITAL]
            out[lo + r] = (
                np.log1p(n), np.log1p(words), solid / words, alpha / solid, kinds[_CAPITAL] / max(1, alpha), kinds[_DIGIT] / solid,
                kinds[_STOP] / solid, kinds[_BANG] / solid, kinds[_SYMBOL] / solid, kinds[_BAR] / solid,
                (again[b] - again[a + 1]) / words, len(np.unique(h[a:b])) / words, np.log1p(lines), words / max(1, lines),
                1 - len(np.unique(lh[line_first[r]:line_first[r + 1]])) / max(1, lines))
    return out


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, one double per statistic) for each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = statistics(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(np.ascontiguousarray(c)) for c in found.T)],
                                             ["doc_id", *STATISTICS])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, " + ", ".join(f"{c} double" for c in STATISTICS))


Rule = tuple[tuple[int, bool, float], ...]  # conditions: (statistic, above the cut or not, cut)


@dataclass
class Ensemble:
    base: float
    rules: list[Rule]
    weights: list[float]

    def logit(self) -> Column:
        total = F.lit(self.base)
        for rule, weight in zip(self.rules, self.weights):
            holds = F.lit(True)
            for k, above, cut in rule:
                holds = holds & ((F.col(STATISTICS[k]) > cut) if above else (F.col(STATISTICS[k]) <= cut))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return total

    def score(self) -> Column:
        return 1 / (1 + F.exp(-self.logit()))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    found = np.ones(len(x), bool)
    for k, above, cut in rule:
        found &= (x[:, k] > cut) if above else (x[:, k] <= cut)
    return found


def _paths(x: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, rule: Rule,
           rng: np.random.Generator) -> Iterator[tuple[Rule, np.ndarray, float]]:
    """Every node of one tree as the conjunction of the conditions that lead to it; leaves carry their step."""
    best = (1e-6, None)
    if len(rule) < DEPTH:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        for k in rng.permutation(x.shape[1])[:6]:
            cell = np.searchsorted(cuts[k], x[rows, k], "left")  # cell c: cut[c-1] < x <= cut[c]
            size = len(cuts[k]) + 1
            cg, ch, cn = (np.cumsum(np.bincount(cell, weights=w, minlength=size))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
            gain = cg ** 2 / (ch + 1) + (total_g - cg) ** 2 / (total_h - ch + 1) - total_g ** 2 / (total_h + 1)
            gain[(cn < LEAF) | (len(rows) - cn < LEAF)] = 0
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), (int(k), float(cuts[k][gain.argmax()])))
    if best[1] is None:
        yield rule, rows, -g[rows].sum() / (h[rows].sum() + 1)
        return
    if rule:
        yield rule, rows, 0.0
    k, cut = best[1]
    above = x[rows, k] > cut
    yield from _paths(x, cuts, g, h, rows[~above], (*rule, (k, False, cut)), rng)
    yield from _paths(x, cuts, g, h, rows[above], (*rule, (k, True, cut)), rng)


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> list[Rule]:
    """Rules of boosted trees, each grown on half of the rows with a random choice of statistics at each node."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    f, rules = np.zeros(len(x)), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        rows = np.sort(rng.permutation(len(x))[:max(2 * LEAF, len(x) // 2)])
        for rule, _, step in _paths(x, cuts, p - y, p * (1 - p), rows, (), rng):
            if rule:
                rules.setdefault(tuple(sorted(set(rule))))
                if step:
                    f += 0.3 * step * holds(rule, x)
    return list(rules)


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty on all weights but the base, by accelerated proximal steps."""
    a = np.column_stack([np.ones(len(r)), r]).astype(np.float64)
    top = np.linalg.norm(a.T @ a, 2) / (4 * len(a))
    w = v = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(steps):
        z = v - (a.T @ (1 / (1 + np.exp(-np.clip(a @ v, -30, 30))) - y)) / len(a) / top
        z[1:] = np.sign(z[1:]) * np.maximum(np.abs(z[1:]) - penalty / top, 0)
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w, v, t = z, z + (t - 1) / t_next * (z - w), t_next
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray) -> Ensemble:
    """The penalty with the smallest loss on a fifth of the rows that the weights have not seen."""
    rng = np.random.default_rng(5)
    rules = grow(x, y, rng)
    r = np.column_stack([holds(rule, x) for rule in rules]) if rules else np.zeros((len(x), 0))
    order = rng.permutation(len(x))
    tune, learn = order[:len(order) // 5], order[len(order) // 5:]

    def loss(penalty):
        base, w = lasso(r[learn], y[learn], penalty)
        z = base + r[tune] @ w
        return np.mean(np.logaddexp(0, z) - y[tune] * z)

    penalty = min((0.03, 0.01, 0.003, 0.001), key=loss)
    base, w = lasso(r, y, penalty)
    kept = np.flatnonzero(w)
    return Ensemble(base, [rules[k] for k in kept], [float(w[k]) for k in kept])


def quality(docs: DataFrame, labels: DataFrame, modulus: int = 4, rest: int = 2, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row, from statistics of the whole text alone.

    Rules and weights are fitted on at most `per_class` labelled documents of each class whose crc32(doc_id) % modulus
    is not `rest`, each class sampled by hash of the id. NULL, empty
    and blank texts have statistics of zero and are scored like any other; a NULL doc_id is not held out; repeated ids
    are scored row by row. Without labels of both classes every score is the share of label 1, 0 without any. Other
    columns are not read; an empty table gives an empty result.
    """
    sample = sample_of(docs.select("doc_id", "text"), labelled_sample(labels, "quality", modulus, rest, per_class))
    kept = sample.select("doc_id", "label").distinct()
    rows = with_statistics(sample).join(F.broadcast(kept), "doc_id").select("doc_id", "label", *STATISTICS).collect()
    rows = sorted(rows, key=tuple)
    x = np.array([r[2:] for r in rows], float).reshape(len(rows), len(STATISTICS))
    y = np.array([r[1] for r in rows], float)
    if len(set(y.tolist())) == 2:
        score = fit(x, y).score()
    else:
        score = F.lit(float(y.mean()) if len(y) else 0.0)
    found = with_statistics(docs).select("doc_id", held_out(modulus, rest).alias("held_out"), score.alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op7_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
