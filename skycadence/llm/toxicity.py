"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy and run on Spark."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from skycadence.llm import textkit as tk
from skycadence.llm.learning import held_out, labelled_sample, sample_of
from skycadence.llm.shared import documents

PER_CLASS = 3000  # documents of each class that are fitted on, at most
BUCKETS, DIM, FILTERS = 1 << 16, 8, 8
WIDTHS = (1, 2, 3, 5)
PAD = max(WIDTHS)  # empty words after each document, so that no window reaches into the next
PREFIXES = (4, 6)  # bytes of a word that are embedded besides the word, so that unseen forms share a vector
EPOCHS, BATCH, STEP = 4, 32, 0.05
PASS = 0.7  # the score at which a document is called toxic
_SALT = np.array([0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47, 0xD1342543DE82EF95], np.uint64)[:, None]


def word_ids(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, start): three embedding rows for each word, with PAD empty words after each document."""
    s, e, first = tk.words(buf, offs, tk.WORD)
    ids = (tk.span_hashes(buf, s, e, prefixes=PREFIXES) * _SALT >> np.uint64(48)).astype(np.int32)
    rows = np.diff(first)
    start = first[:-1] + PAD * np.arange(len(rows))
    out = np.full((len(s) + PAD * len(rows), 3), BUCKETS, np.int32)  # row BUCKETS is the empty word
    out[np.arange(len(s)) + PAD * np.repeat(np.arange(len(rows)), rows)] = ids.T
    return out, start


@dataclass
class Model:
    embed: np.ndarray  # (BUCKETS + 1, DIM); the last row stays zero
    conv: list[np.ndarray]  # per width: (width, DIM, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    base: float
    tongue: np.ndarray  # (BUCKETS + 1, languages): log-probability of a word in each language of the sample
    thresholds: np.ndarray  # per language: the logit called toxic
    scale: float

    def pooled(self, ids: np.ndarray, start: np.ndarray, where: bool = False):
        x = self.embed[ids[:, 0]]
        x += self.embed[ids[:, 1]]
        x += self.embed[ids[:, 2]]
        tops, at = [], []
        end = np.append(start[1:], len(ids)) - PAD + 1  # windows start at words, or at the first empty one
        bounds = np.column_stack([start, end]).ravel()
        for w in self.conv:
            y = x @ w[0]
            for j in range(1, len(w)):
                y[:len(x) - j] += x[j:] @ w[j]
            if where:
                spots = np.stack([a + y[a:b].argmax(axis=0) for a, b in zip(start, end)])
                at.append(spots)
                tops.append(np.take_along_axis(y, spots, axis=0))
            else:
                tops.append(np.maximum.reduceat(y, bounds, axis=0)[::2])
        return x, np.concatenate(tops, axis=1), at

    def logits(self, ids: np.ndarray, start: np.ndarray) -> np.ndarray:
        _, top, _ = self.pooled(ids, start)
        return np.maximum(top + self.bias, 0) @ self.out + self.base

    def languages(self, ids: np.ndarray, start: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.tongue[ids[:, 0]], start, axis=0).argmax(axis=1)

    def scores(self, ids: np.ndarray, start: np.ndarray) -> np.ndarray:
        """In each language, as read from the text, the threshold is put at PASS."""
        gap = self.logits(ids, start) - self.thresholds[self.languages(ids, start)]
        return 1 / (1 + np.exp(-np.clip(self.scale * gap + np.log(PASS / (1 - PASS)), -30, 30)))


def _counts(batch, rows: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted number of documents that hold each bucket."""
    total = np.zeros(BUCKETS + 1)
    for k in range(0, len(rows), 128):
        ids, start = batch(rows[k:k + 128])
        row = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(ids))))
        pairs = np.unique(np.concatenate([row * (BUCKETS + 1) + ids[:, c] for c in range(3)]))
        total += np.bincount(pairs % (BUCKETS + 1), weights=weight[k + pairs // (BUCKETS + 1)], minlength=BUCKETS + 1)
    return total


def fit(texts: pa.Array, toxic: np.ndarray, lang: list[str | None]) -> Model:
    """Train on whole texts. The first dimension starts at each bucket's shrunken log-odds; the rest at random.

    One fifth of the texts calibrates: in each language the threshold lies where it makes fewest errors."""
    rng = np.random.default_rng(11)
    buf, offs = tk.utf8(texts)
    toxic = np.asarray(toxic, np.float32)
    each = []
    for lo, hi in tk.slices(offs):
        ids, start = word_ids(buf[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo])
        each += np.split(ids, start[1:])
    names = sorted({x for x in lang if x is not None}) or [""]
    known = np.array([names.index(x) if x is not None else 0 for x in lang])
    order = rng.permutation(len(each))
    tune, learn = order[:len(order) // 5], order[len(order) // 5:]

    def batch(rows):
        ids = np.concatenate([each[r] for r in rows])
        return ids, np.cumsum([0] + [len(each[r]) for r in rows])[:-1]

    y = toxic[learn]
    pos, neg = _counts(batch, learn, y), _counts(batch, learn, 1 - y)
    odds = np.log((pos + 0.5) / (y.sum() + 1)) - np.log((neg + 0.5) / ((1 - y).sum() + 1))
    embed = rng.normal(0, 0.02, (BUCKETS + 1, DIM)).astype(np.float32)
    embed[:, 0] = odds * (pos + neg) / (pos + neg + 10) / 4
    embed[BUCKETS] = 0
    tongue = np.zeros((BUCKETS + 1, len(names)), np.float32)
    for k in range(len(names)):
        rows = learn[known[learn] == k]
        found = sum((np.bincount(each[r][:, 0], minlength=BUCKETS + 1) for r in rows), np.zeros(BUCKETS + 1))
        tongue[:, k] = np.log((found + 0.1) / (found[:BUCKETS].sum() + 0.1 * BUCKETS))
    tongue[BUCKETS] = 0

    conv = [rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for w in conv:
        w[0, 0, :2] += 1
    model = Model(embed, conv, np.full(len(WIDTHS) * FILTERS, -0.1, np.float32), rng.normal(0.1, 0.1, len(WIDTHS) * FILTERS).astype(np.float32),
                  -1.0, tongue, np.zeros(len(names)), 1.0)
    _train(model, batch, learn, toxic, rng)
    _calibrate(model, batch, tune if len(set(toxic[tune])) == 2 else order, toxic)
    return model


def _train(model: Model, batch, learn: np.ndarray, toxic: np.ndarray, rng: np.random.Generator) -> None:
    """Adagrad on the logistic loss; the classes weigh the same. Only words under a maximum get a gradient."""
    share = toxic[learn].mean()
    sums = {k: np.full_like(v, 1e-3) for k, v in (("embed", model.embed), ("bias", model.bias), ("out", model.out))}
    conv_sums = [np.full_like(w, 1e-3) for w in model.conv]
    for _ in range(EPOCHS):
        for k in range(0, len(learn), BATCH):
            rows = learn[rng.permutation(len(learn))[:BATCH]]
            ids, start = batch(rows)
            x, top, at = model.pooled(ids, start, where=True)
            hidden = np.maximum(top + model.bias, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ model.out + model.base, -30, 30)))
            y = toxic[rows]
            g = ((p - y) * np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) / len(rows)).astype(np.float32)
            d_hidden = g[:, None] * model.out * (hidden > 0)
            d_out, d_bias = hidden.T @ g, d_hidden.sum(axis=0)
            for f, (w, spots) in enumerate(zip(model.conv, at)):
                d = d_hidden[:, f * FILTERS:(f + 1) * FILTERS]
                d_w = np.zeros_like(w)
                for j in range(len(w)):
                    spot = np.minimum(spots + j, len(ids) - 1)
                    d_w[j] = np.einsum("bf,bfd->df", d, x[spot])
                    d_x = (d[:, :, None] * w[j].T[None]).reshape(-1, DIM)
                    for column in range(3):
                        touched, back = np.unique(ids[spot.ravel(), column], return_inverse=True)
                        d_e = np.zeros((len(touched), DIM), np.float32)
                        np.add.at(d_e, back, d_x)
                        d_e[touched == BUCKETS] = 0
                        sums["embed"][touched] += d_e ** 2
                        model.embed[touched] -= STEP * d_e / np.sqrt(sums["embed"][touched])
                conv_sums[f] += d_w ** 2
                w -= STEP * d_w / np.sqrt(conv_sums[f])
            for name, d in (("out", d_out), ("bias", d_bias)):
                sums[name] += d ** 2
                getattr(model, name)[:] -= STEP * d / np.sqrt(sums[name])
            model.base -= STEP * float(g.sum())


def _calibrate(model: Model, batch, rows: np.ndarray, toxic: np.ndarray) -> None:
    z, tongues = [], []
    for k in range(0, len(rows), 64):
        ids, start = batch(rows[k:k + 64])
        z.append(model.logits(ids, start))
        tongues.append(model.languages(ids, start))
    z, tongues, y = np.concatenate(z), np.concatenate(tongues), toxic[rows]
    overall = _threshold(z, y)
    for k in range(len(model.thresholds)):
        own = tongues == k
        both = own.sum() >= 40 and 5 <= y[own].sum() <= own.sum() - 5
        model.thresholds[k] = _threshold(z[own], y[own]) if both else overall


def _threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap with fewest errors."""
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    errors = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([[0], np.cumsum((1 - y)[::-1])])[::-1]
    edges = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    best = np.flatnonzero(errors == errors.min())
    return float(edges[best[len(best) // 2]])


def with_scores(docs: DataFrame, labels: DataFrame, modulus: int = 3, rest: int = 1, per_class: int = PER_CLASS,
                name: str = "score") -> DataFrame:
    """All rows and columns of `docs`, and the toxicity of each whole text as `name`. Nothing is shuffled.

    The model is fitted on at most `per_class` labelled documents of each class whose crc32(doc_id) % modulus is not
    `rest`; labels, lang, source and doc_id are no inputs of a score. The score is PASS at the threshold of the language
    that the text's words point to. NULL and empty texts are scored as texts without words; rows are scored one by one,
    so NULL or repeated ids do not matter. Without labels of both classes every score is 0. Other columns pass through,
    but one called `name` is replaced. An empty table gives an empty result.
    """
    docs = docs.drop(name)
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = sample_of(docs.select("doc_id", "text", lang.alias("lang")), labelled_sample(labels, "toxic", modulus, rest, per_class))
    rows = rows.select("doc_id", "text", "lang", "label").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    y = rows["label"].to_numpy()
    model = fit(rows["text"].combine_chunks(), y, rows["lang"].to_pylist()) if len(set(y.tolist())) == 2 else None
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = spread.value
        for batch in batches:
            buf, offs = tk.utf8(batch.column("text"))
            scores = [np.zeros(0)]
            for lo, hi in tk.slices(offs, 1 << 19):
                scores.append(fitted.scores(*word_ids(buf[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo])) if fitted else np.zeros(hi - lo))
            yield batch.append_column(name, pa.array(np.concatenate(scores).astype(np.float64)))

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 3, rest: int = 1, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row; see `with_scores`. A NULL doc_id is not held out."""
    own = [c for c in ("doc_id", "text", "lang") if c in docs.columns]
    return with_scores(docs.select(*own), labels, modulus, rest, per_class).select(
        "doc_id", held_out(modulus, rest).alias("held_out"), "score", (F.col("score") >= PASS).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows and columns of `docs` whose text is not called toxic."""
    return with_scores(docs, labels, name="__toxicity").where(F.col("__toxicity") < PASS).select(*docs.columns)


def op4_cnn_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
