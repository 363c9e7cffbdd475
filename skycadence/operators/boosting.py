"""Boosted trees whose fits share every scan.

Features are cut into bins once. A pass over the binned table adds up counts and gradients per (arm, node, feature, bin)
inside each task, so what is shuffled has the size of a histogram and not of the data, and no row reaches the driver. An
``Arm`` is one model: a label, a set of features, a loss, parameters, and a column that says which rows it trains and stops
on. All arms grow together, level by level, from the same passes: five folds, six horizons, twenty parameter draws or three
quantiles cost the passes of one model.

Losses: squared error, and the pinball loss of a quantile, whose leaves are quantiles of the residuals in the leaf.
"""

from __future__ import annotations

import json
import random
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skycadence.functions.exprs import clip
from skycadence.operators.ranks import exact_quantiles
from skycadence.sources.sinks import materialize
from skycadence.spec import VALID_MAX, VALID_MIN

C = F.col
BINS = 32          # of a feature's values; a missing value has a bin of its own, before all others
REFRESH = 10       # rounds after which predictions are written, so that a pass evaluates few trees
TRAIN, STOP = "train", "stop"


@dataclass(frozen=True)
class Arm:
    """One model: what it learns, from which features and rows, and how."""

    name: str
    label: str
    features: tuple[str, ...]
    role: str = "role"            # column with "train" and "stop" for the rows of this arm
    level: float | None = None    # a quantile for the pinball loss; None is squared error
    depth: int = 3
    rate: float = 0.1
    rounds: int = 40
    patience: int = 10            # rounds without a better loss on the stop rows
    min_leaf: int = 5
    shrink: float = 1.0           # added to a leaf's number of rows
    weight: str | None = None


@dataclass
class Tree:
    """Complete tree in heap order: a node without a split sends all its rows left."""

    feature: list[int]
    cut: list[int]
    value: list[float]

    def leaves(self, x: np.ndarray, depth: int | None = None) -> np.ndarray:
        """Node number within the level ``depth`` of each row; the leaves by default."""
        full = len(self.value).bit_length() - 1
        depth = full if depth is None else depth
        feature, cut = np.array(self.feature), np.array(self.cut)
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(depth):
            f = feature[at]
            right = (f >= 0) & (x[rows, np.maximum(f, 0)] > cut[at])
            at = 2 * at + 1 + right
        return at - (2 ** depth - 1)


@dataclass
class Fit:
    """What a run knows of an arm."""

    arm: Arm
    base: float | None = 0.0  # None without training rows
    trees: list[Tree] = field(default_factory=list)
    gains: dict[str, float] = field(default_factory=dict)
    losses: list[float | None] = field(default_factory=list)  # on the stop rows, before each round
    stopped: bool = False

    def raw(self, x: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
        out = np.zeros(len(x))
        for tree in self.trees[first:last]:
            out += np.array(tree.value)[tree.leaves(x)]
        return out

    @property
    def best(self) -> int:
        """Number of trees at the smallest loss on the stop rows; all of them without stop rows."""
        known = [(v, k) for k, v in enumerate(self.losses) if v is not None]
        return min(known)[1] if known else len(self.trees)


def bin_edges(df: DataFrame, features: Sequence[str], bins: int = BINS) -> dict[str, list[float]]:
    """Cut points of each feature, at most ``bins`` - 1, from quantile sketches of one aggregate."""
    probs = [k / bins for k in range(1, bins)]
    row = df.agg(*[F.percentile_approx(F.when(~F.isnan(C(f).cast("double")), C(f).cast("double")), probs, 10_000).alias(f"e{k}") for k, f in enumerate(features)]).first()
    return {f: sorted(set(row[k] or [])) for k, f in enumerate(features)}


def bin_column(feature: str, edges: Sequence[float]) -> Column:
    """0 for a missing value, else 1 more than the number of edges below the value."""
    v = C(feature).cast("double")
    above = F.aggregate(F.array(*[F.lit(float(e)) for e in edges]), F.lit(1), lambda n, e: n + (v > e).cast("int")) if edges else F.lit(1)
    return F.when(v.isNull() | F.isnan(v), F.lit(0)).otherwise(above).cast("tinyint")


def binned(df: DataFrame, arms: Sequence[Arm], edges: dict[str, list[float]]) -> DataFrame:
    """What the passes read: bins of all features, and per arm its label, role (1 train, 2 stop) and weight."""
    role = {r: F.when(C(r) == TRAIN, 1).when(C(r) == STOP, 2).otherwise(0) for r in {a.role for a in arms}}
    labels = [C(a.label).cast("double") for a in arms]
    known = [F.when(y.isNotNull() & ~F.isnan(y), role[a.role]).otherwise(0).cast("tinyint") for a, y in zip(arms, labels)]
    weights = [F.coalesce(C(a.weight).cast("double"), F.lit(0.0)) if a.weight else F.lit(1.0) for a in arms]
    d = df.select(F.array(*[bin_column(f, e) for f, e in edges.items()]).alias("x"), F.array(*[F.coalesce(y, F.lit(0.0)) for y in labels]).alias("y"),
                  F.array(*known).alias("role"), F.array(*weights).alias("w"), F.array(*[F.lit(0.0)] * len(arms)).alias("p"))
    return d.where(F.exists("role", lambda r: r > 0))


def _arrays(batch: pa.RecordBatch, names: Sequence[str]) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(n)).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for n in names]


def _gradient(arm: Arm, y: np.ndarray, p: np.ndarray) -> np.ndarray:
    return y - p if arm.level is None else np.where(y > p, arm.level, arm.level - 1.0)


def _loss(arm: Arm, y: np.ndarray, p: np.ndarray) -> np.ndarray:
    return (y - p) ** 2 if arm.level is None else (y - p) * _gradient(arm, y, p)


def _now(fit: Fit, held: int, x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Prediction of a fit: what the table holds of it and the trees since."""
    return fit.base + p + fit.raw(x, held)


class Forest:
    """A run: the binned table, the fits so far, and how many of their trees the table's predictions hold."""

    def __init__(self, df: DataFrame, arms: Sequence[Arm], bins: int = BINS, edges: dict[str, list[float]] | None = None):
        self.arms = list(arms)
        self.features = list(dict.fromkeys(f for a in arms for f in a.features))
        used = df.where(_any([C(r) == TRAIN for r in {a.role for a in arms}]))
        self.edges = edges or bin_edges(used, self.features, bins)
        self.table = materialize(binned(df, arms, self.edges), "binned")
        self.fits = [Fit(a) for a in arms]
        self.held = 0
        self._start()

    def _start(self) -> None:
        """Base values: the weighted mean, or the quantile, of each arm's training labels."""
        rows = self.table.select(F.posexplode(F.arrays_zip("y", "role", "w")).alias("arm", "r")).where("r.role = 1")
        means = {r["arm"]: r["m"] for r in rows.groupBy("arm").agg((F.sum(C("r.y") * C("r.w")) / F.sum("r.w")).alias("m")).collect()}
        levels = sorted({a.level for a in self.arms if a.level is not None})
        cuts = {}
        if levels:
            q = exact_quantiles(rows.select("arm", C("r.y").alias("y")), "y", ["arm"], {f"q{k}": v for k, v in enumerate(levels)})
            cuts = {r["arm"]: r for r in q.collect()}
        for k, fit in enumerate(self.fits):
            if k not in means:
                fit.stopped, fit.base = True, None
            else:
                fit.base = means[k] if fit.arm.level is None else cuts[k][f"q{levels.index(fit.arm.level)}"]

    def _histogram(self, growing: dict[int, Tree], level: int, losses: bool) -> DataFrame:
        """(arm, node, feature, bin, n, g); with ``losses`` also the loss on stop rows, at node -1."""
        at = {k: np.array([self.features.index(f) for f in self.arms[k].features]) for k in growing}
        wide = max((len(e) for e in self.edges.values()), default=0) + 2
        fits, held = self.fits, self.held  # what the tasks get; the run itself stays here

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nodes = 2 ** level
            n = {k: np.zeros((nodes, len(at[k]), wide)) for k in growing}
            g = {k: np.zeros((nodes, len(at[k]), wide)) for k in growing}
            stop = {k: np.zeros(2) for k in growing}
            for batch in batches:
                x, y, role, w, p = _arrays(batch, ["x", "y", "role", "w", "p"])
                for k, tree in growing.items():
                    arm = fits[k].arm
                    mine = np.flatnonzero(role[:, k] == 1)
                    node = tree.leaves(x[mine], level)
                    slope = _gradient(arm, y[mine, k], _now(fits[k], held, x[mine], p[mine, k])) * w[mine, k]
                    cell = (node[:, None] * len(at[k]) + np.arange(len(at[k]))) * wide + x[mine][:, at[k]]
                    for total, weight in ((n[k], w[mine, k]), (g[k], slope)):
                        total += np.bincount(cell.reshape(-1), np.repeat(weight, len(at[k])), total.size).reshape(total.shape)
                    if losses:
                        out = np.flatnonzero(role[:, k] == 2)
                        stop[k] += [len(out), _loss(arm, y[out, k], _now(fits[k], held, x[out], p[out, k])).sum()]
            for k in growing:
                node, feature, cut = np.nonzero(n[k])
                columns = [np.full(len(node), k), node, at[k][feature], cut, n[k][node, feature, cut], g[k][node, feature, cut]]
                if losses and stop[k][0]:
                    columns = [np.append(c, v) for c, v in zip(columns, (k, -1, 0, 0, stop[k][0], stop[k][1]))]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(columns, ("i4", "i4", "i4", "i4", "f8", "f8"))],
                                                 ["arm", "node", "feature", "bin", "n", "g"])
        cells = self.table.mapInArrow(partial, "arm int, node int, feature int, bin int, n double, g double")
        return cells.groupBy("arm", "node", "feature", "bin").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))

    def _splits(self, cells: DataFrame) -> DataFrame:
        """The best cut of each node by the gain in squared gradient sums; ties go to the first feature, then the first bin."""
        per = Window.partitionBy("arm", "node", "feature")
        below = per.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        arm = F.array(*[F.struct(F.lit(float(a.min_leaf)).alias("least"), F.lit(float(a.shrink)).alias("shrink")) for a in self.arms])[C("arm")]
        d = cells.select("*", F.sum("n").over(below).alias("nl"), F.sum("g").over(below).alias("gl"), F.sum("n").over(per).alias("nt"),
                         F.sum("g").over(per).alias("gt"), arm["least"].alias("least"), arm["shrink"].alias("s"))
        right_n, right_g = C("nt") - C("nl"), C("gt") - C("gl")
        gain = C("gl") * C("gl") / (C("nl") + C("s")) + right_g * right_g / (right_n + C("s")) - C("gt") * C("gt") / (C("nt") + C("s"))
        d = d.withColumn("gain", F.when((C("nl") >= C("least")) & (right_n >= C("least")) & (gain > 0), gain))
        order = F.struct("gain", -C("feature"), -C("bin"))
        return d.groupBy("arm", "node").agg(F.max_by(F.struct("gain", "feature", "bin", "nl", "gl"), F.when(C("gain").isNotNull(), order)).alias("best"),
                                            F.max("nt").alias("n"), F.max_by("gt", "nt").alias("g"))

    def _leaf_quantiles(self, growing: dict[int, Tree]) -> dict[tuple[int, int], float]:
        """The quantile of the residuals in each leaf of the pinball arms, exact."""
        some = {k: t for k, t in growing.items() if self.arms[k].level is not None}
        if not some:
            return {}
        fits, held = self.fits, self.held

        def residuals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y, role, p = _arrays(batch, ["x", "y", "role", "p"])
                for k, tree in some.items():
                    mine = np.flatnonzero(role[:, k] == 1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), k, np.int32)), pa.array(tree.leaves(x[mine]).astype(np.int32)),
                                                      pa.array(y[mine, k] - _now(fits[k], held, x[mine], p[mine, k]))], ["arm", "leaf", "r"])
        levels = sorted({self.arms[k].level for k in some})
        rows = self.table.mapInArrow(residuals, "arm int, leaf int, r double")
        found = exact_quantiles(rows, "r", ["arm", "leaf"], {f"q{k}": v for k, v in enumerate(levels)}).collect()
        return {(r["arm"], r["leaf"]): r[f"q{levels.index(self.arms[r['arm']].level)}"] for r in found}

    def _refresh(self) -> None:
        """Write the predictions of the trees so far into the table, so that later passes start from them."""
        fits, first = self.fits, self.held

        def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, p = _arrays(batch, ["x", "p"])
                p = p + np.stack([fit.raw(x, first) for fit in fits], axis=1)
                offsets = pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32())
                yield batch.set_column(batch.schema.get_field_index("p"), "p", pa.ListArray.from_arrays(offsets, pa.array(p.reshape(-1))))
        self.table = materialize(self.table.mapInArrow(update, self.table.schema), "boosted")
        self.held = max(len(f.trees) for f in self.fits)

    def open(self) -> list[int]:
        return [k for k, f in enumerate(self.fits) if not f.stopped and len(f.trees) < f.arm.rounds]

    def round(self) -> bool:
        """One more tree for every open arm; False when none is left."""
        growing = {k: Tree([-1] * (2 ** self.arms[k].depth - 1), [0] * (2 ** self.arms[k].depth - 1), [0.0] * 2 ** self.arms[k].depth) for k in self.open()}
        if not growing:
            return False
        if max(len(f.trees) for f in self.fits) - self.held >= REFRESH:
            self._refresh()
        for level in range(max(self.arms[k].depth for k in growing)):
            deep = {k: t for k, t in growing.items() if self.arms[k].depth > level}
            if not deep:
                break
            found = self._splits(self._histogram(deep, level, losses=level == 0)).collect()
            if level == 0:
                losses = {r["arm"]: r["g"] / r["n"] for r in found if r["node"] < 0}
                for k in list(growing):
                    self._note_loss(k, losses.get(k))
                    if self.fits[k].stopped:
                        del growing[k]
            for r in found:
                if r["arm"] in growing and r["node"] >= 0:
                    self._grow(growing[r["arm"]], self.fits[r["arm"]], level, r)
        quantiles = self._leaf_quantiles(growing)
        for k, tree in growing.items():
            arm = self.arms[k]
            if arm.level is not None:
                tree.value = [quantiles.get((k, leaf), 0.0) for leaf in range(len(tree.value))]
            tree.value = [float(arm.rate * v) for v in tree.value]
            self.fits[k].trees.append(tree)
        return bool(growing)

    def _note_loss(self, k: int, loss: float | None) -> None:
        fit = self.fits[k]
        fit.losses.append(loss)
        if loss is not None and len(fit.losses) - 1 - fit.best >= fit.arm.patience:
            fit.stopped = True

    def _grow(self, tree: Tree, fit: Fit, level: int, r) -> None:
        arm, node, best = fit.arm, r["node"], r["best"]
        heap = 2 ** level - 1 + node
        sums = [(r["n"], r["g"])] * 2
        if best is not None and best["gain"] is not None:
            tree.feature[heap], tree.cut[heap] = best["feature"], best["bin"]
            name = self.features[best["feature"]]
            fit.gains[name] = fit.gains.get(name, 0.0) + best["gain"]
            sums = [(best["nl"], best["gl"]), (r["n"] - best["nl"], r["g"] - best["gl"])]
        span = 2 ** (arm.depth - level - 1)  # the values below this node, until deeper levels say more
        for side, (n, g) in enumerate(sums):
            start = (2 * node + side) * span
            tree.value[start:start + span] = [g / (n + arm.shrink)] * span

    def final_losses(self) -> dict[str, float | None]:
        """Loss of each arm's best state on its stop rows, as seen before each round."""
        return {f.arm.name: min((v for v in f.losses if v is not None), default=None) for f in self.fits}

    def models(self) -> list[dict]:
        """The fits as plain values: trees up to the best round, bins and base."""
        return [{"arm": asdict(f.arm), "base": f.base, "edges": self.edges, "order": self.features, "gains": f.gains,
                 "trees": [asdict(t) for t in f.trees[:f.best]]} for f in self.fits]


def _any(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def fit_arms(df: DataFrame, arms: Sequence[Arm], bins: int = BINS) -> list[dict]:
    """Fit all arms together and return their models. Arms without training rows predict NULL.

    Rows count for an arm by its role column and where its label is known; a missing feature has its own bin. The driver
    holds histograms' winners only: one row per arm and node."""
    run = Forest(df, arms, bins)
    while run.round():
        pass
    return run.models()


def race(df: DataFrame, arms: Sequence[Arm], *, first: int = 5, keep: float = 0.5, bins: int = BINS) -> tuple[list[dict], list[tuple]]:
    """Parameter search by rounds of growing size: after ``first`` trees the better half goes on, after twice as many half of it...

    Losers are stopped, winners keep their trees and grow on, and all of them share their passes. Returns the models and
    one row (arm, stage, trees, loss, kept) per arm and stage, which is the search's budget."""
    run, table, stage, until = Forest(df, arms, bins), [], 0, first
    while True:
        while max(len(f.trees) for f in run.fits) < until and run.round():
            pass
        stage += 1
        alive = run.open()
        if not alive:
            break
        losses = {k: run.fits[k].losses[-1] if run.fits[k].losses else None for k in alive}
        ranked = sorted(alive, key=lambda k: (losses[k] is None, losses[k] or 0.0, k))
        kept = set(ranked[:max(1, int(np.ceil(len(ranked) * keep)))])
        for k in alive:
            table.append((run.arms[k].name, stage, len(run.fits[k].trees), losses[k], k in kept))
            run.fits[k].stopped = run.fits[k].stopped or k not in kept
        until *= 2
        if len(kept) == 1:
            while run.round():
                pass
            break
    return run.models(), table


def draws(space: dict[str, Sequence], trials: int, seed: int = 42) -> list[dict]:
    """Random parameter sets, reproducible by their seed."""
    rng = random.Random(seed)
    return [{k: rng.choice(list(v)) for k, v in space.items()} for _ in range(trials)]


def first_histogram(df: DataFrame, arms: Sequence[Arm], edges: dict[str, list[float]] | None = None) -> DataFrame:
    """(arm, feature, bin, n, g): what the first split of each arm is chosen from. Bin 0 holds missing values."""
    run = Forest(df, arms, edges=edges)
    cells = run._histogram({k: Tree([-1], [0], [0.0, 0.0]) for k in run.open()}, 0, losses=False)
    names = F.array(*[F.lit(a.name) for a in arms])
    features = F.array(*[F.lit(f) for f in run.features])
    return cells.select(names[C("arm")].alias("arm"), features[C("feature")].alias("feature"), "bin", "n", "g")


def predict(df: DataFrame, models: dict[str, dict], *, now: dict[str, str] | None = None, lo: float | None = VALID_MIN,
            hi: float | None = VALID_MAX) -> DataFrame:
    """Adds one column per model. ``now`` names the column a model's output is a residual on; results are clipped to [lo, hi].

    A model without trees gives its base value, one that had no training rows gives NULL."""
    names = list(models)
    features = list(dict.fromkeys(f for m in models.values() for f in m["order"]))
    fits = [Fit(Arm(**{**m["arm"], "features": tuple(m["arm"]["features"])}), m["base"], [Tree(**t) for t in m["trees"]]) for m in models.values()]
    edges = [[np.array(m["edges"][f]) for f in m["order"]] for m in models.values()]
    at = [[features.index(f) for f in m["order"]] for m in models.values()]
    columns = df.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            out = np.empty((batch.num_rows, len(fits)))
            for k, fit in enumerate(fits):
                x = np.stack([np.where(np.isnan(raw[:, c]), 0, np.searchsorted(e, raw[:, c], "left") + 1) for c, e in zip(at[k], edges[k])], axis=1)
                out[:, k] = (fit.base or 0.0) + fit.raw(x)
            offsets = pa.array(np.arange(len(out) + 1) * len(fits), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(offsets, pa.array(out.reshape(-1)))], [*columns, "_p"])
    d = df.withColumn("_x", F.array(*[F.coalesce(C(f).cast("double"), F.lit(float("nan"))) for f in features]))
    p = d.mapInArrow(score, StructType([*df.schema.fields, *StructType.fromDDL("_p array<double>").fields]))
    out = []
    for k, name in enumerate(names):
        value = C("_p")[k] if fits[k].base is not None else F.lit(None).cast("double")
        if (now or {}).get(name):
            value = C(now[name]) + value
        out.append((value if lo is None or hi is None else clip(value, lo, hi)).alias(name))
    return p.select(*df.columns, *out)


def uncrossed(names: Sequence[str]) -> list[Column]:
    """Quantile predictions in order: sorting each row's values never raises the pinball loss."""
    values = F.sort_array(F.array(*[C(n) for n in names]))
    return [values[k].alias(n) for k, n in enumerate(names)]


def pinball(y: str, p: str, level: float) -> Column:
    gap = C(y) - C(p)
    return F.avg(F.greatest(gap * F.lit(level), gap * F.lit(level - 1.0)))


def importance(spark: SparkSession, model: dict) -> DataFrame:
    """(rank, feature, importance): share of the total gain, largest first; unused features have none."""
    total = sum(model["gains"].values()) or 1.0
    rows = sorted(((f, model["gains"].get(f, 0.0) / total) for f in model["arm"]["features"]), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame([(k, f, float(v)) for k, (f, v) in enumerate(rows, 1)], "rank int, feature string, importance double")


def save(spark: SparkSession, models: dict[str, dict], path: str) -> None:
    """One row per model: its name and its trees as JSON."""
    rows = [(n, json.dumps(m, sort_keys=True)) for n, m in models.items()]
    spark.createDataFrame(rows, "name string, model string").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> dict[str, dict]:
    return {r["name"]: json.loads(r["model"]) for r in spark.read.parquet(path).collect()}
