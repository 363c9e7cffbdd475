"""Linear fits from one table of sums.

``sums`` reduces a training table to the products of its columns, added up per group: n, X'X, X'y and y'y. The table is a
few thousand rows a group whatever the number of readings, it merges by adding, and every ridge fit of any subset of the
features on any union of groups is solved from it. Folds, seasons, add-one tests and eliminations therefore share one scan.

Fits are solved by the sweep operator: bringing a feature in or taking it out is one rank-one update of a small matrix, so
trying every drop of 50 features costs less than one refit. The solving runs inside Spark, one task per group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skycadence.functions.exprs import clip
from skycadence.spec import VALID_MAX, VALID_MIN

C = F.col
ONE, LABEL, MISSING = "1", "y", "?"  # names of the constant, of the target, and the ending of a missing-value flag
EMPTY = 1e-12  # share of a feature's own variance below which it is a copy of others
RESTART = 500  # updates after which a fit starts from the sums again


def pivots(df: DataFrame, features: Sequence[str]) -> dict[str, float]:
    """Whole numbers near the mean of each feature. Sums are taken around them, so that nothing cancels."""
    row = df.agg(*[F.floor(F.avg(f) + 0.5).cast("double").alias(f"p{k}") for k, f in enumerate(features)]).first()
    return {f: row[k] if row[k] is not None else 0.0 for k, f in enumerate(features)}


def columns_of(features: Sequence[str], nullable: Sequence[str] = ()) -> list[str]:
    """Columns that stand for features: a feature with missing values brings a flag."""
    return [*features, *[f"{f}{MISSING}" for f in features if f in nullable]]


def _inputs(features: Sequence[str], nullable: Sequence[str], centre: dict[str, float]) -> list[Column]:
    filled = [F.coalesce(C(f).cast("double") - F.lit(float(centre.get(f, 0.0))), F.lit(0.0)) for f in features]
    return [*filled, *[F.coalesce(C(f).isNull() | F.isnan(C(f).cast("double")), F.lit(True)).cast("double") for f in features if f in nullable]]


def sums(df: DataFrame, features: Sequence[str], label: str, by: Sequence[str] = (), *, nullable: Sequence[str] = (),
         centre: dict[str, float] | None = None, weights: str | None = None) -> DataFrame:
    """(by..., i, j, s): for each group the sum of column i times column j, each pair once.

    Rows without a label are left out. A missing feature counts as its pivot (``centre``); features named in ``nullable``
    also get a column that is 1 where they are missing. ``weights`` names an array of row weights: the table then has one
    set of sums per place of the array (column ``seed``, from 0), all from the same pass.
    """
    names = [ONE, *columns_of(features, nullable), LABEL]
    at, to = np.triu_indices(len(names))
    left, right = np.array(names)[at], np.array(names)[to]
    by = list(by)
    y = C(label).cast("double")
    rows = df.where(y.isNotNull() & ~F.isnan(y)).select(
        *by, F.array(F.lit(1.0), *[F.nanvl(x, F.lit(0.0)) for x in _inputs(features, nullable, centre or {})], y).alias("_x"),
        *([C(weights).cast("array<double>").alias("_w")] if weights else []))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(len(by)).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(names))
            w = batch.column(len(by) + 1).flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) if weights else np.ones((len(x), 1))
            keys = pa.Table.from_batches([batch.select(list(range(len(by))))])
            ids, groups = _groups(keys, len(x))
            for g in range(len(groups)):
                mine = ids == g
                for seed in range(w.shape[1]):
                    total = (x[mine] * w[mine, seed][:, None]).T @ x[mine]
                    cells = [pa.array([k.as_py()] * len(at), k.type) for k in groups[g]]
                    extra = [pa.array(np.full(len(at), seed, np.int32))] if weights else []
                    yield pa.RecordBatch.from_arrays([*cells, *extra, pa.array(left), pa.array(right), pa.array(total[at, to])],
                                                     [*by, *(["seed"] if weights else []), "i", "j", "s"])
    schema = StructType([df.schema[k] for k in by] + StructType.fromDDL(("seed int, " if weights else "") + "i string, j string, s double").fields)
    keys = [*by, *(["seed"] if weights else [])]
    return merged(rows.mapInArrow(partial, schema), keys)


def _groups(keys: pa.Table, n: int) -> tuple[np.ndarray, list[list[pa.Scalar]]]:
    """Group number of each row, and the key values of each group; NULL is a value like any other."""
    if not keys.num_columns:
        return np.zeros(n, np.int64), [[]] if n else []
    ids = np.zeros(n, np.int64)
    for column in keys.columns:
        code = column.combine_chunks().dictionary_encode(null_encoding="encode")
        ids = ids * (len(code.dictionary) + 1) + code.indices.to_numpy()
    _, first, ids = np.unique(ids, return_index=True, return_inverse=True)
    return ids, [[column[int(f)] for column in keys.columns] for f in first]


def merged(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sums of coarser groups: they add."""
    return table.groupBy(*by, "i", "j").agg(F.sum("s").alias("s"))


def walk_forward(table: DataFrame, block: str, k: int, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(train, test) sums of ``k`` expanding folds from sums per time block 0..k: fold f trains on the blocks before f."""
    folds = F.sequence(F.lit(1), F.lit(k))
    train = table.withColumn("fold", F.explode(F.filter(folds, lambda f: f > C(block))))
    test = table.where(C(block).between(1, k)).withColumn("fold", C(block).cast("int"))
    return merged(train, [*by, "fold"]), merged(test, [*by, "fold"])


def poisson_steps(rate: float) -> list[float]:
    """Cumulated Poisson probabilities, until the rest is below 2 ** -52."""
    steps, p, below = [], float(np.exp(-rate)), 0.0
    while below + p < 1.0 - 2.0 ** -52 and len(steps) < 1000:
        below += p
        steps.append(below)
        p *= rate / len(steps)
    return steps


def poisson_weights(key: Sequence[Column | str], seeds: int, rate: float = 1.0, salt: str = "seed") -> Column:
    """How often a row is drawn in each of ``seeds`` bootstrap samples: Poisson counts, an array with a place per seed.

    The count inverts the Poisson distribution at a number hashed from the row's key and the seed, so any task gives the
    same draw again and a sample needs no shuffle."""
    text = F.concat_ws("|", *[(C(k) if isinstance(k, str) else k).cast("string") for k in key])
    steps = poisson_steps(rate)

    def drawn(seed: int) -> Column:
        u = F.conv(F.substring(F.md5(F.concat(text, F.lit(f"|{salt}{seed}"))), 1, 13), 16, 10).cast("double") / F.lit(2.0 ** 52)
        return F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), lambda n, x: n + (u >= x).cast("int"))
    return F.array(*[drawn(k) for k in range(seeds)])


# ---- solving, inside one group ---------------------------------------------


def sweep(a: np.ndarray, k: int, back: bool = False) -> None:
    """Bring column k of a symmetric matrix in, or with ``back`` take it out again."""
    pivot, row = a[k, k], a[k].copy()
    a -= np.outer(row, row) / pivot
    a[k] = a[:, k] = -row / pivot if back else row / pivot
    a[k, k] = -1.0 / pivot


class Moments:
    """The sums of one group as matrices, and ridge fits of subsets of its features.

    The penalty is ``alpha`` times the squared coefficients of the standardised features, as for a sum of squared errors.
    Constant features are left out of every fit.
    """

    def __init__(self, rows: pd.DataFrame, columns: Sequence[str], alpha: float = 1.0):
        names = [ONE, *columns, LABEL]
        place = {n: k for k, n in enumerate(names)}
        known = rows[rows["i"].isin(place) & rows["j"].isin(place)]
        self.s = np.zeros((len(names), len(names)))
        i, j = known["i"].map(place).to_numpy(int), known["j"].map(place).to_numpy(int)
        self.s[i, j] = self.s[j, i] = known["s"].to_numpy(float)
        self.columns, self.alpha, self.n = list(columns), alpha, self.s[0, 0]
        if self.n > 0:
            mean = self.s[0] / self.n
            c = self.s[1:, 1:] - np.outer(mean[1:], mean[1:]) * self.n
            size = np.sqrt(np.maximum(np.diag(c), 0.0))
            level = np.sqrt(np.diag(self.s)[1:]) * 1e-7
            self.mean, self.scale = mean, np.where(size > level, size / np.sqrt(self.n), 0.0)
            inverse = np.divide(1.0, self.scale, out=np.zeros_like(self.scale), where=self.scale > 0)
            self.a = c * np.outer(inverse, inverse)
            self.a[np.arange(len(columns)), np.arange(len(columns))] += alpha
            self.fresh, self.inside, self.moves = self.a.copy(), [], 0

    @property
    def total(self) -> float:
        """Squared deviations of the target."""
        return float(self.s[-1, -1] - self.s[0, -1] ** 2 / self.n) if self.n > 0 else 0.0

    def toggle(self, column: str) -> None:
        k = self.columns.index(column)
        if k in self.inside:
            sweep(self.a, k, back=True)
            self.inside.remove(k)
        elif self.scale[k] > 0 and self.a[k, k] > EMPTY * self.fresh[k, k]:
            sweep(self.a, k)
            self.inside.append(k)
        self.moves += 1

    def fit(self, columns: Sequence[str]) -> None:
        if self.moves > RESTART:  # rounding of many updates does not pile up
            self.a, self.inside, self.moves = self.fresh.copy(), [], 0
        inside = {self.columns[k] for k in self.inside}
        for name in inside.symmetric_difference(columns):
            self.toggle(name)

    def coefficients(self) -> tuple[float, np.ndarray]:
        """Intercept and a coefficient for every column, zero for those outside."""
        b = np.zeros(len(self.columns))
        for k in self.inside:
            b[k] = self.a[k, -1] / self.scale[k] * self.scale[-1]
        return float(self.mean[-1] - b @ self.mean[1:-1]), b

    def strength(self) -> dict[str, float]:
        """Size of the standardised coefficients, in units of the target."""
        return {self.columns[k]: abs(float(self.a[k, -1] * self.scale[-1])) for k in self.inside}

    def squared_error(self, other: Moments | None = None) -> float:
        """Sum of squared errors of the current fit on the rows of another table of sums, without touching a row."""
        intercept, b = self.coefficients()
        u = np.concatenate([[-intercept], -b, [1.0]])
        return max(float(u @ (other or self).s @ u), 0.0)

    def r2(self, other: Moments) -> float | None:
        return 1.0 - self.squared_error(other) / other.total if other.n > 0 and other.total > 0 else None


Job = Callable[[Moments, Moments, Callable[[Sequence[str]], list[str]]], list[tuple]]


def _solved(train: DataFrame, held: DataFrame | None, by: Sequence[str], features: Sequence[str], nullable: Sequence[str], alpha: float,
            job: Job, columns: str, min_rows: int) -> DataFrame:
    """Runs ``job`` on the sums of each group; groups with fewer than ``min_rows`` training rows give nothing."""
    by = list(by)
    all_columns = columns_of(features, nullable)

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        mine, other = (Moments(rows[rows["_held"] == held], all_columns, alpha) for held in (False, True))
        found = job(mine, other, lambda names: columns_of(names, nullable)) if mine.n >= max(min_rows, 1) else []
        return pd.DataFrame([(*key[:len(by)], *r) for r in found], columns=[f.name for f in schema])
    schema = StructType([train.schema[k] for k in by] + StructType.fromDDL(columns).fields)
    both = train.withColumn("_held", F.lit(False))
    if held is not None:
        both = both.unionByName(held.withColumn("_held", F.lit(True)))
    return both.withColumn("_all", F.lit("")).groupBy(*by, "_all").applyInPandas(solve, schema)


def fits(train: DataFrame, features: Sequence[str], by: Sequence[str] = (), *, nullable: Sequence[str] = (), alpha: float = 1.0,
         min_rows: int = 1) -> DataFrame:
    """(by..., n, intercept, coefficients): one ridge fit per group; coefficients follow ``columns_of(features, nullable)``."""
    def job(mine, _, expand):
        mine.fit(expand(features))
        intercept, b = mine.coefficients()
        return [(int(round(mine.n)), intercept, b.tolist())]
    return _solved(train, None, by, features, nullable, alpha, job, "n long,intercept double,coefficients array<double>", min_rows)


def predicted(df: DataFrame, models: DataFrame, features: Sequence[str], out: str, by: Sequence[str] = (), *, nullable: Sequence[str] = (),
              centre: dict[str, float] | None = None, lo: float = VALID_MIN, hi: float = VALID_MAX) -> DataFrame:
    """Clipped prediction of each row by the model of its group; NULL where the group has none.

    Models are one row per group, so the join moves no reading unless there are very many groups."""
    keys = [*by, "_all"]
    m = models.withColumn("_all", F.lit(0)).select(*[C(k).alias(f"_k_{k}") for k in keys], C("intercept").alias("_b0"), C("coefficients").alias("_b"))
    d = df.withColumn("_all", F.lit(0))
    joined = d.join(m, reduce(lambda a, b: a & b, [d[k].eqNullSafe(m[f"_k_{k}"]) for k in keys]), "left")
    value = C("_b0")
    for k, x in enumerate(_inputs(features, nullable, centre or {})):
        value = value + C("_b")[k] * F.nanvl(x, F.lit(0.0))
    return joined.select(*df.columns, clip(value, lo, hi).alias(out))


def group_models(df: DataFrame, table: DataFrame, features: Sequence[str], part: str, out: str, by: Sequence[str] = (), *,
                 nullable: Sequence[str] = (), centre: dict[str, float] | None = None, alpha: float = 1.0, min_rows: int = 200) -> DataFrame:
    """Separate models per value of ``part`` (a season, a sky class), and the model of the whole series where a part is small.

    Adds the prediction ``out`` and ``out_model``: the part's value, or ``*`` for the fallback."""
    own = fits(table, features, [*by, part], nullable=nullable, alpha=alpha, min_rows=min_rows)
    whole = fits(merged(table, by), features, by, nullable=nullable, alpha=alpha)
    both = predicted(df, own, features, "_own", [*by, part], nullable=nullable, centre=centre)
    both = predicted(both, whole, features, "_whole", by, nullable=nullable, centre=centre)
    return both.select(*df.columns, F.coalesce("_own", "_whole").alias(out),
                       F.when(C("_own").isNotNull(), C(part).cast("string")).otherwise(F.lit("*")).alias(f"{out}_model"))


def subset_scores(train: DataFrame, held: DataFrame, features: Sequence[str], subsets: dict[str, Sequence[str]], by: Sequence[str] = (), *,
                  nullable: Sequence[str] = (), alpha: float = 1.0, min_rows: int = 1) -> DataFrame:
    """(by..., step, subset, n_features, n_train, n_held, r2, rmse) of named subsets, in the given order."""
    def job(mine, other, expand):
        rows = []
        for step, (name, names) in enumerate(subsets.items(), 1):
            mine.fit(expand(names))
            error = mine.squared_error(other)
            rows.append((step, name, len(names), int(round(mine.n)), int(round(other.n)), mine.r2(other),
                         float(np.sqrt(error / other.n)) if other.n > 0 else None))
        return rows
    return _solved(train, held, by, features, nullable, alpha, job,
                   "step int,subset string,n_features int,n_train long,n_held long,r2 double,rmse double", min_rows)


def add_one(train: DataFrame, held: DataFrame, base: Sequence[str], others: Sequence[str], by: Sequence[str] = (), *,
            nullable: Sequence[str] = (), alpha: float = 1.0, min_rows: int = 1) -> DataFrame:
    """(by..., feature, r2_base, r2, gain): each single feature added to the base set, by itself."""
    def job(mine, other, expand):
        mine.fit(expand(base))
        start, rows = mine.r2(other), []
        for f in others:
            for c in expand([f]):
                mine.toggle(c)
            r2 = mine.r2(other)
            rows.append((f, start, r2, None if r2 is None or start is None else r2 - start))
            mine.fit(expand(base))
        return rows
    return _solved(train, held, by, [*base, *others], nullable, alpha, job, "feature string,r2_base double,r2 double,gain double", min_rows)


def importance_order(mine: Moments, features: Sequence[str], expand) -> list[str]:
    """Features by falling strength in the fit of all of them; a flag counts with its feature."""
    mine.fit(expand(features))
    strength = mine.strength()
    return sorted(features, key=lambda f: (-sum(strength.get(c, 0.0) for c in expand([f])), features.index(f)))


def topk_sweep(train: DataFrame, held: DataFrame, features: Sequence[str], sizes: Sequence[int], by: Sequence[str] = (), *,
               epsilon: float = 0.001, nullable: Sequence[str] = (), alpha: float = 1.0, min_rows: int = 1) -> DataFrame:
    """(by..., k, r2, last_feature, chosen): scores of the k strongest features; the smallest k within epsilon of all is chosen."""
    def job(mine, other, expand):
        order = importance_order(mine, list(features), expand)
        scores = []
        for k in sorted({*[s for s in sizes if s < len(features)], len(features)}):
            mine.fit(expand(order[:k]))
            scores.append((k, mine.r2(other), order[k - 1]))
        if scores[-1][1] is None:
            return [(k, None, f, False) for k, _, f in scores]
        best = min(k for k, r2, _ in scores if r2 >= scores[-1][1] - epsilon)
        return [(k, r2, f, k == best) for k, r2, f in scores]
    return _solved(train, held, by, features, nullable, alpha, job, "k int,r2 double,last_feature string,chosen boolean", min_rows)


def eliminate(train: DataFrame, held: DataFrame, features: Sequence[str], by: Sequence[str] = (), *, every: bool = False, tolerance: float = 0.001,
              min_features: int = 1, nullable: Sequence[str] = (), alpha: float = 1.0, min_rows: int = 1) -> DataFrame:
    """(by..., step, n_features, dropped, r2, accepted): features leave one by one while the held-out score stays.

    By default the weakest feature of the current fit is dropped and the score may fall ``tolerance`` below the start.
    With ``every`` each step tries all drops, takes the best one, and ends when that is worse than the best score so far
    by more than the tolerance. The step that ends a search is listed as not accepted.
    """
    def job(mine, other, expand):
        keep = list(features)
        mine.fit(expand(keep))
        best = start = mine.r2(other)
        rows = [(0, len(keep), None, start, True)]
        while start is not None and len(keep) > min_features:
            if every:
                trials = []
                for f in keep:
                    mine.fit(expand([x for x in keep if x != f]))
                    trials.append(mine.r2(other))
                at = max(range(len(keep)), key=lambda k: (trials[k], -k))
                victim, score = keep[at], trials[at]
                good = score >= best - tolerance
            else:
                strength = mine.strength()
                victim = min(keep, key=lambda f: (sum(strength.get(c, 0.0) for c in expand([f])), -keep.index(f)))
                mine.fit(expand([x for x in keep if x != victim]))
                score = mine.r2(other)
                good = score >= start - tolerance
            rows.append((len(rows), len(keep) - 1, victim, score, bool(good)))
            if not good:
                break
            keep.remove(victim)
            best = max(best, score)
            mine.fit(expand(keep))
        return rows
    return _solved(train, held, by, features, nullable, alpha, job,
                   "step int,n_features int,dropped string,r2 double,accepted boolean", min_rows)
