"""Exact analog ensemble: mean target of the k nearest training rows.

Training rows are cut into blocks by their distance to a pivot. By the triangle
inequality a neighbour within d of a query lies in a block whose pivot-distance
range comes within d of the query's own. So a first pass in the query's home block
gives an upper bound, and a second pass visits only the blocks the bound leaves
open, without copying queries or blocks. Results equal a full comparison; nothing is approximated or capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skycadence.operators.ranks import ranked_values
from skycadence.sources.sinks import materialize

C = F.col
LANES = 4   # groups of training blocks in the second pass: a query gets k candidates from each at most
TILES = 4   # tiles of queries that meet a lane in one task
MAX_BLOCKS = 65_536  # bounds of groups of blocks held by the driver and each Python worker: 1.5 MB


def standardize(df: DataFrame, vec: str, train: Column, out: str = "z") -> DataFrame:
    """Element-wise standardisation of an array column with training statistics.

    The statistics are two numbers per dimension; constant dimensions become 0.
    """
    stats = (df.where(train).select(F.posexplode(vec).alias("i", "v")).groupBy("i")
             .agg(F.avg(C("v").cast("double")).alias("m"), F.stddev_pop(C("v").cast("double")).alias("s")).orderBy("i").collect())
    mean = F.array(*[F.lit(float(r["m"])) for r in stats])
    inv = F.array(*[F.lit(0.0 if not r["s"] else 1.0 / float(r["s"])) for r in stats])
    centred = F.zip_with(C(vec), mean, lambda v, m: v.cast("double") - m)
    return df.withColumn(out, F.zip_with(centred, inv, lambda v, s: v * s))


def _norm(vec: str) -> Column:
    """Distance to the pivot; the training mean is the origin after standardising."""
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, v: a + v * v))


def _block_neighbours(k: int, q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
    """k best pairs per query within one block (a bounded numpy tile)."""
    if q.empty or x.empty:
        return pd.DataFrame({"qid": pd.Series(dtype="int64"), "xid": pd.Series(dtype="int64"), "dist": pd.Series(dtype="float64"),
                             "y": pd.Series(dtype="float64")})
    a, b = np.stack(q["z"].to_numpy()), np.stack(x["z"].to_numpy())
    ids, ys = x["xid"].to_numpy(), x["y"].to_numpy(dtype="float64")
    bb = (b * b).sum(axis=1)
    parts = []
    for lo in range(0, len(a), 256):
        part = a[lo:lo + 256]
        aa = (part * part).sum(axis=1)
        near = aa[:, None] + bb[None, :] - 2 * part @ b.T  # squared distances up to rounding
        kth = np.partition(near, min(k, len(b)) - 1, axis=1)[:, min(k, len(b)) - 1]
        i, j = np.nonzero(near <= (kth + 1e-9 * (aa + bb.max()))[:, None])
        d = np.sqrt(((b[j] - part[i]) ** 2).sum(axis=1))
        order = np.lexsort((ids[j], d, i))
        i, j, d = i[order], j[order], d[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        parts.append(pd.DataFrame({"qid": q["qid"].to_numpy()[lo + i[keep]], "xid": ids[j[keep]], "dist": d[keep], "y": ys[j[keep]]}))
    return pd.concat(parts, ignore_index=True)


def _search(queries: DataFrame, train: DataFrame, k: int, tile: int) -> DataFrame:
    """Candidates of ``queries(qid, z, blk)`` against ``train(xid, z, y, blk)`` per block.

    A block asked for by many queries is served by several tasks: its queries are
    dealt over ``ceil(n / tile)`` salts and the block is copied to each.
    """
    load = queries.groupBy("blk").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(tile))).cast("int").alias("_salts"))
    q = queries.join(load, ["blk"]).withColumn("_salt", F.pmod(F.xxhash64("qid"), C("_salts")).cast("int")).drop("_salts")
    x = train.join(load, ["blk"]).withColumn("_salt", F.explode(F.sequence(F.lit(0), C("_salts") - 1))).drop("_salts")
    return q.groupBy("blk", "_salt").cogroup(x.groupBy("blk", "_salt")).applyInPandas(
        lambda a, b: _block_neighbours(k, a, b), "qid long, xid long, dist double, y double")


def _best(cand: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy("dist", "xid")  # row_number <= k is pruned before the shuffle
    return cand.withColumn("_r", F.row_number().over(w)).where(C("_r") <= k)


def _home_finder(lo: np.ndarray, ids: np.ndarray):
    """Vectorised lookup in sorted bounds (at most MAX_BLOCKS entries)."""
    def home(piv: pd.Series) -> pd.Series:
        at = np.clip(np.searchsorted(lo, piv.to_numpy(), side="right") - 1, 0, None)
        return pd.Series(ids[at])

    return F.pandas_udf(home, "long")


def _bytes(values, kind) -> bytes:
    return np.ascontiguousarray(values, dtype=kind).tobytes()


def _pack_block(x: pd.DataFrame) -> pd.DataFrame:
    """A block of training rows as one row."""
    ids = x["xid"].fillna(np.iinfo("int64").min)
    return pd.DataFrame({"blk": x["blk"].iloc[:1], "lo": x["piv"].min(), "hi": x["piv"].max(), "xz": [_bytes(np.stack(x["z"].to_numpy()), "f8")],
                         "xids": [_bytes(ids, "i8")], "ys": [_bytes(x["y"], "f8")]})


def _pack_queries(q: pd.DataFrame) -> pd.DataFrame:
    """A tile of queries as one row, with the range of pivot distances they reach."""
    # NULL distance: the home block held fewer than k rows, so every block stays open.
    far = q["far"].to_numpy(dtype="float64")
    r = np.where(np.isnan(far), np.inf, far * (1.0 + 1e-9) + 1e-9)
    piv = q["piv"].to_numpy(dtype="float64")
    return pd.DataFrame({"first": [float(np.fmin.reduce(piv - r))], "last": [float(np.fmax.reduce(piv + r))], "qz": [_bytes(np.stack(q["z"].to_numpy()), "f8")],
                         "qids": [_bytes(q["qid"], "i8")], "piv": [_bytes(piv, "f8")], "r": [_bytes(r, "f8")], "home": [_bytes(q["_home"], "i8")]})


class _Nearest:
    """The k nearest rows so far of each query of a tile; the arrays hold k entries a query."""

    def __init__(self, t, k: int):
        self.k, self.qids = k, np.frombuffer(t.qids, "i8")
        self.piv, self.r, self.home = np.frombuffer(t.piv), np.frombuffer(t.r), np.frombuffer(t.home, "i8")
        shape = (len(self.qids), k)
        self.dist, self.ids, self.ys = np.full(shape, np.inf), np.zeros(shape, "i8"), np.full(shape, np.nan)

    def add(self, t) -> None:
        """Compare with a block: the queries whose reach it meets, but those whose home it is."""
        k, n = self.k, len(self.qids)
        reach = np.minimum(self.r, self.dist[:, -1] * (1.0 + 1e-9) + 1e-9)
        open_ = np.flatnonzero((t.hi >= self.piv - reach) & (t.lo <= self.piv + reach) & (self.home != t.blk))
        if not len(open_):
            return
        ids, ys = np.frombuffer(t.xids, "i8"), np.frombuffer(t.ys)
        a, b = np.frombuffer(t.qz).reshape(n, -1), np.frombuffer(t.xz).reshape(len(ids), -1)
        bb = (b * b).sum(axis=1)
        for lo in range(0, len(open_), 256):
            at = open_[lo:lo + 256]
            part = a[at]
            aa = (part * part).sum(axis=1)
            near = aa[:, None] + bb[None, :] - 2 * part @ b.T  # squared distances up to rounding
            slack = 1e-9 * (aa + bb.max())
            hit = near <= (reach[at] ** 2 + slack)[:, None]
            if hit.sum() > 4 * k * len(at) and k < len(b):
                hit &= near <= (np.partition(near, k - 1, axis=1)[:, k - 1] + slack)[:, None]
            i, j = np.nonzero(hit)
            if not len(i):
                continue
            d = np.sqrt(((b[j] - part[i]) ** 2).sum(axis=1))
            some, i = np.unique(i, return_inverse=True)  # queries with new rows, merged with what they have
            row = at[some]
            i = np.concatenate([np.repeat(np.arange(len(row)), k), i])
            d, x, y = (np.concatenate([old[row].ravel(), new]) for old, new in ((self.dist, d), (self.ids, ids[j]), (self.ys, ys[j])))
            order = np.lexsort((x, d, i))
            i, d, x, y = i[order], d[order], x[order], y[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < k
            self.dist[row], self.ids[row], self.ys[row] = (v[keep].reshape(-1, k) for v in (d, x, y))

    def found(self) -> pd.DataFrame:
        i, j = np.nonzero(np.isfinite(self.dist))
        return pd.DataFrame({"qid": self.qids[i], "xid": self.ids[i, j], "dist": self.dist[i, j], "y": self.ys[i, j]})


def _search_open(q: DataFrame, x: DataFrame, k: int, tile: int) -> DataFrame:
    """Candidates of ``q(qid, z, piv, _home, far)`` from the blocks of ``x`` other than home that ``far`` leaves open.

    No query and no block is copied: each is written once, packed, and every pair of a group of tiles and a lane of blocks
    is one task that streams the blocks and keeps k rows a query. So what is shuffled is the input and k rows per query
    and lane, however many blocks are open."""
    blocks = materialize(x.groupBy("blk").applyInPandas(_pack_block, "blk long, lo double, hi double, xz binary, xids binary, ys binary"), "analogs-blocks")
    q = materialize(q, "analogs-open")
    # Tiles hold neighbours in pivot distance: the queries of so many home blocks, dealt over salts where these have many.
    per = max(1, tile * blocks.count() // max(1, q.count()))
    q = q.withColumn("_tile", F.call_function("div", C("_home"), F.lit(per).cast("long")))
    load = q.groupBy("_tile").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(tile))).cast("int").alias("_salts"))
    q = q.join(load, "_tile").withColumn("_salt", F.pmod(F.xxhash64("qid"), C("_salts")).cast("int"))
    kinds = "first double, last double, qz binary, qids binary, piv binary, r binary, home binary"
    tiles = materialize(q.groupBy("_tile", "_salt").applyInPandas(_pack_queries, kinds), "analogs-tiles").withColumn("no", F.monotonically_increasing_id())
    tiles = tiles.repartition(max(1, -(-tiles.count() // TILES)))
    pairs = blocks.coalesce(LANES).join(tiles.hint("shuffle_replicate_nl"), (C("hi") >= C("first")) & (C("lo") <= C("last")))

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[int, _Nearest] = {}
        for frame in frames:
            for t in frame.itertuples(index=False):
                if t.no not in kept:
                    kept[t.no] = _Nearest(t, k)
                kept[t.no].add(t)
        for nearest in kept.values():
            yield nearest.found()

    return pairs.mapInPandas(search, "qid long, xid long, dist double, y double")


def analog_ensemble(queries: DataFrame, train: DataFrame, *, qid: str, xid: str, vec: str, y: str, k: int = 30, rows_per_block: int = 4096,
                    tile: int = 4096) -> DataFrame:
    """``qid, n, analog_mean, farthest``: mean target of the k nearest training rows."""
    x = train.select(C(xid).cast("long").alias("xid"), C(vec).alias("z"), C(y).cast("double").alias("y"), _norm(vec).alias("piv"))
    q = queries.select(C(qid).cast("long").alias("qid"), C(vec).alias("z"), _norm(vec).alias("piv"))
    # Equal-sized blocks in pivot distance. Copies of one vector share a distance and
    # are dealt over the rank range they cover, so they never pile up in one block.
    ranks = ranked_values(x, "piv").select(C("_v").alias("piv"), "_lo", "_c")
    spot = C("_lo") + F.pmod(F.xxhash64("xid"), C("_c"))
    x = x.join(ranks, ["piv"]).select("xid", "z", "y", "piv", F.call_function("div", spot, F.lit(rows_per_block)).alias("blk"))
    x = materialize(x, "analogs")
    # Blocks keep their size; where there are very many, the driver holds the bounds of groups of them, and the bounds of
    # the blocks of an open group are joined.
    fine = x.groupBy("blk").agg(F.min("piv").alias("lo"), F.max("piv").alias("hi"))
    fine = materialize(fine, "analogs-bounds")
    per_group = -(-max((fine.agg(F.max("blk")).first()[0] or 0) + 1, 1) // MAX_BLOCKS)
    fine = fine.withColumn("grp", F.call_function("div", C("blk"), F.lit(per_group)))
    bounds = fine.groupBy("grp").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("grp").collect()  # <= MAX_BLOCKS rows
    home = _home_finder(np.array([b["lo"] for b in bounds]), np.array([b["grp"] for b in bounds]))
    q = q.withColumn("grp", home("piv"))
    if per_group == 1:
        q = q.withColumn("_home", C("grp")).drop("grp")
    else:  # the last block of the group that starts at or below the query, else the group's first
        inside = q.select("qid", "piv", "grp").join(fine, "grp").groupBy("qid").agg(
            F.coalesce(F.max(F.when(C("lo") <= C("piv"), C("blk"))), F.min("blk")).alias("_home"))
        q = q.drop("grp").join(inside, "qid")
    first = materialize(_best(_search(q.select("qid", "z", C("_home").alias("blk")), x, k, tile), k).drop("_r"), "analogs-home")
    limit = first.groupBy("qid").agg(F.max("dist").alias("_d"), F.count(F.lit(1)).alias("_n"))
    far = F.when(C("_n") >= k, C("_d"))
    more = q.join(limit, ["qid"], "left").select("qid", "z", "piv", "_home", far.alias("far"))
    best = _best(first.unionByName(_search_open(more, x, k, min(tile, 1024))), k)
    return best.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("analog_mean"), F.max("dist").alias("farthest"))
