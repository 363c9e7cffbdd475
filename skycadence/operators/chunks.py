"""Windows over long series without one task per series.

``Window.partitionBy("site")`` sends a whole series to one task, so a station
holding a third of all rows becomes the job. Here every series is cut into time
chunks and the unit of work is ``(site, chunk)``:

* ``halo_windows`` / ``on_grid``: frames with a bounded reach. Rows near an edge
  are replicated into the neighbouring chunk, the window runs per chunk, and only
  home rows are kept. One shuffle, no second pass.
* ``carry_last`` / ``running_total`` / ``ordinal``: unbounded frames. Each chunk
  is reduced to one summary row (map-side combined), the summaries are scanned in
  order, and the carry-in is joined back on the partitioning already in place.
* ``row_windows``: row-offset frames on irregular series. ``ordinal`` gives each
  row its position, and positions are chunked like time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from skycadence.functions.timeline import US, floor_div, from_micros, micros
from skycadence.session import parallelism

CHUNK = "_chunk"
HOME = "_home"
SLOT = "_us"
MAX_SLICES = 1 << 20  # keeps slice numbers below the next chunk's
KEYS = ("site",)
ROWS_PER_CHUNK = 1_000_000  # a time chunk that holds more rows is cut
UNPLACED, UNPLACED_PARTS = -(1 << 62), 1024  # chunk numbers of rows without key or time
SPARSE_SLOTS, SLOTS_PER_ROW = 1_000_000, 10_000  # a longer, emptier series has a stray time in it


def _spread(df: DataFrame, parts: int) -> Column:
    """A number below ``parts`` from all columns of a row that can be hashed."""
    kinds = [f.name for f in df.schema.fields if not isinstance(f.dataType, (MapType, VariantType))]
    return F.pmod(F.xxhash64(*kinds), F.lit(parts))


def placed() -> Column:
    """Whether a row has a key and a time, and so a place in a series."""
    return F.col(CHUNK) > F.lit(UNPLACED // 2)


def with_chunk(df: DataFrame, width_s: int, ts: str = "ts", keys: Sequence[str] = KEYS,
               rows_per_chunk: int | None = None) -> DataFrame:
    """Rows with their chunk number. Rows without a key or time have no place in a series; they are kept,
    spread over chunks of their own (see ``placed``), and the operators below give them NULL.

    With ``rows_per_chunk`` (the default of the operators below) a chunk that holds more
    rows is cut, in time order, into slices of about that many, so a burst of readings is not one task's work. Rows
    are first counted per chunk, which combines before the shuffle. Only the chunks above the limit are counted again
    by fine slot (1/86400 of the width; rows within one stay together), and their cuts are broadcast: there is at most
    one cut per ``rows_per_chunk`` rows of the input. Without such a chunk the second count reads nothing.
    """
    us, width = micros(ts), width_s * US
    there = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], us.isNotNull())
    d = df.withColumn(CHUNK, F.when(there, floor_div(us, width)))
    apart = F.lit(UNPLACED) + _spread(df, UNPLACED_PARTS)
    if rows_per_chunk is None:
        return d.withColumn(CHUNK, F.coalesce(CHUNK, apart))
    known = d.select(*keys, CHUNK, floor_div(us, max(width // 86400, 1)).alias("_fine")).where(F.col(CHUNK).isNotNull())
    full = known.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") > rows_per_chunk).drop("_m")
    load = known.join(F.broadcast(full), [*keys, CHUNK]).groupBy(*keys, CHUNK, "_fine").agg(F.count(F.lit(1)).alias("_m"))
    before = Window.partitionBy(*keys, CHUNK).orderBy("_fine").rowsBetween(Window.unboundedPreceding, 0)  # at most 86400 counts each
    part = F.call_function("div", F.sum("_m").over(before) - F.col("_m"), F.lit(rows_per_chunk))
    starts = load.select(*keys, CHUNK, "_fine", part.alias("_slice")).groupBy(*keys, CHUNK, "_slice").agg(F.min("_fine").alias("_from"))
    cuts = starts.where(F.col("_slice") > 0).groupBy(*keys, CHUNK).agg(F.collect_list("_from").alias("_from"))
    d = d.withColumn("_fine", floor_div(us, max(width // 86400, 1))).join(F.broadcast(cuts), [*keys, CHUNK], "left")
    slice_no = F.coalesce(F.size(F.filter("_from", lambda f: f <= F.col("_fine"))), F.lit(0))
    return d.select(*df.columns, F.coalesce(F.col(CHUNK) * F.lit(MAX_SLICES) + F.when(F.col("_from").isNotNull(), slice_no).otherwise(F.lit(0)), apart).alias(CHUNK))


def halo(df: DataFrame, width_s: int, back_s: int = 0, ahead_s: int = 0, ts: str = "ts") -> DataFrame:
    """Copy each row into every chunk whose home interval is within reach."""
    width = width_s * US
    us = micros(ts)
    first = floor_div(us - F.lit(ahead_s * US), width)
    last = floor_div(us + F.lit(back_s * US), width)
    return (df.withColumn(CHUNK, F.explode(F.sequence(first, last)))
            .withColumn(HOME, F.col(CHUNK) == floor_div(us, width)))


def halo_windows(df: DataFrame, fn: Callable, *, width_s: int, back_s: int = 0, ahead_s: int = 0,
                 keys: Sequence[str] = KEYS, ts: str = "ts", ties: Sequence[str] = ()) -> DataFrame:
    """Apply ``fn(df, window)`` per (key, chunk) and keep home rows.

    ``fn`` may look back at most ``back_s`` and ahead at most ``ahead_s`` seconds.
    """
    cut = halo(df, width_s, back_s, ahead_s, ts)
    w = Window.partitionBy(*keys, CHUNK).orderBy(ts, *ties)
    return fn(cut, w).where(F.col(HOME)).drop(CHUNK, HOME)


def series_bounds(df: DataFrame, step_s: int, keys: Sequence[str] = KEYS, ts: str = "ts") -> DataFrame:
    """First and last grid slot of each series, as microseconds.

    A series of more than a million slots with over 10,000 slots per reading is refused: one reading with a stray
    time (1970, 9999) would make a grid of almost nothing but empty slots."""
    step = F.lit(step_s * US).cast("long")
    agg = df.groupBy(*keys).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"), F.count(ts).alias("_rows"))
    lo, hi = micros("_lo"), micros("_hi")
    slots = F.call_function("div", hi - lo, step)
    stray = (slots > SPARSE_SLOTS) & (slots > F.col("_rows") * F.lit(SLOTS_PER_ROW))
    text = F.concat(F.lit("stray time in series "), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]), F.lit(": from "),
                    F.col("_lo").cast("string"), F.lit(" to "), F.col("_hi").cast("string"))
    low = F.when(stray, F.raise_error(text).cast("long")).otherwise(lo - F.pmod(lo, step))
    return agg.select(*keys, low.alias("_lo"), (hi - F.pmod(hi, step)).alias("_hi"))


def grid_slots(bounds: DataFrame, step_s: int, chunk_steps: int, back: int = 0, ahead: int = 0,
               keys: Sequence[str] = KEYS) -> DataFrame:
    """Every grid slot between the bounds, one output task per (key, chunk).

    The slots are generated after the chunks are spread over the cluster, so a
    long series is not unrolled by the task that holds its bounds row.
    """
    step, width = step_s * US, step_s * chunk_steps * US
    chunks = bounds.select(*keys, "_lo", "_hi", F.explode(F.sequence(
        floor_div(F.col("_lo"), width), floor_div(F.col("_hi"), width))).alias(CHUNK))
    chunks = chunks.repartition(parallelism(bounds.sparkSession), *keys, CHUNK)
    start = F.greatest(F.col("_lo"), F.col(CHUNK) * F.lit(width) - F.lit(back * step))
    stop = F.least(F.col("_hi"), (F.col(CHUNK) + 1) * F.lit(width) - F.lit(step) + F.lit(ahead * step))
    return chunks.select(*keys, CHUNK, F.explode(
        F.sequence(start, stop, F.lit(step).cast("long"))).alias(SLOT))


def on_grid(sources: Sequence[DataFrame], fn: Callable | None = None, *, step_s: int,
            bounds: DataFrame, back: int = 0, ahead: int = 0, chunk_steps: int = 1008,
            keys: Sequence[str] = KEYS, ts: str = "ts") -> DataFrame:
    """Merge binned sources onto a gap-free grid and run windows on it.

    Each source is unique on ``keys + ts`` with ``ts`` on the grid. Instead of one
    join per source, all sources and the empty slots are unioned, shuffled once on
    ``(key, chunk)``, merged by a slot aggregate and windowed in the same stage.
    A row offset of k equals a time offset of k steps on the result.

    ``fn(df, window)`` may use at most ``back`` slots behind and ``ahead`` in front.
    """
    width = step_s * chunk_steps * US
    parts = []
    for src in sources:
        cut = halo(src, step_s * chunk_steps, back * step_s, ahead * step_s, ts).drop(HOME)
        parts.append(cut.withColumn(SLOT, micros(ts)).drop(ts))
    merged = grid_slots(bounds, step_s, chunk_steps, back, ahead, keys).withColumn("_in", F.lit(True))
    for part in parts:
        merged = merged.unionByName(part, allowMissingColumns=True)
    measures = [c for c in merged.columns if c not in (*keys, CHUNK, SLOT)]
    cells = (merged.repartition(*keys, CHUNK).groupBy(*keys, CHUNK, SLOT)
             .agg(*[F.first(c, ignorenulls=True).alias(c) for c in measures]))
    cells = cells.where(F.col("_in")).drop("_in")  # source rows outside the bounds
    cells = cells.withColumn(ts, from_micros(F.col(SLOT)))
    w = Window.partitionBy(*keys, CHUNK).orderBy(SLOT)
    out = fn(cells, w) if fn else cells
    home = floor_div(F.col(SLOT), width) == F.col(CHUNK)
    return out.where(home).drop(CHUNK, SLOT)


def carry_last(df: DataFrame, values: dict[str, Column], *, width_s: int, order: Sequence[str] = ("ts",),
               keys: Sequence[str] = KEYS, ts: str = "ts", include_current: bool = True,
               rows_per_chunk: int | None = ROWS_PER_CHUNK) -> DataFrame:
    """Last non-NULL value so far, without a limit on the distance.

    ``values`` maps output name to the expression carried. With
    ``include_current=False`` the row's own value does not count, which gives
    "previous row" semantics on irregular series.
    """
    d = with_chunk(df, width_s, ts, keys, rows_per_chunk)
    names = list(values)
    d = d.select("*", *[values[n].alias(f"_v_{n}") for n in names])
    at = F.struct(*order)
    tails = d.groupBy(*keys, CHUNK).agg(*[
        F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), at)).alias(f"_t_{n}") for n in names])
    over_chunks = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.where(placed()).select(*keys, CHUNK, *[
        F.last(f"_t_{n}", ignorenulls=True).over(over_chunks).alias(f"_c_{n}") for n in names])
    w = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0 if include_current else -1)
    local = d.select("*", *[F.last(f"_v_{n}", ignorenulls=True).over(w).alias(f"_l_{n}") for n in names])
    joined = local.join(carry, [*keys, CHUNK], "left")
    keep = [c for c in df.columns if c not in names]
    return joined.select(*keep, *[F.when(placed(), F.coalesce(f"_l_{n}", f"_c_{n}")).alias(n) for n in names])


def carry_next(df: DataFrame, values: dict[str, Column], *, width_s: int, order: Sequence[str] = ("ts",),
               keys: Sequence[str] = KEYS, ts: str = "ts", rows_per_chunk: int | None = ROWS_PER_CHUNK) -> DataFrame:
    """First non-NULL value from the current row on (mirror of ``carry_last``)."""
    d = with_chunk(df, width_s, ts, keys, rows_per_chunk)
    names = list(values)
    d = d.select("*", *[values[n].alias(f"_v_{n}") for n in names])
    at = F.struct(*order)
    heads = d.groupBy(*keys, CHUNK).agg(*[
        F.min_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), at)).alias(f"_t_{n}") for n in names])
    over_chunks = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(1, Window.unboundedFollowing)
    carry = heads.where(placed()).select(*keys, CHUNK, *[
        F.first(f"_t_{n}", ignorenulls=True).over(over_chunks).alias(f"_c_{n}") for n in names])
    # A reversed running frame streams; (current, unbounded following) would be quadratic.
    w = (Window.partitionBy(*keys, CHUNK).orderBy(*[F.col(c).desc() for c in order])
         .rowsBetween(Window.unboundedPreceding, 0))
    local = d.select("*", *[F.last(f"_v_{n}", ignorenulls=True).over(w).alias(f"_l_{n}") for n in names])
    joined = local.join(carry, [*keys, CHUNK], "left")
    keep = [c for c in df.columns if c not in names]
    return joined.select(*keep, *[F.when(placed(), F.coalesce(f"_l_{n}", f"_c_{n}")).alias(n) for n in names])


def running_total(df: DataFrame, sums: dict[str, Column], *, width_s: int, order: Sequence[str] = ("ts",),
                  keys: Sequence[str] = KEYS, ts: str = "ts", rows_per_chunk: int | None = ROWS_PER_CHUNK) -> DataFrame:
    """Cumulative sums over whole series, current row included."""
    d = with_chunk(df, width_s, ts, keys, rows_per_chunk)
    names = list(sums)
    d = d.select("*", *[sums[n].alias(f"_v_{n}") for n in names])
    totals = d.groupBy(*keys, CHUNK).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in names])
    over_chunks = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.where(placed()).select(*keys, CHUNK, *[
        F.sum(f"_t_{n}").over(over_chunks).alias(f"_c_{n}") for n in names])
    w = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = d.select("*", *[F.sum(f"_v_{n}").over(w).alias(f"_l_{n}") for n in names])
    joined = local.join(offsets, [*keys, CHUNK], "left")
    return joined.select(*df.columns, *[
        F.when(placed(), F.coalesce(f"_l_{n}", F.lit(0)) + F.coalesce(f"_c_{n}", F.lit(0))).alias(n) for n in names])


def ordinal(df: DataFrame, *, width_s: int, order: Sequence[str] = ("ts",), keys: Sequence[str] = KEYS,
            ts: str = "ts", name: str = "idx", total: str | None = None, rows_per_chunk: int | None = ROWS_PER_CHUNK) -> DataFrame:
    """1-based position of each row in its series, and optionally the series size."""
    d = with_chunk(df, width_s, ts, keys, rows_per_chunk)
    sizes = d.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("_m"))
    per_key = Window.partitionBy(*keys)
    ahead_of = per_key.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.where(placed()).select(*keys, CHUNK,
                           F.coalesce(F.sum("_m").over(ahead_of), F.lit(0)).alias("_off"),
                           F.sum("_m").over(per_key).alias("_tot"))
    w = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    local = d.withColumn("_local", F.row_number().over(w))
    out = local.join(offsets, [*keys, CHUNK], "left").select(
        *df.columns, F.when(placed(), F.col("_off") + F.col("_local")).alias(name),
        *([F.when(placed(), F.col("_tot")).alias(total)] if total else []))
    return out


def row_windows(df: DataFrame, fn: Callable, *, back: int = 0, ahead: int = 0, rows_per_chunk: int = 100_000,
                width_s: int = 86400, order: Sequence[str] = ("ts",), keys: Sequence[str] = KEYS,
                ts: str = "ts") -> DataFrame:
    """Row-offset windows on an irregular series, in equal-sized chunks.

    ``fn(df, window)`` may reach ``back`` rows behind and ``ahead`` rows in front. A row without
    key or time is kept and sees no other row (but its copies).
    """
    d = ordinal(df, width_s=width_s, order=order, keys=keys, ts=ts, name="_idx")
    n = rows_per_chunk
    first = floor_div(F.col("_idx") - F.lit(ahead), n)
    last = floor_div(F.col("_idx") + F.lit(back), n)
    d = d.withColumn(CHUNK, F.explode_outer(F.sequence(first, last)))
    d = d.withColumn(CHUNK, F.coalesce(CHUNK, F.lit(UNPLACED) + _spread(df, 1 << 60)))
    w = Window.partitionBy(*keys, CHUNK).orderBy("_idx")
    out = fn(d, w).where(F.coalesce(floor_div(F.col("_idx"), n) == F.col(CHUNK), F.lit(True)))
    return out.drop(CHUNK, "_idx")
