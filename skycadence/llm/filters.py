"""Filters over 64-bit keys that tasks look things up in: built by Spark in blocks, broadcast at a bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS_PER_ENTRY, MAX_SLOTS, BLOCK = 8, 1 << 26, 1 << 16


def key_filter(keyed: DataFrame, entries: int, max_slots: int | None = None, block: int | None = None):
    """Broadcast filter over (key, flag): two slots a key, as many slots as the number of entries asks for.

    Flags of one key, and of keys that meet in a slot, are joined bit by bit: a lookup may say too much and never too
    little. Beyond MAX_SLOTS (64 MB) the filter gets fuller, so more is looked at in vain and nothing is lost."""
    max_slots, block = max_slots or MAX_SLOTS, block or BLOCK
    bits = min(max(block, SLOTS_PER_ENTRY * entries - 1), max_slots - 1).bit_length()
    key = F.col("key")
    two = F.array(F.shiftrightunsigned(key, 64 - bits), F.shiftrightunsigned(F.shiftleft(key, bits), 64 - bits))
    slots = keyed.select(F.explode(two).alias("slot"), "flag").groupBy("slot").agg(F.bit_or("flag").alias("flag"))

    def packed(group: pa.Table) -> pa.Table:  # a block has at most `block` slots
        out = np.zeros(block, np.uint8)
        out[group.column("slot").to_numpy() % block] = group.column("flag").to_numpy()
        return pa.table({"block": group.column("block")[:1], "bits": pa.array([out.tobytes()], pa.binary())})

    table = np.zeros(1 << bits, np.uint8)
    blocks = slots.withColumn("block", F.floor(F.col("slot") / block)).groupBy("block")
    for row in blocks.applyInArrow(packed, "block long, bits binary").collect():
        table[row["block"] * block:(row["block"] + 1) * block] = np.frombuffer(row["bits"], np.uint8)
    return keyed.sparkSession.sparkContext.broadcast(table.tobytes())


def flags(table: np.ndarray, key: np.ndarray) -> np.ndarray:
    """What the filter says of keys: the two slots of a key are its first and its next bits."""
    bits = np.uint64(len(table).bit_length() - 1)
    rest = np.uint64(64) - bits
    return table[(key >> rest).astype(np.int64)] & table[((key << bits) >> rest).astype(np.int64)]
