"""Sharding by best-fit-decreasing bin packing: groups of equal texts, largest
first, each go into the shard with the tightest remaining capacity that holds
them, found in a balanced tree.

The few largest groups (their number is bounded by the share of all bytes or
rows they hold) are packed at the driver. All others are dealt into cells;
each cell packs its groups into its own part of every shard's remaining
capacity, so that no task sees all groups and the shards fill evenly.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from platewise.llm.common import materialise, text_or_empty

#: A group with this share of all bytes, or of all rows, is packed at the
#: driver: there are at most twice as many such groups as the divisor says.
LARGE = 4096
#: Groups under total / SMALL form the second tier of cells.
SMALL = 1 << 22
#: Groups of a cell, about, and the most cells of the first tier: its cells
#: must stay far larger than its groups.
PER_CELL, FIRST_CELLS = 50_000, 16
#: Rows that one window numbers, about.
PER_BUCKET = 20_000


class CapacityTree:
    """Bins by (remaining capacity, bin) in a balanced (AA) tree."""

    def __init__(self):
        self.root: list | None = None  # [key, level, left, right]

    def add(self, room: float, bin_: int) -> None:
        self.root = self._add(self.root, (room, bin_))

    def _add(self, n, key):
        if n is None:
            return [key, 1, None, None]
        side = 2 if key < n[0] else 3
        n[side] = self._add(n[side], key)
        return self._split(self._skew(n))

    @staticmethod
    def _skew(n):
        left = n and n[2]
        if left and left[1] == n[1]:
            n[2], left[3] = left[3], n
            return left
        return n

    @staticmethod
    def _split(n):
        right = n and n[3]
        if right and right[3] and right[3][1] == n[1]:
            n[3], right[2] = right[2], n
            right[1] += 1
            return right
        return n

    def remove(self, room: float, bin_: int) -> None:
        self.root = self._remove(self.root, (room, bin_))

    def _remove(self, n, key):
        if n is None:
            return None
        if key == n[0]:
            if n[2] is None and n[3] is None:
                return None
            if n[2] is None:
                next_ = n[3]
                while next_[2]:
                    next_ = next_[2]
                n[0], n[3] = next_[0], self._remove(n[3], next_[0])
            else:
                next_ = n[2]
                while next_[3]:
                    next_ = next_[3]
                n[0], n[2] = next_[0], self._remove(n[2], next_[0])
        else:
            side = 2 if key < n[0] else 3
            n[side] = self._remove(n[side], key)
        level = 1 + min(n[2][1] if n[2] else 0, n[3][1] if n[3] else 0)
        if level < n[1]:
            n[1] = level
            if n[3] and n[3][1] > level:
                n[3][1] = level
        n = self._skew(n)
        if n[3]:
            n[3] = self._skew(n[3])
            if n[3][3]:
                n[3][3] = self._skew(n[3][3])
        n = self._split(n)
        if n[3]:
            n[3] = self._split(n[3])
        return n

    def tightest(self, size: float) -> tuple[float, int] | None:
        """The bin with the least room that still holds ``size``."""
        n, best = self.root, None
        while n:
            if n[0][0] >= size:
                best, n = n[0], n[2]
            else:
                n = n[3]
        return best

    def roomiest(self) -> tuple[float, int] | None:
        n = self.root
        while n and n[3]:
            n = n[3]
        return n and n[0]


def best_fit_decreasing(sizes: list[int], rooms: list[float] | None = None,
                        capacity: float | None = None) -> tuple[list[int], list[float]]:
    """The bin of each size and the bins' remaining rooms.

    With ``rooms`` the bins are given, and what fits in none goes to the
    roomiest. With ``capacity`` bins of that capacity are opened as needed; a
    larger size gets a bin of its own. Ties keep the order of ``sizes``."""
    tree, left = CapacityTree(), list(rooms or [])
    for b, room in enumerate(left):
        tree.add(room, b)
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = tree.tightest(sizes[i])
        if found is None and capacity is not None:
            found = (capacity, len(left))
            left.append(capacity)
            tree.add(*found)
        found = found or tree.roomiest()
        tree.remove(*found)
        out[i] = found[1]
        left[found[1]] = found[0] - sizes[i]
        tree.add(left[found[1]], found[1])
    return out, left


def _pack_cell(rooms: list[float]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Packs one cell's groups into its share of every shard's room."""
    shares = np.array(rooms) / sum(rooms)

    def pack(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values(["bytes", "key"], ascending=[False, True])
        shard, _ = best_fit_decreasing(cell["bytes"].tolist(), (shares * cell["bytes"].sum()).tolist())
        return pd.DataFrame({"key": cell["key"].to_numpy(), "shard": np.array(shard, np.int32),
                             "bytes": cell["bytes"].to_numpy()})

    return pack


def _assign(groups: DataFrame, shards: int, capacity: float, total: int, rows: int) -> tuple[list, DataFrame]:
    """The large groups as (key, part, parts, shard, bytes), and a table
    (key, shard, bytes) of all others."""
    large = (F.col("bytes") * LARGE >= total) | (F.col("rows") * LARGE >= rows)
    items = []
    for g in sorted(groups.filter(large).collect(), key=lambda g: (-g["bytes"], g["key"])):
        parts = max(1, math.ceil(g["bytes"] / capacity))  # only what no shard holds is split
        items += [(g["key"], p, parts, g["bytes"] / parts) for p in range(parts)]
    where, rooms = best_fit_decreasing([x[3] for x in items], [capacity] * shards)
    placed = [(k, p, n, s, size) for (k, p, n, size), s in zip(items, where)]
    rooms = [max(r, 0.0) for r in rooms]
    if not sum(rooms):
        rooms = [1.0] * shards
    light = groups.filter(~large).withColumn("tier", (F.col("bytes") * SMALL < total).cast("int"))
    sizes = {r["tier"]: r["n"] for r in light.groupBy("tier").agg(F.count(F.lit(1)).alias("n")).collect()}
    cells = [max(1, math.ceil(sizes.get(t, 0) / PER_CELL)) for t in (0, 1)]
    count = F.when(F.col("tier") == 0, min(cells[0], FIRST_CELLS)).otherwise(cells[1])
    light = light.withColumn("cell", F.pmod(F.xxhash64("key"), count))
    packed = light.groupBy("tier", "cell").applyInPandas(_pack_cell(rooms), "key long, shard int, bytes long")
    return placed, materialise(packed, "shard-packed")


def shard_documents(docs: DataFrame, shards: int = 16, capacity: int | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored):
    doc_id, size, text_crc32, shard, slot.

    A size is the text's UTF-8 bytes plus 1 (null: 1, as for an empty text).
    Rows of equal texts stay together; only a group that is larger than a
    whole shard is split. Without ``capacity`` there are ``shards`` of near
    equal bytes. With it there are as few shards of that capacity as hold
    all. ``slot`` numbers a shard's rows from 0 without gaps. An empty table
    gives none; rows that repeat are rows of their own."""
    spark = docs.sparkSession
    rows = materialise(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text_or_empty()) + 1).cast("long").alias("size"),
        F.crc32(text_or_empty()).alias("text_crc32"), F.xxhash64(text_or_empty()).alias("key"),
        F.monotonically_increasing_id().alias("rid")), "shard-rows")
    groups = materialise(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")),
                         "shard-groups")
    total, n = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    if capacity is None:
        placed, packed = _assign(groups, shards, max(1, total / shards), total, n)
    else:
        shards = max(1, math.ceil(total / capacity))
        while True:
            placed, packed = _assign(groups, shards, capacity, total, n)
            used = [0.0] * shards
            for r in packed.groupBy("shard").agg(F.sum("bytes").alias("b")).collect():
                used[r["shard"]] += r["b"]
            for *_, s, size in placed:
                used[s] += size
            if max(used) <= capacity:
                break
            shards += 1

    large = spark.createDataFrame([x[:4] for x in placed], "key long, part int, parts int, shard int")  # bounded
    parts = large.select("key", "parts").distinct()
    rows = rows.join(F.broadcast(parts), "key", "left")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int"))
    columns = ["doc_id", "size", "text_crc32", "rid", "shard"]
    split = rows.filter(F.col("parts").isNotNull()).join(F.broadcast(large.drop("parts")), ["key", "part"])
    whole = rows.filter(F.col("parts").isNull()).join(packed.select("key", "shard"), "key")
    buckets = max(1, math.ceil(n / (shards * PER_BUCKET)))
    dealt = split.select(columns).unionByName(whole.select(columns))
    dealt = materialise(dealt.withColumn("bucket", F.pmod(F.xxhash64("rid"), F.lit(buckets))), "shard-dealt")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    offsets = offsets.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    order = Window.partitionBy("shard", "bucket").orderBy(F.col("doc_id").asc_nulls_last(), "rid")
    numbered = dealt.withColumn("at", F.row_number().over(order) - 1).join(offsets, ["shard", "bucket"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("at")).alias("slot"))
