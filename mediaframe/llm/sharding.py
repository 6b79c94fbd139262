"""Minimax contiguous partition of ordered atomic groups into shards.

Groups (equal texts) are ordered by a 64-bit hash of their text. The smallest capacity C for which a
greedy walk over the group sizes needs at most ``n_shards`` shards is found by binary search, and the
walk at that capacity gives the cuts. The driver never sees the groups themselves: it holds sums of
hash-prefix blocks, and only blocks in which a cut can still lie are refined (by 4 more hash bits a
round) until each of them is one group, so the answer is exact at any number of groups with a few
thousand block sums in the driver.

Edge cases: a null text has no bytes and counts as the empty text; rows with equal text share a shard
whatever their ids; an empty table gives an empty result; fewer groups than shards leave shards empty.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


class Blocks:
    """Ordered blocks of groups: first key, sum, number of groups (1: atomic), largest group (then hash bits and prefix)."""

    def __init__(self, rows):
        rows = sorted(rows)
        self.key = [r[0] for r in rows]
        self.sums = np.array([r[1] for r in rows], dtype=np.int64)
        self.n = np.array([r[2] for r in rows], dtype=np.int64)
        self.top = max((r[3] for r in rows), default=0)
        self.ends = np.cumsum(self.sums)
        self.starts = self.ends - self.sums
        self.total = int(self.ends[-1]) if len(rows) else 0

    def walk(self, capacity: int, shards: int, split: bool) -> list[int] | None:
        """Ends of the shards of the greedy walk, or None if more are needed. ``split``: blocks of several groups may be cut anywhere."""
        at, ends = 0, []
        for _ in range(shards):
            if at >= self.total:
                break
            to = at + capacity
            if to < self.total:
                i = int(np.searchsorted(self.ends, to, "right"))  # the block in which the limit lies
                if not (split and self.n[i] > 1):
                    to = int(self.starts[i])
                if to <= at:
                    return None
            at = min(to, self.total)
            ends.append(at)
        return ends if at >= self.total else None

    def least(self, shards: int, split: bool) -> int:
        lo, hi = max(self.top, -(-self.total // shards), 1), max(self.total, 1)
        while lo < hi:
            mid = (lo + hi) // 2
            if self.walk(mid, shards, split) is None:
                lo = mid + 1
            else:
                hi = mid
        return lo


def minimax_cuts(groups: DataFrame, shards: int, first_bits: int = 12, more_bits: int = 4) -> tuple[int, list[int]]:
    """Smallest capacity, and the first key of every shard but the first. ``groups``: unique ``key`` (signed 64 bits) and ``size`` > 0."""

    def prefix(bits: int):
        return F.shiftright("key", 64 - bits) if bits < 64 else F.col("key")

    def sums(df: DataFrame, bits: int):
        got = df.groupBy(prefix(bits).alias("b")).agg(F.min("key"), F.sum("size"), F.count("*"), F.max("size"))
        return [(key, size, n, top, bits, b) for b, key, size, n, top in got.collect()]

    rows, bits = sums(groups, first_bits), first_bits
    while True:
        blocks = Blocks(rows)
        low, high = blocks.least(shards, True), blocks.least(shards, False)
        ends = blocks.walk(high, shards, False)
        if low == high or not blocks.total:
            break
        near, far = blocks.walk(low, shards, True), blocks.walk(high, shards, True)
        early = []  # the earliest a cut can lie: at the lower capacity, with blocks whole
        at = 0
        for _ in range(shards):
            to = min(at + low, blocks.total)
            if to < blocks.total:
                to = int(blocks.starts[np.searchsorted(blocks.ends, to, "right")])
            early.append(at := max(to, at))
        open_ = np.zeros(len(rows), dtype=bool)
        for i in range(max(len(near), len(far))):
            a, b = early[min(i, len(early) - 1)], far[min(i, len(far) - 1)]
            open_ |= (blocks.ends > a) & (blocks.starts <= b)
        open_ &= blocks.n > 1
        if not open_.any() or bits >= 64:
            break
        bits = min(64, bits + more_bits)
        ordered, inside = sorted(rows), F.lit(False)
        for b in sorted({r[4] for r in rows}):  # few levels, each a set of prefixes
            inside = inside | prefix(b).isin([r[5] for r, o in zip(ordered, open_) if o and r[4] == b] or [None])
        rows = [r for r, o in zip(ordered, open_) if not o] + sums(groups.where(inside), bits)
    first = {int(s): k for s, k in zip(blocks.starts, blocks.key)}
    return high, [first[e] for e in (ends or [])[:-1]]


def shard_by_bytes(docs: DataFrame, shards: int = 24, overhead: int = 8, slot_buckets: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row; equal texts share a shard, slots of a shard are 0, 1, 2, ...

    Slots are numbered in ``slot_buckets`` hash buckets of the id within each shard (offsets come from
    the bucket counts, at most shards x slot_buckets rows), so no task sorts a whole shard or a whole
    group of copies. Ids may repeat or be null: any row gets a slot of its own.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    raw = text.cast("binary")
    slim = written(docs.select(F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(raw) + overhead).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("key")), "shard-rows")
    groups = written(slim.groupBy("key").agg(F.sum("size").alias("size")), "shard-groups")
    _, cuts = minimax_cuts(groups, shards)
    shard = sum((F.when(F.col("key") >= c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    placed = slim.withColumn("shard", shard).withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.lit(slot_buckets)).cast("int"))
    placed = written(placed, "shard-placed")
    counts = sorted(tuple(r) for r in placed.groupBy("shard", "bucket").count().collect())  # shards x slot_buckets rows at most
    offset, at = {}, {}
    for s, b, n in counts:
        offset[s, b] = at.get(s, 0)
        at[s] = offset[s, b] + n
    spark = docs.sparkSession
    offsets = spark.createDataFrame([(s, b, o) for (s, b), o in offset.items()], "shard int, bucket int, first long")
    from pyspark.sql import Window

    slot = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "key")) - 1
    return placed.withColumn("at", slot).join(F.broadcast(offsets), ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("at")).cast("long").alias("slot"))


def op4_minimax_shards(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = shard_by_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
