"""Sharding by best-fit-decreasing bin packing (law ``bytes``).

Rows with equal texts form one indivisible group. Groups are taken by decreasing
size; each enters the bin with the least remaining capacity that still holds it,
found in a balanced search tree over the remaining capacities. A group that fits
nowhere enters the emptiest bin. The capacity is the smallest (by bisection) at
which no bin overflows, so that sizes come out nearly equal.

Only the histogram of group sizes leaves the executors: groups of one size are
interchangeable, so the packing of a size is a few runs "the next k groups of this size
go to bin b". Sizes are exact. k different sizes add up to k * (k + 1) / 2 bytes at
least, so that ``total`` bytes have fewer than sqrt(2 * total) of them (250,000 at 30 GB,
14 million at 100 TB if every size up to 14 MB occurred). Groups find their run by their
rank within the size, rows find their slot by their rank within the shard; both ranks
come from counts per hash bucket plus a rank inside the bucket, so that no task sees a
whole size or shard. A group with more than a thousandth of the rows is placed by broadcast.

Defined results: NULL text counts as empty (size 16, one group with empty texts);
repeated rows are rows of their own, in one group; an empty table gives an empty
result; columns other than id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import attach, load, saved, text_or_empty

N_SHARDS = 40
ROW_BYTES = 16
BUCKET_ROWS = 4096
RANK_BITS = 38  # a size has fewer than 2**38 groups, and there are fewer than 2**25 sizes


class CapacityTree:
    """A treap of (remaining capacity, bin) with best-fit search."""

    __slots__ = ("root",)

    def __init__(self):
        self.root = None  # node: [key, priority, left, right]

    @staticmethod
    def _priority(key):
        return hash((key[0] * 2654435761 + key[1] * 40503) & 0xFFFFFFFF) * 48271 % 2147483647

    def _split(self, node, key):
        """(nodes below key, nodes from key up)."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            node[3] = low
            return node, high
        low, high = self._split(node[2], key)
        node[2] = high
        return low, node

    def _join(self, low, high):
        if low is None or high is None:
            return low or high
        if low[1] > high[1]:
            low[3] = self._join(low[3], high)
            return low
        high[2] = self._join(low, high[2])
        return high

    def add(self, remaining: int, number: int) -> None:
        key = (remaining, number)
        low, high = self._split(self.root, key)
        self.root = self._join(self._join(low, [key, self._priority(key), None, None]), high)

    def take_tightest(self, size: int):
        """Remove and return the least (remaining, bin) with remaining >= size; None if there is none."""
        low, high = self._split(self.root, (size, -1))
        if high is None:
            self.root = low
            return None
        node, parent = high, None
        while node[2] is not None:
            parent, node = node, node[2]
        if parent is None:
            high = node[3]
        else:
            parent[2] = node[3]
        self.root = self._join(low, high)
        return node[0]

    def take_emptiest(self):
        node, parent = self.root, None
        while node[3] is not None:
            parent, node = node, node[3]
        if parent is None:
            self.root = node[2]
        else:
            parent[3] = node[2]
        return node[0]


def pack(sizes, counts, n_bins: int, capacity: int):
    """Best-fit decreasing over size classes (sizes descending).

    Returns (runs, overflow): runs are (class index, groups, bin) in order of placing.
    """
    tree, runs, overflow = CapacityTree(), [], 0
    for b in range(n_bins):
        tree.add(capacity, b)
    for c, (size, left) in enumerate(zip(sizes, counts, strict=True)):
        while left:
            found = tree.take_tightest(size)
            if found is None:
                remaining, b = tree.take_emptiest()
                n = 1
            else:
                remaining, b = found
                n = min(left, remaining // size)  # after one, the same bin is the tightest for the next
            tree.add(remaining - n * size, b)
            overflow = max(overflow, n * size - remaining)
            if runs and runs[-1][0] == c and runs[-1][2] == b:
                runs[-1] = (c, runs[-1][1] + n, b)
            else:
                runs.append((c, n, b))
            left -= n
    return runs, overflow


def plan(sizes, counts, n_bins: int):
    """Runs of :func:`pack` at the smallest capacity without overflow.

    A group beyond the even share gets a bin of its own at any capacity below its
    size; the share is then that of the other groups and bins.
    """
    total, bins, huge = sum(s * n for s, n in zip(sizes, counts, strict=True)), n_bins, 0
    alone = []  # (class index, groups) that take whole bins
    for c, (size, n) in enumerate(zip(sizes, counts, strict=True)):
        k = 0
        while k < n and bins > 1 and size * bins >= total:
            total, bins, k = total - size, bins - 1, k + 1
        if k:
            alone.append((c, k))
        if k < n:
            break
    runs = []
    rest = list(counts)
    for c, k in alone:
        rest[c] -= k
        for _ in range(k):
            runs.append((c, 1, n_bins - 1 - huge))
            huge += 1
    low = -(-total // bins) if total else 1
    high, step = low, 1
    while pack(sizes, rest, bins, high)[1] > 0:  # the even share nearly fits: look close to it first
        low, high, step = high + 1, high + step, step * 2
    while low < high:
        middle = (low + high) // 2
        if pack(sizes, rest, bins, middle)[1] > 0:
            low = middle + 1
        else:
            high = middle
    runs += pack(sizes, rest, bins, low)[0]
    return sorted(runs, key=lambda r: r[0])


def _ranked(df: DataFrame, part: str, order: list, n_rows: int, out: str) -> DataFrame:
    """Adds the rank from 0 of each row within ``part``, ordered by hash bucket, then by ``order``."""
    buckets = max(1, n_rows // BUCKET_ROWS)
    spread = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = spread.groupBy(part, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(part).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(part, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(part, "_bucket").orderBy(*order)) - 1
    ranked = spread.withColumn("_inside", inside).join(offsets, [part, "_bucket"])
    return ranked.withColumn(out, F.col("_before") + F.col("_inside")).drop("_bucket", "_inside", "_before")


def assign(docs: DataFrame, n_shards: int = N_SHARDS, row_bytes: int = ROW_BYTES) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot."""
    spark = docs.sparkSession
    text = text_or_empty()
    rows = docs.select(
        "doc_id", (F.octet_length(text) + row_bytes).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("group_key"),
    )
    rows = saved(rows, "shard-rows")  # ids, sizes and keys only
    groups = saved(rows.groupBy("group_key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n_rows")), "shard-groups")
    n_groups, n_rows = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_rows"), F.lit(0))).first()
    histogram = groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("bytes", ascending=False)
    sizes = histogram["bytes"].to_numpy(np.int64)
    runs = np.array(plan(sizes.tolist(), histogram["n"].tolist(), n_shards), np.int64).reshape(-1, 3)
    # the runs of a size follow one another; a run starts at its size's place and the rank of its first group
    before = np.cumsum(runs[:, 1]) - runs[:, 1]
    of_size = np.searchsorted(runs[:, 0], runs[:, 0])
    starts = (runs[:, 0] << RANK_BITS) + before - before[of_size]
    lookup = spark.sparkContext.broadcast((sizes[::-1].copy(), starts, runs[:, 2].astype(np.int32)))  # one entry a size and change of bin

    @F.pandas_udf("int")
    def bin_of(size: pd.Series, rank: pd.Series) -> pd.Series:
        ascending, starts, bins = lookup.value
        place = len(ascending) - 1 - np.searchsorted(ascending, size.to_numpy())
        return pd.Series(bins[np.searchsorted(starts, (place << RANK_BITS) + rank.to_numpy(), "right") - 1])

    ranked = _ranked(groups, "bytes", ["group_key"], n_groups, "rank")
    placed = saved(ranked.select("group_key", "n_rows", bin_of("bytes", "rank").alias("shard")), "shard-groups-placed")
    where = saved(attach(rows, placed, "group_key", "n_rows").select("doc_id", "size", "text_crc32", "shard"), "shard-bins")
    return _ranked(where, "shard", ["doc_id", "text_crc32", "size"], n_rows, "slot")


def query(spark, sf_dir: str) -> DataFrame:
    out = assign(load(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
