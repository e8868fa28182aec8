"""Sharding by minimax contiguous partition: equal texts stay together, and the fullest shard is as small as it can be.

Groups of equal texts are ordered by the hash of their text. The smallest capacity with which greedy filling needs at most
the given number of shards is found by binary search, and the order is cut where that filling cuts.

The driver sees blocks of neighbouring groups, at most FIRST_BLOCKS. A block matters only if one of the cuts may
fall into it; such blocks are divided by 64 until they are single groups, so the result is that of the whole list.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplegraph.session import materialise

FIRST_BLOCKS, FAN = 65_536, 64


def greedy(ends: np.ndarray, capacity: int, shards: int) -> np.ndarray:
    """Running totals where filling shards up to ``capacity`` cuts; ``ends`` are the running totals after each entry."""
    cuts, at = [], 0
    for _ in range(shards):
        i = int(np.searchsorted(ends, at + capacity, "right")) - 1
        at = max(at, int(ends[i]) if i >= 0 else 0)
        cuts.append(at)
    return np.array(cuts)


def smallest_capacity(sizes: np.ndarray, shards: int) -> int:
    ends = np.cumsum(sizes)
    low, high = max(int(sizes.max()), -(-int(ends[-1]) // shards)), int(ends[-1])
    while low < high:
        middle = (low + high) // 2
        if greedy(ends, middle, shards)[-1] == ends[-1]:
            high = middle
        else:
            low = middle + 1
    return low


def _may_be_cut(sizes: np.ndarray, counts: np.ndarray, shards: int) -> np.ndarray:
    """The blocks of more than one group into which a cut of the best partition may fall."""
    several = counts > 1
    if not several.any():
        return several
    ends, best = np.cumsum(sizes), smallest_capacity(sizes, shards)
    single = int(sizes[~several].max()) if (~several).any() else 0
    least = max(-(-int(ends[-1]) // shards), best - int(sizes[several].max()), single, 1)
    lowest = greedy(ends, least, shards)
    highest, at = [], 0
    for _ in range(shards):
        i = min(int(np.searchsorted(ends, at + best, "left")), len(ends) - 1)
        at = int(ends[i])
        highest.append(at)
    marked = np.zeros(len(sizes) + 1, np.int64)
    starts = ends - sizes
    for lo, hi in zip(lowest, highest):
        marked[np.searchsorted(ends, lo, "right")] += 1
        marked[np.searchsorted(starts, hi, "left")] -= 1
    return several & (np.cumsum(marked[:-1]) > 0)


def placed(docs: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """Every document with its size, the checksum of its text, its shard and its slot there.

    ``docs`` has doc_id and text; other columns are ignored. The size is the number of UTF-8 bytes plus ``overhead``; a null
    text has no bytes and forms one group with other nulls, apart from empty texts. Documents of one text share a
    shard, however many they are. Slots count from 0 in each shard in the order of (text hash, doc_id);
    of equal rows each gets a slot of its own. There may be empty shards. An empty table gives no rows.
    """
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + overhead).alias("size"),
        F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))).alias("text_crc32"),
        F.coalesce(F.sha2("text", 256), F.lit("")).alias("key"),
    )
    # Sorted into ranges of (key, doc_id): a text of very many documents spreads over several ranges.
    ranged = rows.repartitionByRange("key", "doc_id").withColumn("chunk", F.spark_partition_id())
    stored = materialise(ranged, "ranged")
    before = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range.
    starts = stored.groupBy("chunk").agg(F.count(F.lit(1)).alias("n")).select("chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("chunk").orderBy("key", "doc_id")) - 1
    ordered = materialise(stored.withColumn("pos", inside).join(starts, "chunk").withColumn("pos", F.col("pos") + F.col("start")).drop("chunk", "start"), "ordered")
    groups = materialise(ordered.groupBy("key").agg(F.min("pos").alias("first"), F.sum("size").alias("bytes")).drop("key"), "groups")
    cuts = _cuts(groups, ordered.count(), shards)
    number, start = F.lit(0), F.lit(0).cast("long")
    for cut in cuts:
        past = F.col("pos") >= cut
        number, start = number + past.cast("int"), F.when(past, F.lit(cut)).otherwise(start)
    return ordered.select("doc_id", "size", "text_crc32", number.alias("shard"), (F.col("pos") - start).alias("slot"))


def _cuts(groups: DataFrame, rows: int, shards: int) -> list[int]:
    """Positions at which a new shard begins; fewer than ``shards``."""
    if not rows:
        return []
    level = 0
    while rows > FIRST_BLOCKS * FAN**level:
        level += 1

    def blocks(part: DataFrame, width: int) -> np.ndarray:
        at = F.floor(F.col("first") / width) if width > 1 else F.col("first")
        found = part.groupBy(at.cast("long").alias("at")).agg(F.min("first"), F.sum("bytes"), F.count(F.lit(1))).drop("at")
        return np.array(sorted(tuple(r) for r in found.collect()), np.int64).reshape(-1, 3)

    known = blocks(groups, FAN**level)
    while level:
        split = _may_be_cut(known[:, 1], known[:, 2], shards)
        if not split.any():
            break
        # The chosen blocks of this level; each cut can lie in a bounded number of them.
        chosen = groups.sparkSession.createDataFrame([(int(x) // FAN**level,) for x in known[split, 0]], "block long")
        part = groups.withColumn("block", F.floor(F.col("first") / FAN**level)).join(F.broadcast(chosen), "block", "left_semi").drop("block")
        level -= 1
        known = np.concatenate([known[~split], blocks(part, FAN**level)])
        known = known[np.argsort(known[:, 0])]
    ends = np.cumsum(known[:, 1])
    filled = greedy(ends, smallest_capacity(known[:, 1], shards), shards)
    after = np.searchsorted(ends, filled[:-1], "left") + 1
    return sorted({int(known[i, 0]) for i in after if i < len(known)})
