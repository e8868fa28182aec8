"""Ordered computations inside a group, also for groups too large for one task.

Groups of ordinary size use a plain window. Groups above the hot limit are range-partitioned on
(group, order), which cuts one group into many ordered chunks; the chunks are stored once, so their
bounds are fixed, and per-chunk totals carry the result from chunk to chunk.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplegraph.plans.skew import HotKeys, hot_keys, split_hot
from ripplegraph.session import materialise


def _one_group(df: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    return (df, by) if by else (df.withColumn("_all", F.lit(0)), ["_all"])


def running_sums(
    df: DataFrame,
    by: list[str],
    order: list[str],
    sums: dict[str, Column],
    hot: HotKeys | None = None,
) -> DataFrame:
    """Add, per entry of ``sums``, the total of its value over the rows before the current one.

    ``by`` may be empty (one global order). ``order`` should be unique within a group.
    """
    grouped, keys = _one_group(df, by)
    if hot is None:
        hot = hot_keys(grouped, keys)
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)

    def plain(rows: DataFrame) -> DataFrame:
        return rows.withColumns({n: F.coalesce(F.sum(v).over(before), F.lit(0)) for n, v in sums.items()})

    if hot.empty:
        return plain(grouped).drop("_all")
    cold, large = split_hot(grouped, hot)
    return plain(cold).unionByName(_chunked_sums(large.drop("hot_rows"), keys, order, sums, hot)).drop("_all")


def _chunked_sums(
    df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], hot: HotKeys
) -> DataFrame:
    chunks = max(2, ceil(2 * hot.total / hot.limit))
    stored = materialise(
        df.withColumns({f"_v_{n}": v for n, v in sums.items()})
        .repartitionByRange(chunks, *keys, *order)
        .withColumn("_chunk", F.spark_partition_id())
    )
    within = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    # One row per (group, chunk): at most (hot groups + chunks) rows.
    carried = (
        stored.groupBy(*keys, "_chunk")
        .agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
        .withColumns({f"_c_{n}": F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)) for n in sums})
        .drop(*[f"_t_{n}" for n in sums])
    )
    joined = stored.join(carried, [*keys, "_chunk"])
    totals = {n: F.col(f"_c_{n}") + F.coalesce(F.sum(f"_v_{n}").over(within), F.lit(0)) for n in sums}
    return joined.withColumns(totals).drop("_chunk", *[f"_{p}_{n}" for n in sums for p in "vc"])


def position(
    df: DataFrame,
    by: list[str],
    order: list[str],
    name: str = "pos",
    hot: HotKeys | None = None,
    size: str | None = None,
) -> DataFrame:
    """0-based rank of each row by ``order`` within ``by``, and on demand the group's ``size``.

    Both come from one partitioning and one sort; sizes of hot groups are known from finding them.
    """
    grouped, keys = _one_group(df, by)
    if hot is None:
        hot = hot_keys(grouped, keys)
    ordered = Window.partitionBy(*keys).orderBy(*order)
    added = {name: (F.row_number().over(ordered) - 1).cast("long")}
    if size:
        whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        added[size] = F.count(F.lit(1)).over(whole)
    if hot.empty:
        return grouped.withColumns(added).drop("_all")
    cold, large = split_hot(grouped, hot)
    large = large.withColumnRenamed("hot_rows", size) if size else large.drop("hot_rows")
    counted = _chunked_sums(large, keys, order, {name: F.lit(1).cast("long")}, hot)
    return cold.withColumns(added).unionByName(counted).drop("_all")


def lookback(
    df: DataFrame, by: str, order: list[str], rows: int, fields: list[str], name: str, hot: HotKeys
) -> DataFrame:
    """Add an array of the (at most ``rows``) preceding rows, as structs of ``fields``.

    ``df`` carries ``pos``, the 0-based rank by ``order`` within ``by``. Hot groups are cut into blocks of
    positions; the last ``rows`` rows of a block are copied into the next one, so no frame is cut off.
    """
    entry = F.struct(*fields)

    def frame(window) -> Column:
        return F.collect_list(entry).over(window.rowsBetween(-rows, -1))

    if hot.empty:
        return df.withColumn(name, frame(Window.partitionBy(by).orderBy(*order)))
    size = max(hot.limit, rows)
    block = F.floor(F.col("pos") / size)
    seen_from = F.when(F.col("pos") % size >= size - rows, F.array(block, block + 1)).otherwise(F.array(block))
    return (
        df.withColumn("_block", F.explode(seen_from))
        .withColumn(name, frame(Window.partitionBy(by, "_block").orderBy("pos")))
        .where(F.col("_block") == block)
        .drop("_block")
    )


def running_max(
    df: DataFrame, by: str, order: list[str], value: Column, name: str, hot: HotKeys
) -> DataFrame:
    """Add the largest ``value`` among the rows before the current one (null for the first)."""
    so_far = (Window.unboundedPreceding, -1)
    if hot.empty:
        return df.withColumn(name, F.max(value).over(Window.partitionBy(by).orderBy(*order).rowsBetween(*so_far)))
    blocked = df.withColumn("_block", F.floor(F.col("pos") / hot.limit)).withColumn("_v", value)
    # One row per block: at most rows/limit of them.
    carried = (
        blocked.groupBy(by, "_block")
        .agg(F.max("_v").alias("_top"))
        .withColumn("_carry", F.max("_top").over(Window.partitionBy(by).orderBy("_block").rowsBetween(*so_far)))
        .where(F.col("_block") > 0)
        .select(by, "_block", "_carry")
    )
    local = F.max("_v").over(Window.partitionBy(by, "_block").orderBy("pos").rowsBetween(*so_far))
    joined = blocked.join(carried, [by, "_block"], "left")
    return joined.withColumn(name, F.greatest("_carry", local)).drop("_block", "_v", "_carry")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
