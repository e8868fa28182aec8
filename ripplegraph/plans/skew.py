"""Finding keys that own too many rows for one task, and joins that spread them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows of one key that a single task may own; above it the key is split over tasks.
HOT_ROWS = 2_000_000
# Hot keys that are fetched and broadcast; more of them stay a distributed table.
MAX_BROADCAST_KEYS = 50_000
# Ranges of key hashes that rows are counted by before any key is counted itself.
HASH_RANGES = 1 << 16
# Rows up to which a lookup table is broadcast, after they were counted.
MAX_BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class HotKeys:
    """Keys owning more than ``limit`` rows, with their row counts in ``hot_rows``."""

    keys: tuple[str, ...]
    limit: int
    table: DataFrame | None = None
    largest: int = 0
    total: int = 0

    @property
    def empty(self) -> bool:
        return self.table is None

    @property
    def salts(self) -> Column:
        """Parts that a key's rows are split into: its own rows decide, whatever other keys have."""
        return F.greatest(F.lit(2), F.ceil(F.col("hot_rows") / self.limit) * 2).cast("int")


def hot_keys(df: DataFrame, keys: list[str], limit: int | None = None) -> HotKeys:
    """The keys that own more than ``limit`` rows, with their exact numbers of rows.

    At most rows/limit keys can be hot. They are broadcast only when a bounded fetch shows that they are few;
    otherwise the counted table itself is joined.
    """
    return hot_key_sets(df, [keys], limit)[0]


def _hot_ranges(sided: DataFrame, limit: int) -> list:
    """The hash ranges of each side that hold more than ``limit`` rows; the fetch is bounded by ``HASH_RANGES`` a side."""
    counted = sided.groupBy("_side", "_range").agg(F.count(F.lit(1)).alias("_rows"))
    return counted.where(F.col("_rows") > limit).select("_side", "_range").collect()


def hot_key_sets(df: DataFrame, key_sets: list[list[str]], limit: int | None = None) -> list[HotKeys]:
    """Hot keys of several column sets of the same types, found together.

    A first pass counts rows per range of key hashes. It is combined before the shuffle to at most ``HASH_RANGES`` rows a task
    and side, however many keys there are. A range holds at least the rows of each of its keys, so only keys in ranges
    above ``limit`` can be hot: a second pass counts these keys exactly. Without such a range there is no second pass. Beyond about
    ``HASH_RANGES * limit`` rows most ranges are above the limit and the second pass counts nearly all keys.
    """
    limit = HOT_ROWS if limit is None else limit
    names = [f"_k{i}" for i in range(len(key_sets[0]))]
    sides = [
        F.struct(
            F.lit(number).alias("_side"),
            F.pmod(F.xxhash64(*keys), F.lit(HASH_RANGES)).cast("int").alias("_range"),
            *[F.col(k).alias(n) for k, n in zip(keys, names)],
        )
        for number, keys in enumerate(key_sets)
    ]
    sided = df.select(F.inline(F.array(*sides)))
    ranges = _hot_ranges(sided, limit)
    if not ranges:
        return [HotKeys(tuple(keys), limit) for keys in key_sets]
    suspect = F.broadcast(df.sparkSession.createDataFrame(ranges, "_side int, _range int"))
    counted = (
        sided.join(suspect, ["_side", "_range"], "left_semi")
        .groupBy("_side", *names)
        .agg(F.count(F.lit(1)).alias("hot_rows"))
        .where(F.col("hot_rows") > limit)
    )
    found = counted.limit(MAX_BROADCAST_KEYS + 1).collect()
    few = len(found) <= MAX_BROADCAST_KEYS
    if not few:
        found = counted.groupBy("_side").agg(F.max("hot_rows").alias("largest"), F.sum("hot_rows").alias("total")).collect()
    return [_of_side(df, counted, found, few, number, keys, names, limit) for number, keys in enumerate(key_sets)]


def _of_side(df, counted, found, few, number, keys, names, limit) -> HotKeys:
    rows = [row for row in found if row["_side"] == number]
    if not rows:
        return HotKeys(tuple(keys), limit)
    renamed = [F.col(n).alias(k) for n, k in zip(names, keys)]
    if not few:
        table = counted.where(F.col("_side") == number).select(*renamed, "hot_rows")
        return HotKeys(tuple(keys), limit, table, rows[0]["largest"], rows[0]["total"])
    sizes = [row["hot_rows"] for row in rows]
    table = df.sparkSession.createDataFrame(rows, counted.schema).select(*renamed, "hot_rows")
    return HotKeys(tuple(keys), limit, F.broadcast(table), max(sizes), sum(sizes))


def split_hot(df: DataFrame, hot: HotKeys) -> tuple[DataFrame, DataFrame]:
    """Rows of ordinary keys, and rows of hot keys (with ``hot_rows``)."""
    keys = list(hot.keys)
    return df.join(hot.table, keys, "left_anti"), df.join(hot.table, keys, "inner")


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    hot: HotKeys,
    spread: list[str | Column],
    how: str = "inner",
) -> DataFrame:
    """Equi-join whose hot left keys are spread over several tasks.

    ``hot.keys`` must be among ``on``. Left rows of a hot key get a salt hashed from ``spread``;
    the matching right rows are copied once per salt. Other keys join as usual.
    """
    if hot.empty:
        return left.join(right, on, how)
    keys = list(hot.keys)
    marks = hot.table.select(*keys, hot.salts.alias("_salts"))
    salt = F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_salts")).cast("int"), F.lit(0))
    copies = F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)
    salted = left.join(marks, keys, "left").withColumn("_salt", salt).drop("_salts")
    copied = right.join(marks, keys, "left").withColumn("_salt", F.explode(copies)).drop("_salts")
    return salted.join(copied, [*on, "_salt"], how).drop("_salt")


def is_unique(df: DataFrame, keys: list[str]) -> bool:
    """Whether no key occurs twice."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty()


def is_small(df: DataFrame) -> bool:
    """Whether a table may be broadcast, by a bounded count."""
    return df.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS


def lookup_join(
    left: DataFrame, lookup: DataFrame, on: list[str], spread: list[str | Column], small: bool
) -> DataFrame:
    """Inner join with a lookup table: broadcast if it was found to be small, salted otherwise."""
    if small:
        return left.join(F.broadcast(lookup), on)
    return salted_join(left, lookup, on, hot_keys(left, on), spread)
