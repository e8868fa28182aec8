"""Reading tweets, edges, users and propagation patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph import schema
from ripplegraph.sources.quoted import OPTIONS, quoted_csv


# A row that doesn't fit the header raises instead of being dropped.
CSV = OPTIONS | {"header": True}


def _scan(spark: SparkSession, path: str, types: dict[str, str], fmt: str, texts: bool = False) -> DataFrame:
    """A table of declared types. Only tables with ``texts`` may have line breaks in quoted fields; all are read in splits."""
    if fmt != "csv":
        found = spark.read.format(fmt).load(path)
        return found.withColumns({n: F.col(n).cast(types[n]) for n in found.columns if n in types})
    # The header decides which optional columns exist, the declared types how to read them.
    header = spark.read.options(**CSV).csv(path).columns
    declared = ", ".join(f"`{name}` {types.get(name, 'string')}" for name in header)
    return quoted_csv(spark, path, declared) if texts else spark.read.options(**CSV).schema(declared).csv(path)


def read_tweets(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """The tweets table; ids as strings, rows without a news id dropped."""
    tweets = schema.string_ids(_scan(spark, path, schema.TWEETS, fmt, texts=True), "tweet_id", "user_id", "news_id")
    return tweets.withColumn("timestamp", F.col("timestamp").cast("timestamp")).where(F.col("news_id").isNotNull())


def read_edges(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """The repost edges ``source, target, timestamp`` (and ``news_id`` where the file has it)."""
    return schema.string_ids(_scan(spark, path, schema.EDGES, fmt), "source", "target", "news_id")


def read_users(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return schema.string_ids(_scan(spark, path, schema.USERS, fmt), "user_id")


def read_patterns(spark: SparkSession, path: str | None, lines: bool = False) -> DataFrame:
    """Propagation patterns as level sizes, from a JSON array or (``lines``) one object per line.

    An absent file gives an empty table.

    Columns ``pattern_id, is_fake, num_nodes, level_0, level_1, level_2``; an absent level is null.
    Only the sizes of the levels are ever used, so the member lists are dropped at the scan.
    """
    raw = None
    if path is not None:
        # A path that does not exist is an accepted case, so ask the file system first.
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place):
            raw = spark.read.schema(schema.PATTERNS).option("multiLine", not lines).json(path)
    if raw is None:
        raw = spark.createDataFrame([], schema.PATTERNS)
    tree = F.col("propagation_tree")
    levels = [F.size(tree[str(n)]) for n in range(3)]
    return raw.select(
        F.xxhash64("is_fake", "num_nodes", F.to_json(tree)).cast("string").alias("pattern_id"),
        F.coalesce("is_fake", F.lit(True)).alias("is_fake"),
        F.col("num_nodes").cast("long").alias("num_nodes"),
        *[F.when(s >= 0, s).cast("long").alias(f"level_{n}") for n, s in enumerate(levels)],
    )
