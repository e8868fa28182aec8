"""From the tweets table to cascades: order, index, label, node and graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplegraph.functions.scalars import coin
from ripplegraph.plans.ordering import position
from ripplegraph.plans.skew import HotKeys, hot_keys

ORDER = ["timestamp", "tweet_id"]
MIN_TWEETS = 2
MIN_USERS = 3
NEWS_NODE = 0


def hot_cascades(tweets: DataFrame, limit: int | None = None) -> HotKeys:
    """Cascades with more tweets than one task should order."""
    return hot_keys(tweets, ["news_id"], limit)


def cascade_sizes(tweets: DataFrame) -> DataFrame:
    """One row per cascade with its number of tweets."""
    return (
        tweets.where(F.col("news_id").isNotNull())
        .groupBy("news_id")
        .agg(F.count(F.lit(1)).alias("cascade_size"))
    )


def min_size_filter(tweets: DataFrame, min_tweets: int = MIN_TWEETS) -> DataFrame:
    """Sizes of the cascades that are large enough."""
    return cascade_sizes(tweets).where(F.col("cascade_size") >= min_tweets)


def min_users_filter(tweets: DataFrame, min_users: int = MIN_USERS) -> DataFrame:
    """Cascades with enough distinct users. A null user counts as one."""
    users = tweets.where(F.col("news_id").isNotNull()).select("news_id", "user_id").distinct()
    return (
        users.groupBy("news_id")
        .agg(F.count(F.lit(1)).alias("n_users"))
        .where(F.col("n_users") >= min_users)
    )


def propagation_order(
    tweets: DataFrame, min_tweets: int = MIN_TWEETS, hot: HotKeys | None = None
) -> DataFrame:
    """Tweets of the kept cascades with ``pos`` (0-based, by time), ``node_idx`` = pos + 1 and ``cascade_size``."""
    tweets = tweets.where(F.col("news_id").isNotNull())
    hot = hot_cascades(tweets) if hot is None else hot
    ordered = position(tweets, ["news_id"], ORDER, "pos", hot, size="cascade_size")
    return ordered.where(F.col("cascade_size") >= min_tweets).withColumn("node_idx", F.col("pos") + 1)


def user_index(tweets: DataFrame, min_users: int = MIN_USERS, hot: HotKeys | None = None) -> DataFrame:
    """Distinct users per cascade in first-seen order, ``user_idx`` from 1; cascades with few users are dropped."""
    tweets = tweets.where(F.col("news_id").isNotNull())
    seen = tweets.groupBy("news_id", "user_id").agg(F.min(F.struct(*ORDER)).alias("first_seen"))
    ranked = position(seen, ["news_id"], ["first_seen", "user_id"], "user_idx", hot, size="n_users")
    return ranked.where(F.col("n_users") >= min_users).select(
        "news_id", "user_id", (F.col("user_idx") + 1).alias("user_idx")
    )


def cascade_label(tweets: DataFrame) -> DataFrame:
    """Label of each cascade's first tweet, and whether it is fake."""
    first = F.min_by("label", F.struct(*ORDER))
    return (
        tweets.where(F.col("news_id").isNotNull())
        .groupBy("news_id")
        .agg(first.alias("label"))
        .withColumn("is_fake", F.col("label") == 1)
    )


def graph_table(tweets: DataFrame, min_tweets: int = MIN_TWEETS) -> DataFrame:
    """One row per graph: label, cascade_size, num_nodes, is_fake."""
    label = F.min_by("label", F.struct(*ORDER))
    return (
        tweets.where(F.col("news_id").isNotNull())
        .groupBy("news_id")
        .agg(label.alias("label"), F.count(F.lit(1)).alias("cascade_size"))
        .where(F.col("cascade_size") >= min_tweets)
        .withColumns({"num_nodes": F.col("cascade_size") + 1, "is_fake": F.col("label") == 1})
    )


def graphs_of(ordered: DataFrame) -> DataFrame:
    """The graph table from tweets that are in order already: each cascade's first row has all of it."""
    size = F.col("cascade_size")
    return ordered.where(F.col("pos") == 0).select(
        "news_id", "label", "cascade_size", (size + 1).alias("num_nodes"), (F.col("label") == 1).alias("is_fake")
    )


def node_table(ordered: DataFrame, graphs: DataFrame) -> DataFrame:
    """Nodes of every graph: the news node 0 (type 0) and the tweets 1..n (type 1)."""
    news = graphs.select(
        "news_id",
        F.lit(NEWS_NODE).cast("long").alias("node_idx"),
        F.lit(0).alias("node_type"),
        F.lit(None).cast("string").alias("tweet_id"),
    )
    return news.unionByName(ordered.select("news_id", "node_idx", F.lit(1).alias("node_type"), "tweet_id"))


def user_node_table(users: DataFrame) -> DataFrame:
    """Nodes of every user graph: the news node 0 and the users 1..u."""
    news = users.groupBy("news_id").agg(
        F.lit(NEWS_NODE).cast("long").alias("node_idx"),
        F.lit(0).alias("node_type"),
        F.lit(None).cast("string").alias("user_id"),
    )
    return news.unionByName(
        users.select("news_id", F.col("user_idx").alias("node_idx"), F.lit(1).alias("node_type"), "user_id")
    )


def credibility_sample(
    users: DataFrame, group: str, k: int, below: float | None = 0.4, seed: str = "42"
) -> DataFrame:
    """A random sample of ``k`` users per group, of those under a credibility if one is given.

    The sample is the k smallest hashes; Spark cuts to k per group before the shuffle.
    """
    pool = users if below is None else users.where(F.col("credibility") < below)
    drawn = pool.withColumn("_draw", coin(group, "user_id", seed=seed))
    rank = F.row_number().over(Window.partitionBy(group).orderBy("_draw", "user_id"))
    return drawn.withColumn("pick", rank).where(F.col("pick") <= k).drop("_draw")


def user_tier(users: DataFrame, order: list[str], verified: float = 0.05, bots: float = 0.15) -> DataFrame:
    """User type by place in the order: the first 5 % verified, the next 10 % bots, the rest regular.

    Also numbers the users within their type (``tier_no`` from 0).
    """
    placed = position(users, [], order, "place").withColumn("_total", users.agg(F.count(F.lit(1))).scalar())
    first_bot, first_regular = F.col("_total") * F.lit(verified), F.col("_total") * F.lit(bots)
    # A tier is a run of consecutive places, so the number within it follows from where it starts.
    tier = (
        F.when(F.col("place") < first_bot, "verified").when(F.col("place") < first_regular, "bot").otherwise("regular")
    )
    start = F.when(F.col("place") < first_bot, F.lit(0)).when(F.col("place") < first_regular, F.ceil(first_bot))
    number = F.col("place") - start.otherwise(F.ceil(first_regular))
    return placed.withColumns({"user_type": tier, "tier_no": number}).drop("_total")


def head_examples(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """The first ``k`` rows in an order."""
    return df.orderBy(*order).limit(k)
