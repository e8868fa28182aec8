"""Features of news, tweets and users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.functions.scalars import hours_between, literal_count, not_nan
from ripplegraph.operators.text import style_counts
from ripplegraph.schema import CASCADE_DEFAULTS, align_schema

NEWS_FEATURES = [
    "n_tweets",
    "n_users",
    "sum_likes",
    "sum_retweets",
    "mean_likes",
    "mean_retweets",
    "span_hours",
    "velocity",
]
TWEET_FEATURES = [
    "likes",
    "retweets",
    "is_root",
    "followers",
    "verified",
    "credibility",
    "bot_score",
    "emotional",
]
USER_FEATURES = [
    "n_tweets",
    "mean_likes",
    "mean_retweets",
    "any_root",
    "followers",
    "following",
    "verified",
    "credibility",
]
NEWS_TEXT_STATS = [
    "n_tweets",
    "n_users",
    "sum_likes",
    "sum_retweets",
    "mean_likes",
    "mean_retweets",
    "diversity",
    "variance",
]
EMOTIONAL_MARKS = 2


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def news_features(tweets: DataFrame, min_tweets: int = 2) -> DataFrame:
    """Totals, means, duration and speed per cascade; unknown likes and reposts count as 0."""
    count = F.count(F.lit(1))
    aggregated = (
        tweets.where(F.col("news_id").isNotNull())
        .groupBy("news_id")
        .agg(
            count.alias("n_tweets"),
            F.count_distinct("user_id").alias("n_users"),
            F.sum(_filled("likes")).alias("sum_likes"),
            F.sum(_filled("retweets")).alias("sum_retweets"),
            F.avg(_filled("likes")).alias("mean_likes"),
            F.avg(_filled("retweets")).alias("mean_retweets"),
            hours_between(F.max("timestamp"), F.min("timestamp")).alias("span_hours"),
        )
    )
    return aggregated.where(F.col("n_tweets") >= min_tweets).withColumn(
        "velocity", F.col("n_tweets") / (F.col("span_hours") + 1)
    )


def _known(name: str, default: float, missing: str) -> Column:
    """A 0 always becomes the default; a null becomes the default too, or NaN when asked for."""
    value = F.col(name).cast("double")
    unknown = F.lit(default) if missing == "default" else F.lit(float("nan"))
    return F.when(value.isNull(), unknown).when(value == 0, F.lit(default)).otherwise(value)


def _tweet_columns(rows: DataFrame, missing: str) -> dict[str, Column]:
    if missing not in ("default", "nan"):
        raise ValueError(f"missing must be 'default' or 'nan', not {missing!r}")
    root = F.coalesce("is_root", F.lit(False)) if "is_root" in rows.columns else F.lit(False)
    marks = literal_count(F.coalesce("text", F.lit("")), "!")
    columns = [
        _known("likes", 0.0, missing),
        _known("retweets", 0.0, missing),
        root.cast("double"),
        _known("user_followers", CASCADE_DEFAULTS["user_followers"], missing),
        F.coalesce("user_verified", F.lit(False)).cast("double"),
        _known("user_credibility", CASCADE_DEFAULTS["user_credibility"], missing),
        _known("user_bot_score", CASCADE_DEFAULTS["user_bot_score"], missing),
        (marks > EMOTIONAL_MARKS).cast("double"),
    ]
    return dict(zip(TWEET_FEATURES, columns))


def tweet_features(tweets: DataFrame, missing: str = "default") -> DataFrame:
    """Eight named features per tweet.

    ``missing="default"`` gives unknown values their defaults; ``missing="nan"`` leaves them NaN. An optional
    column that is absent altogether always gets its default, and a 0 counts as unknown in three of them.
    """
    rows = align_schema(tweets, "cascade", fill_nulls=False)
    return rows.select("news_id", "tweet_id", *[c.alias(n) for n, c in _tweet_columns(rows, missing).items()])


def slim_tweets(tweets: DataFrame, missing: str = "default") -> DataFrame:
    """What graph building needs of the tweets: ids, time, label, engagement and the features ``x0 .. x7``.

    Texts and profiles are reduced to features here, before any shuffle has to carry them.
    """
    rows = align_schema(tweets, "cascade", fill_nulls=False)
    numbered = [c.alias(f"x{i}") for i, c in enumerate(_tweet_columns(rows, missing).values())]
    kept = ["news_id", "tweet_id", "user_id", "timestamp", "label", "likes", "retweets", "user_type"]
    return rows.select(*kept, *numbered)


def node_matrix(ordered: DataFrame, news: DataFrame) -> DataFrame:
    """One feature row ``x0 .. x7`` per node: news totals for node 0, the features of ordered slim tweets for the others."""
    tops = news.select(
        "news_id",
        F.lit(0).cast("long").alias("node_idx"),
        F.lit(0).alias("node_type"),
        F.lit(None).cast("string").alias("tweet_id"),
        *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(NEWS_FEATURES)],
    )
    numbered = [f"x{i}" for i in range(len(TWEET_FEATURES))]
    return tops.unionByName(ordered.select("news_id", "node_idx", F.lit(1).alias("node_type"), "tweet_id", *numbered))


def _any_root(df: DataFrame) -> Column:
    if "is_root" not in df.columns:
        return F.max(F.lit(0.0))
    return F.coalesce(F.bool_or("is_root"), F.lit(False)).cast("double")


def user_features(tweets: DataFrame) -> DataFrame:
    """Features per (cascade, user); unknown values count as the defaults before averaging."""
    rows = align_schema(tweets, "user")
    return (
        rows.where(F.col("news_id").isNotNull())
        .groupBy("news_id", "user_id")
        .agg(
            F.count(F.lit(1)).alias("n_tweets"),
            F.avg(_filled("likes")).alias("mean_likes"),
            F.avg(_filled("retweets")).alias("mean_retweets"),
            _any_root(rows).alias("any_root"),
            F.avg("followers").alias("followers"),
            F.avg("following").alias("following"),
            F.bool_or("verified").cast("double").alias("verified"),
            F.avg("credibility").alias("credibility"),
        )
    )


def user_features_text(tweets: DataFrame) -> DataFrame:
    """As :func:`user_features`, but means pass over unknown values, with a writing-style score."""
    rows = align_schema(tweets, "user_text").withColumns(style_counts("text"))
    styles = list(style_counts("text"))
    return (
        rows.where(F.col("news_id").isNotNull())
        .groupBy("news_id", "user_id")
        .agg(
            F.count(F.lit(1)).alias("n_tweets"),
            F.avg(not_nan(F.col("likes").cast("double"))).alias("mean_likes"),
            F.avg(not_nan(F.col("retweets").cast("double"))).alias("mean_retweets"),
            _any_root(rows).alias("any_root"),
            F.avg(not_nan("user_followers")).alias("followers"),
            F.avg(not_nan("user_following")).alias("following"),
            F.coalesce(F.bool_or("user_verified"), F.lit(False)).cast("double").alias("verified"),
            F.avg(not_nan("user_credibility")).alias("credibility"),
            (sum((F.sum(s) for s in styles), F.lit(0)) / F.lit(float(len(styles)))).alias("style"),
        )
    )


def user_matrix(users: DataFrame, news: DataFrame, features: DataFrame, text: bool = False) -> DataFrame:
    """One feature row per node of the user graphs: the news node 0 and the indexed users.

    ``text`` takes the figures of the graphs with text; there users have one figure more, and the news rows get a 0.
    """
    tops, rows = (NEWS_TEXT_STATS, [*USER_FEATURES, "style"]) if text else (NEWS_FEATURES, USER_FEATURES)

    def numbered(names: list[str]) -> list[Column]:
        padded = [F.col(n).cast("double") for n in names] + [F.lit(0.0)] * (len(rows) - len(names))
        return [c.alias(f"x{i}") for i, c in enumerate(padded)]

    kept = news.join(users.where(F.col("user_idx") == 1).select("news_id"), "news_id", "left_semi")
    top_rows = kept.select("news_id", F.lit(0).cast("long").alias("node_idx"), F.lit(0).alias("node_type"), *numbered(tops))
    # A missing user id is one user of its cascade, with an index and features as any other.
    own = features.withColumnsRenamed({"news_id": "_news", "user_id": "_user"})
    same = (F.col("news_id") == F.col("_news")) & F.col("user_id").eqNullSafe(F.col("_user"))
    user_rows = users.join(own, same).select(
        "news_id", F.col("user_idx").alias("node_idx"), F.lit(1).alias("node_type"), *numbered(rows)
    )
    return top_rows.unionByName(user_rows)


def dataset_profile(tweets: DataFrame, edges: DataFrame, min_tweets: int = 2) -> DataFrame:
    """Articles, tweets, mean cascade size and edges, per label and in total (label null)."""
    label = F.min_by("label", F.struct("timestamp", "tweet_id"))
    kept = (
        tweets.where(F.col("news_id").isNotNull())
        .groupBy("news_id")
        .agg(label.alias("label"), F.count(F.lit(1)).alias("cascade_size"))
        .where(F.col("cascade_size") >= min_tweets)
    )
    return (
        kept.rollup("label")
        .agg(
            F.count(F.lit(1)).alias("articles"),
            F.sum("cascade_size").alias("tweets"),
            F.avg("cascade_size").alias("mean_size"),
        )
        .withColumn("share", F.col("articles") / kept.agg(F.count(F.lit(1)).cast("double")).scalar())
        .withColumn("edges", F.when(F.col("label").isNull(), edges.agg(F.count(F.lit(1))).scalar()))
    )
