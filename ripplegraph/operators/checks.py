"""Checks of the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.plans.ordering import union_all
from ripplegraph.plans.skew import hot_key_sets, salted_join


def dangling_edges(tweets: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges without both ends in one cascade, with the reason."""
    hot_source, hot_target = hot_key_sets(edges, [["source"], ["target"]])

    def ends(name: str) -> DataFrame:
        return tweets.select(F.col("tweet_id").alias(name), F.col("news_id").alias(f"{name}_news"))

    known = salted_join(edges.select("source", "target"), ends("source"), ["source"], hot_source, ["target"], "left")
    known = salted_join(known, ends("target"), ["target"], hot_target, ["source"], "left")
    lost_source, lost_target = F.col("source_news").isNull(), F.col("target_news").isNull()
    reason = (
        F.when(lost_source & lost_target, "both ends unknown")
        .when(lost_source, "source unknown")
        .when(lost_target, "target unknown")
        .when(F.col("source_news") != F.col("target_news"), "two cascades")
    )
    return known.withColumn("reason", reason).where("reason is not null").select("source", "target", "reason")


def duplicate_tweets(tweets: DataFrame) -> DataFrame:
    """Tweet ids that occur more than once."""
    return (
        tweets.groupBy("tweet_id").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") > 1)
    )


def time_violations(tweets: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose target is earlier than their source, with the seconds between."""
    hot_source, hot_target = hot_key_sets(edges, [["source"], ["target"]])

    def times(name: str) -> DataFrame:
        return tweets.select(F.col("tweet_id").alias(name), F.unix_micros("timestamp").alias(f"{name}_us"))

    timed = salted_join(edges.select("source", "target"), times("source"), ["source"], hot_source, ["target"])
    timed = salted_join(timed, times("target"), ["target"], hot_target, ["source"])
    late = (F.col("source_us") - F.col("target_us")) / F.lit(1e6)
    return timed.where("target_us < source_us").select("source", "target", late.alias("seconds_early"))


def label_conflicts(tweets: DataFrame) -> DataFrame:
    """Cascades whose tweets carry more than one label."""
    return (
        tweets.groupBy("news_id")
        .agg(F.count_distinct("label").alias("labels"), F.count(F.lit(1)).alias("n_tweets"))
        .where(F.col("labels") > 1)
    )


def input_report(tweets: DataFrame, edges: DataFrame) -> DataFrame:
    """Number of findings per check."""
    found = {
        "dangling_edges": dangling_edges(tweets, edges),
        "duplicate_tweets": duplicate_tweets(tweets),
        "time_violations": time_violations(tweets, edges),
        "label_conflicts": label_conflicts(tweets),
    }
    return union_all(
        [df.agg(F.count(F.lit(1)).alias("findings")).select(F.lit(n).alias("check"), "findings") for n, df in found.items()]
    )
