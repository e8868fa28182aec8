"""Tweets, edges, patterns, predictions and vectors from the test tables.

All are projections, or one equi-join or grouping, over whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.plans.ordering import union_all

SCORED_FEATURES = ["likes", "retweets", "followers", "verified", "credibility", "bot_score", "hour", "constant"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Timestamps without a zone are read as UTC.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _news_id(ts: str = "ts") -> Column:
    return F.concat(F.lit("n"), F.date_format(ts, "yyyyMMddHH"))


def _tweet_id(ts: str = "ts", event_id: str = "event_id") -> Column:
    return F.concat(_news_id(ts), F.lit("_t"), F.col(event_id))


def _props_k() -> Column:
    return F.regexp_extract("props", "([0-9]+)", 1).cast("long")


def tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cascade per hour of events."""
    user, event = F.col("user_id"), F.col("event_id")
    repost = F.when(event % 4 != 0, F.concat(F.lit("RT @u"), user + 1, F.lit(": "))).otherwise(F.lit(""))
    body = F.concat(
        repost, F.col("event_type"), F.repeat(F.lit("!"), (event % 5).cast("int")), F.lit(" #t"), event % 13
    )
    kind = F.when(user % 20 == 0, "verified").when(user % 20 <= 2, "bot").otherwise("regular")
    return table(spark, sf_dir, "events").select(
        _tweet_id().alias("tweet_id"),
        F.concat(F.lit("u"), user).alias("user_id"),
        F.when(event % 29 != 0, body).alias("text"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.when(event % 53 != 0, F.floor("value")).alias("likes"),
        _props_k().alias("retweets"),
        (F.col("event_type") == "signup").alias("is_root"),
        (F.dayofmonth("ts") % 2).alias("label"),
        _news_id().alias("news_id"),
        user.cast("double").alias("user_followers"),
        (user % 20 == 0).alias("user_verified"),
        ((user % 10) / F.lit(10.0)).alias("user_credibility"),
        ((user % 7) / F.lit(7.0)).alias("user_bot_score"),
        kind.alias("user_type"),
    )


def user_tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tweets with the column names of the user graph; credibility is partly unknown."""
    user = F.substring("user_id", 2, 20).cast("long")
    return tweets(spark, sf_dir).select(
        "tweet_id", "user_id", "timestamp", "likes", "retweets", "is_root", "label", "news_id",
        F.col("user_followers").alias("followers"),
        (F.col("user_followers") * 2).alias("following"),
        F.col("user_verified").alias("verified"),
        F.when(user % 3 != 0, F.col("user_credibility")).alias("credibility"),
    )


def _parent() -> Column:
    """The event itself rounded down to the next coarser power of four: trees of depth three at most."""
    e = F.col("event_id")
    found = F.lit(None).cast("long")
    for step in (64, 16, 4):
        found = F.when(e % step != 0, e - e % step).otherwise(found)
    return found


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repost edges from each event's parent; some cross into another cascade."""
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    parents = events.select(F.col("event_id").alias("parent"), F.col("ts").alias("parent_ts"))
    return (
        events.withColumn("parent", _parent())
        .join(parents, "parent")
        .select(
            _tweet_id("parent_ts", "parent").alias("source"),
            _tweet_id().alias("target"),
            F.col("ts").cast("timestamp").alias("timestamp"),
            "event_id",
        )
    )


def edges_noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges with some reversed, repeated and cut-off ones added."""
    clean = edges(spark, sf_dir)
    part = F.col("event_id") % 97
    lost = F.concat(F.lit("lost_"), F.col("event_id"))

    def added(number: int, source: Column, target: Column) -> DataFrame:
        return clean.where(part == number).select(source.alias("source"), target.alias("target"))

    s, t = F.col("source"), F.col("target")
    return union_all(
        [clean.select(s, t), added(1, t, s), added(2, lost, t), added(3, s, t), added(4, s, lost), added(5, lost, lost)]
    )


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level sizes of every cascade, by the coarseness of its event ids."""
    e = F.col("event_id")
    level = F.when(e % 64 == 0, 0).when(e % 16 == 0, 1).when(e % 4 == 0, 2).otherwise(3)

    def size(n: int) -> Column:
        return F.nullif(F.count_if(F.col("level") == n), F.lit(0).cast("long")).alias(f"level_{n}")

    return (
        table(spark, sf_dir, "events")
        .select(_news_id().alias("pattern_id"), (F.dayofmonth("ts") % 2 == 1).alias("is_fake"), level.alias("level"))
        .groupBy("pattern_id", "is_fake")
        .agg(F.count(F.lit(1)).alias("num_nodes"), size(0), size(1), size(2))
    )


def predictions(spark: SparkSession, sf_dir: str, features: bool = False) -> DataFrame:
    """Scores of two models, ``structure`` and ``text``, for every event; the second has many equal scores."""
    scores = F.array(
        F.struct(F.lit("structure").alias("model"), F.least(F.col("value") / 500, F.lit(1.0)).alias("p")),
        F.struct(F.lit("text").alias("model"), (_props_k() / F.lit(99.0)).alias("p")),
    )
    user = F.col("user_id")
    extra = [
        F.floor("value").cast("double").alias("likes"),
        _props_k().cast("double").alias("retweets"),
        user.cast("double").alias("followers"),
        (user % 20 == 0).cast("double").alias("verified"),
        ((user % 10) / F.lit(10.0)).alias("credibility"),
        ((user % 7) / F.lit(7.0)).alias("bot_score"),
        F.hour("ts").cast("double").alias("hour"),
        F.lit(1.0).alias("constant"),
    ]
    kept = extra if features else []
    names = SCORED_FEATURES if features else []
    return (
        table(spark, sf_dir, "events")
        .select(
            F.concat(F.lit("e"), F.col("event_id")).alias("news_id"),
            (F.col("event_type") == "error").cast("int").alias("label"),
            *kept,
            F.explode(scores).alias("s"),
        )
        .select(
            "news_id",
            F.col("s.model").alias("model"),
            "label",
            (1 - F.col("s.p")).alias("p_real"),
            F.col("s.p").alias("p_fake"),
            (F.col("s.p") > 0.5).cast("int").alias("pred"),
            *names,
        )
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A validation score per run (day and event type) and step (hour): F1 of the text model's scores."""
    hit, said = F.col("event_type").isin("error", "view", "click"), _props_k() > 49
    counted = (
        table(spark, sf_dir, "events")
        .select(
            F.concat(F.lit("run"), F.dayofmonth("ts"), F.lit("_"), F.col("user_id") % 3).alias("run"),
            F.hour("ts").alias("step"),
            hit.alias("hit"),
            said.alias("said"),
        )
        .groupBy("run", "step")
        .agg(
            F.count_if(F.col("hit") & F.col("said")).alias("tp"),
            F.count_if("said").alias("said"),
            F.count_if("hit").alias("hit"),
        )
    )
    total = F.col("said") + F.col("hit")
    f1 = F.when(total > 0, 2.0 * F.col("tp") / total).otherwise(F.lit(0.0))
    return counted.select("run", "step", f1.alias("val_f1"))


def conversation_tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cascade per conversation, its roles as users."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id")).alias("news_id"),
        F.concat(F.lit("c"), F.col("conv_id"), F.lit("_t"), F.col("turn")).alias("tweet_id"),
        F.col("role").alias("user_id"),
        "text",
        (start + F.make_dt_interval(F.lit(0), F.col("turn").cast("int"))).alias("timestamp"),
        (F.col("conv_id") % 2).cast("int").alias("label"),
    )


def document_tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cascade per document source, languages as users; whole texts, with some marks added."""
    doc = F.col("doc_id")
    marks = F.concat(
        F.when(doc % 5 == 0, F.lit(" See http://x.co/a?b @you_1 #wow")).otherwise(F.lit("")),
        F.when(doc % 7 == 0, F.lit(" NO WAY!!! Really??...")).otherwise(F.lit("")),
    )
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return (
        table(spark, sf_dir, "documents")
        .join(labels, "doc_id", "left")
        .select(
            F.col("source").alias("news_id"),
            F.concat(F.lit("d"), doc).alias("tweet_id"),
            F.col("lang").alias("user_id"),
            F.when(doc % 31 != 0, F.concat("text", marks)).alias("text"),
            F.timestamp_seconds(F.lit(1704067200) + doc * 60).alias("timestamp"),
            F.when(doc % 11 != 0, doc % 100).alias("likes"),
            (doc % 7).alias("retweets"),
            (doc % 10 == 0).alias("is_root"),
            F.coalesce("toxic", F.lit(0)).alias("label"),
            (doc % 50).cast("double").alias("user_followers"),
            (doc % 9 == 0).alias("user_verified"),
            ((doc % 10) / F.lit(10.0)).alias("user_credibility"),
        )
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users of the events, grouped by the event type they appear in."""
    user = F.col("user_id")
    return (
        table(spark, sf_dir, "events")
        .select("user_id", F.col("event_type").alias("team"))
        .distinct()
        .select("team", F.concat(F.lit("u"), user).alias("user_id"), ((user % 10) / F.lit(10.0)).alias("credibility"),
                user.alias("user_no"))
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector per tweet: the embeddings are dealt out in turn."""
    embeddings = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    dealt = F.col("event_id") % embeddings.agg(F.count(F.lit(1))).scalar()
    events = table(spark, sf_dir, "events").select(
        _news_id().alias("news_id"), _tweet_id().alias("tweet_id"), dealt.alias("vec_id")
    )
    return events.join(embeddings, "vec_id").drop("vec_id")


def big_cascades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cascade per part, suppliers as users, ordered by ship date (with many equal dates)."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("p"), F.col("l_partkey")).alias("news_id"),
        F.concat_ws("_", F.lit("p"), "l_partkey", "l_orderkey", "l_linenumber", "l_suppkey").alias("tweet_id"),
        F.concat(F.lit("s"), F.col("l_suppkey")).alias("user_id"),
        F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        F.floor("l_quantity").alias("likes"),
        F.floor(F.col("l_extendedprice") / 1000).alias("retweets"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        F.lit(None).cast("string").alias("text"),
        F.col("l_linestatus").alias("user_type"),
    )
