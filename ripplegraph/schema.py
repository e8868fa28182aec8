"""Declared schemas and the filling-in of optional columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Column types by name; optional columns may be absent from a file.
TWEETS = {
    "tweet_id": "string",
    "user_id": "string",
    "text": "string",
    "timestamp": "timestamp",
    "likes": "bigint",
    "retweets": "bigint",
    "is_root": "boolean",
    "label": "int",
    "news_id": "string",
    "user_followers": "double",
    "user_following": "double",
    "user_verified": "boolean",
    "user_credibility": "double",
    "user_bot_score": "double",
    "user_type": "string",
    "followers": "double",
    "following": "double",
    "verified": "boolean",
    "credibility": "double",
}
EDGES = {"source": "string", "target": "string", "timestamp": "timestamp", "news_id": "string"}
USERS = {
    "user_id": "string",
    "user_type": "string",
    "followers": "bigint",
    "following": "bigint",
    "verified": "boolean",
    "credibility": "double",
}
PATTERNS = "is_fake boolean, num_nodes int, propagation_tree map<string, array<string>>"

# Fixed default values of the optional columns, per kind of graph.
CASCADE_DEFAULTS = {
    "user_followers": 1000.0,
    "user_credibility": 0.5,
    "user_bot_score": 0.1,
    "user_verified": False,
    "user_type": "regular",
}
USER_DEFAULTS = {"followers": 0.0, "following": 0.0, "verified": False, "credibility": 0.5}
FOLLOWING_SHARE = 0.1

# Columns of the cascade graph for which a 0 also means "unknown".
ZERO_IS_UNKNOWN = ("user_followers", "user_credibility", "user_bot_score")


def _or_default(df: DataFrame, name: str, default) -> Column:
    if name not in df.columns:
        return F.lit(default)
    return F.coalesce(F.col(name).cast(TWEETS[name]), F.lit(default))


def align_schema(df: DataFrame, graph: str = "cascade", fill_nulls: bool = True) -> DataFrame:
    """Add absent optional columns with their defaults and, unless told otherwise, fill their nulls.

    ``graph`` is ``cascade`` (one node per tweet), ``user`` (one node per user) or ``user_text``,
    where an absent following count is estimated as a tenth of the followers.
    """
    if graph == "user_text":
        estimate = F.col("user_followers") * F.lit(FOLLOWING_SHARE)
        return df if "user_following" in df.columns else df.withColumn("user_following", estimate)
    defaults = {"cascade": CASCADE_DEFAULTS, "user": USER_DEFAULTS}[graph]
    names = [n for n in defaults if fill_nulls or n not in df.columns]
    return df.withColumns({n: _or_default(df, n, defaults[n]) for n in names}) if names else df


def string_ids(df: DataFrame, *names: str) -> DataFrame:
    """Cast id columns to string, so that numeric ids still match the string ids of edges."""
    return df.withColumns({n: F.col(n).cast("string") for n in names if n in df.columns})
