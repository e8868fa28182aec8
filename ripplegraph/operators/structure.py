"""Structural features: time since the news, degree, depth, replies, influence, branching.

``links`` are tweet-to-tweet edges ``news_id, source, target`` within their cascade. They are read several times:
store them first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplegraph.functions.scalars import hours_between
from ripplegraph.plans.ordering import union_all
from ripplegraph.plans.skew import HotKeys, hot_key_sets, hot_keys, is_unique, salted_join
from ripplegraph.session import materialise

REPOST_MARK = "RT @"


def tweet_links(tweets: DataFrame, edges: DataFrame) -> DataFrame:
    """Recorded edges ``news_id, source, target`` whose ends are both tweets of one cascade."""
    ids = tweets.select("news_id", "tweet_id")
    sources = ids.select("news_id", F.col("tweet_id").alias("source"))
    targets = ids.select("news_id", F.col("tweet_id").alias("target"))
    ends = edges.select("source", "target")
    hot_sources, hot_targets = hot_key_sets(ends, [["source"], ["target"]])
    found = salted_join(ends, sources, ["source"], hot_sources, ["target"])
    return salted_join(found, targets, ["news_id", "target"], hot_targets, ["source"]).select(
        "news_id", "source", "target"
    )


def time_since_news(tweets: DataFrame, hot: HotKeys) -> DataFrame:
    """Hours from the cascade's first tweet to each tweet."""
    since = hours_between(F.col("timestamp"), F.col("_start"))
    if hot.empty:
        first = F.min("timestamp").over(Window.partitionBy("news_id"))
        started = tweets.withColumn("_start", first)
    else:
        starts = tweets.groupBy("news_id").agg(F.min("timestamp").alias("_start"))
        started = salted_join(tweets, starts, ["news_id"], hot, ["tweet_id"])
    return started.select("news_id", "tweet_id", since.alias("time_since_news"))


def node_degree(tweets: DataFrame, links: DataFrame) -> DataFrame:
    """In-, out- and total degree of every tweet; both ends of an edge are counted in one grouping."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def counted(df: DataFrame, name: str, into: bool, out_of: bool) -> DataFrame:
        return df.select(
            "news_id",
            F.col(name).alias("tweet_id"),
            (one if into else zero).alias("i"),
            (one if out_of else zero).alias("o"),
        )

    rows = union_all(
        [
            counted(tweets, "tweet_id", False, False),
            counted(links, "source", False, True),
            counted(links, "target", True, False),
        ]
    )
    return rows.groupBy("news_id", "tweet_id").agg(
        F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.sum(F.col("i") + F.col("o")).alias("degree")
    )


def _anchors(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """For every tweet the nearest ancestor, itself included, that doesn't have just one source, and the hops from there.

    Columns ``news_id, tweet_id, anchor, hops, kind``: the kind of the anchor is ``root`` (nobody's target) or ``many``
    (several sources). A tweet below a circle of single sources has none. Pointers to the single source double until they meet
    an anchor: round k settles the tweets up to 2**k hops below theirs, so the rounds grow with the logarithm of the depth.
    A tree has tweets at all its depths, so a round that settles nothing leaves circles only.
    """
    key = ["news_id", "tweet_id"]
    ups = links.groupBy("news_id", F.col("target").alias("tweet_id")).agg(F.min("source").alias("up"), F.max("source").alias("other"))
    kind = F.when(F.col("up").isNull(), "root").when(F.col("up") != F.col("other"), "many")
    marked = materialise(nodes.distinct().join(ups, key, "left").select(*key, "up", kind.alias("kind")), "pointers")
    settled = marked.where(F.col("kind").isNotNull()).select(*key, F.col("tweet_id").alias("anchor"), F.lit(0).alias("hops"), "kind")
    done, left = [settled], None
    # where each tweet points, how far that is, and the kind if that is an anchor
    pointed = marked.select(*key, F.coalesce(F.when(F.col("kind").isNull(), F.col("up")), "tweet_id").alias("anchor"),
                            F.when(F.col("kind").isNull(), 1).otherwise(0).alias("hops"), "kind")
    open_ = pointed.where(F.col("kind").isNull())
    while True:
        ahead = pointed.select("news_id", F.col("tweet_id").alias("anchor"), F.col("anchor").alias("_to"), F.col("hops").alias("_more"), F.col("kind").alias("_kind"))
        moved = open_.drop("kind").join(ahead, ["news_id", "anchor"])
        moved = materialise(moved.select(*key, F.col("_to").alias("anchor"), (F.col("hops") + F.col("_more")).alias("hops"), F.col("_kind").alias("kind")), "pointers")
        done.append(moved.where(F.col("kind").isNotNull()))
        open_ = moved.where(F.col("kind").isNull())
        before, left = left, open_.count()
        if left == 0 or left == before:
            return union_all(done)
        # settled tweets are looked up too: those who point at them go on to their anchors
        pointed = union_all([*done, open_])


def _many_source_depths(links: DataFrame, anchors: DataFrame) -> DataFrame:
    """Depth of the tweets with several sources that a root leads to: ``news_id, anchor, depth``.

    Chains of single sources are contracted to one link each, as long as the chain; the least sum of lengths is passed on from the
    tweets whose depth fell in the round before.
    """
    ends = anchors.where("kind = 'many' and hops = 0").select("news_id", F.col("tweet_id").alias("target"))
    above = anchors.select("news_id", F.col("tweet_id").alias("source"), F.col("anchor").alias("origin"), "hops", "kind")
    into = links.join(ends, ["news_id", "target"]).join(above, ["news_id", "source"])
    length = F.min(F.col("hops") + 1).alias("length")
    contracted = materialise(into.groupBy("news_id", "origin", "kind", F.col("target").alias("anchor")).agg(length), "contracted")
    key = ["news_id", "anchor"]
    depths = materialise(contracted.where("kind = 'root'").groupBy(*key).agg(F.min("length").alias("depth")), "depths")
    onward = contracted.where("kind = 'many'").select("news_id", "origin", "anchor", "length")
    fresh = depths
    while not fresh.isEmpty():
        told = fresh.select("news_id", F.col("anchor").alias("origin"), "depth")
        offered = onward.join(told, ["news_id", "origin"]).groupBy(*key).agg(F.min(F.col("depth") + F.col("length")).alias("offer"))
        met = materialise(offered.join(depths, key, "left").where(F.col("depth").isNull() | (F.col("offer") < F.col("depth"))), "offers")
        fresh = met.select(*key, F.col("offer").alias("depth"))
        if not fresh.isEmpty():
            depths = materialise(depths.join(fresh.select(*key), key, "left_anti").unionByName(fresh), "depths")
    return depths


def node_depth(tweets: DataFrame, links: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Hops from the nearest root (a tweet that is nobody's target); null where no root leads, or beyond ``max_depth``.

    Pointers to single sources double, so a chain takes rounds by its logarithm, each stored: a lost executor costs at
    most the current one. Only tweets with several sources are then searched from the roots, over contracted chains.
    """
    key = ["news_id", "tweet_id"]
    nodes = tweets.select(*key)
    anchors = _anchors(nodes, links)
    found = anchors.where("kind = 'root'").select(*key, F.col("hops").alias("depth"))
    if not anchors.where("kind = 'many'").isEmpty():
        anchors = materialise(anchors, "anchors")
        below = anchors.where("kind = 'many'").join(_many_source_depths(links, anchors), ["news_id", "anchor"])
        found = found.unionByName(below.select(*key, (F.col("depth") + F.col("hops")).alias("depth")))
    depth = F.col("depth").cast("int")
    if max_depth is not None:
        depth = F.when(depth <= max_depth, depth)
    return nodes.join(found, key, "left").withColumn("depth", depth)


def cascade_depth(depths: DataFrame) -> DataFrame:
    """Largest depth per cascade."""
    return depths.groupBy("news_id").agg(F.max("depth").alias("max_depth"))


def reply_retweet_count(tweets: DataFrame, links: DataFrame) -> DataFrame:
    """Children of every tweet, split by their text into reposts (``RT @``) and replies."""
    kinds = tweets.select(
        "news_id",
        F.col("tweet_id").alias("target"),
        F.coalesce(F.startswith("text", F.lit(REPOST_MARK)), F.lit(False)).alias("is_repost"),
    )
    marked = salted_join(links, kinds, ["news_id", "target"], hot_keys(links, ["news_id", "target"]), ["source"])
    children = marked.groupBy("news_id", F.col("source").alias("tweet_id")).agg(
        F.count(F.lit(1)).alias("children"), F.count_if("is_repost").alias("retweet_count")
    )
    zero = F.lit(0).cast("long")
    filled = tweets.select("news_id", "tweet_id").join(children, ["news_id", "tweet_id"], "left")
    return filled.select(
        "news_id",
        "tweet_id",
        F.coalesce("children", zero).alias("children"),
        F.coalesce("retweet_count", zero).alias("retweet_count"),
        F.coalesce(F.col("children") - F.col("retweet_count"), zero).alias("reply_count"),
    )


def local_influence(tweets: DataFrame, links: DataFrame) -> DataFrame:
    """Reach within two hops: a tweet's children plus the children of each child.

    This is the number of distinct descendants within two hops, without the tweet itself. Where every tweet has one
    parent and no two are each other's parent, it is a sum of per-node counts, so descendants aren't listed.
    """
    distinct = links.select("news_id", "source", "target").where("source <> target").distinct()
    back = distinct.select("news_id", F.col("target").alias("source"), F.col("source").alias("target"))
    if not is_unique(distinct, ["news_id", "target"]) or not distinct.join(back, ["news_id", "source", "target"]).isEmpty():
        return _listed_influence(tweets, distinct)
    children = distinct.groupBy("news_id", F.col("source").alias("tweet_id")).agg(F.count(F.lit(1)).alias("children"))
    below = children.select("news_id", F.col("tweet_id").alias("target"), F.col("children").alias("below"))
    hot = hot_keys(distinct, ["news_id", "target"])
    onward = salted_join(distinct, below, ["news_id", "target"], hot, ["source"])
    second = onward.groupBy("news_id", F.col("source").alias("tweet_id")).agg(F.sum("below").alias("grandchildren"))
    zero = F.lit(0).cast("long")
    rows = union_all(
        [
            tweets.select("news_id", "tweet_id", zero.alias("n")),
            children.select("news_id", "tweet_id", F.col("children").alias("n")),
            second.select("news_id", "tweet_id", F.col("grandchildren").alias("n")),
        ]
    )
    return rows.groupBy("news_id", "tweet_id").agg(F.sum("n").alias("local_influence"))


def _listed_influence(tweets: DataFrame, distinct: DataFrame) -> DataFrame:
    onward = distinct.select("news_id", F.col("source").alias("target"), F.col("target").alias("below"))
    hot = hot_keys(distinct, ["news_id", "target"])
    second = salted_join(distinct, onward, ["news_id", "target"], hot, ["source"]).select("news_id", "source", F.col("below").alias("target"))
    reached = distinct.unionByName(second).where("source <> target").distinct()
    counted = reached.groupBy("news_id", F.col("source").alias("tweet_id")).agg(F.count(F.lit(1)).alias("local_influence"))
    found = tweets.select("news_id", "tweet_id").distinct().join(counted, ["news_id", "tweet_id"], "left")
    return found.select("news_id", "tweet_id", F.coalesce("local_influence", F.lit(0).cast("long")).alias("local_influence"))


def branching_by_level(depths: DataFrame) -> DataFrame:
    """Tweets per (cascade, depth), for the tweets that a root leads to."""
    return (
        depths.where(F.col("depth").isNotNull())
        .groupBy("news_id", "depth")
        .agg(F.count(F.lit(1)).alias("nodes"))
    )


def patterns_from(branching: DataFrame, graphs: DataFrame) -> DataFrame:
    """Propagation patterns learnt from cascades: their class, size and level sizes (absent level = null)."""
    levels = branching.groupBy("news_id").agg(
        F.sum("nodes").alias("num_nodes"),
        *[F.max(F.when(F.col("depth") == n, F.col("nodes"))).alias(f"level_{n}") for n in range(3)],
    )
    return levels.join(graphs.select("news_id", "is_fake"), "news_id").select(
        F.col("news_id").alias("pattern_id"), "is_fake", "num_nodes", "level_0", "level_1", "level_2"
    )


def declared_features(tweets: DataFrame, links: DataFrame, hot: HotKeys) -> DataFrame:
    """The eight structural features per tweet by their declared names."""
    keys = ["news_id", "tweet_id"]
    base = tweets.select(
        *keys,
        F.col("user_followers").alias("followers"),
        F.col("user_verified").cast("double").alias("verified"),
    )
    parts = [
        time_since_news(tweets, hot),
        node_degree(tweets, links).select(*keys, "degree"),
        node_depth(tweets, links),
        reply_retweet_count(tweets, links).select(*keys, "retweet_count", "reply_count"),
        local_influence(tweets, links),
    ]
    for part in parts:
        base = base.join(part, keys)
    return base
