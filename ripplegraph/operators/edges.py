"""Edge rules of cascade graphs and user graphs.

Every rule gives ``news_id, src_idx, dst_idx, kind``. Tweets have node index pos + 1, the news node 0.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.functions.scalars import coin, hours_between, not_nan
from ripplegraph.operators.cascades import ORDER
from ripplegraph.plans.ordering import lookback, position, running_max, running_sums, union_all
from ripplegraph.plans.skew import (
    MAX_BROADCAST_ROWS,
    HotKeys,
    hot_key_sets,
    hot_keys,
    is_small,
    lookup_join,
    salted_join,
)
from ripplegraph.session import materialise

# Fixed values of the edge rules.
LOOKBACK = 5
DECAY_HOURS = 24.0
SAME_TYPE_FACTOR = 1.5
ENGAGEMENT_CAP = 2.0
ENGAGEMENT_POWER = 0.2
BASE_PROBABILITY = 0.3
SIZE_TOLERANCE = 5
SIZE_TOLERANCE_SHARE = 0.3
STAR_SHARE = 0.6
CHAIN_SHARE = 0.4
CHAIN_TWEETS = 8


class Rule(NamedTuple):
    """An edge that a row gives where ``when`` holds."""

    kind: str
    when: Column
    src: Column
    dst: Column


def _apply(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """The edges of several rules in one pass over the rows."""
    if len(rules) == 1:
        rule = rules[0]
        return _edges(df.where(rule.when), rule.src, rule.dst, rule.kind)
    given = [
        F.when(
            rule.when,
            F.struct(
                rule.src.cast("long").alias("src_idx"),
                rule.dst.cast("long").alias("dst_idx"),
                F.lit(rule.kind).alias("kind"),
            ),
        )
        for rule in rules
    ]
    return df.select("news_id", F.inline(F.filter(F.array(*given), lambda edge: edge.isNotNull())))


def _edges(df: DataFrame, src: Column, dst: Column, kind: str) -> DataFrame:
    return df.select(
        "news_id", src.cast("long").alias("src_idx"), dst.cast("long").alias("dst_idx"), F.lit(kind).alias("kind")
    )


# --- recorded edges ---------------------------------------------------------------------------


def news_edges(ordered: DataFrame) -> DataFrame:
    """The news node points at every tweet."""
    return _edges(ordered, F.lit(0), F.col("node_idx"), "news")


def _match_ends(edges: DataFrame, tweets: DataFrame, carry: str) -> DataFrame:
    """Edges whose two ends are tweets of the edge's cascade, with ``carry`` of both ends.

    Both lookups are equi-joins on the unique tweet id; an end shared by very many edges is spread.
    """
    ends = tweets.select("news_id", "tweet_id", carry)
    named = "news_id" in edges.columns
    hot_sources, hot_targets = hot_key_sets(edges, [["source"], ["target"]])
    sources = ends.select(F.col("tweet_id").alias("source"), F.col("news_id").alias("_news"), F.col(carry).alias("_src"))
    own = F.col("news_id") == F.col("_news") if named else F.startswith("source", "_news")
    found = salted_join(edges, sources, ["source"], hot_sources, ["target"]).where(own)
    targets = ends.select(
        F.col("tweet_id").alias("target"), F.col("news_id").alias("_news"), F.col(carry).alias("_dst")
    )
    matched = salted_join(
        found.select("_news", "source", "target", "_src"),
        targets,
        ["_news", "target"],
        hot_targets,
        ["source"],
    )
    return matched.withColumnRenamed("_news", "news_id")


def cascade_edges(ordered: DataFrame, edges: DataFrame) -> DataFrame:
    """Recorded reposts within a cascade; duplicates are kept.

    An edge belongs to a cascade when its ``news_id`` says so or, without that column, when its source id
    starts with the news id; both ends must be tweets of the cascade.
    """
    return _edges(_match_ends(edges, ordered, "node_idx"), F.col("_src"), F.col("_dst"), "cascade")


def user_star(users: DataFrame) -> DataFrame:
    """The news node and every user, in both directions."""
    both = users.select(
        "news_id",
        F.explode(
            F.array(
                F.struct(F.lit(0).cast("long").alias("s"), F.col("user_idx").alias("d")),
                F.struct(F.col("user_idx").alias("s"), F.lit(0).cast("long").alias("d")),
            )
        ).alias("e"),
    )
    return _edges(both, F.col("e.s"), F.col("e.d"), "news")


def user_interaction(tweets: DataFrame, users: DataFrame, edges: DataFrame) -> DataFrame:
    """Reposts between two users of a cascade, in both directions, without self-loops; duplicates are kept.

    Here the source id's prefix alone tells an edge's cascade, also where the edges name one.
    """
    # A missing user id is one user of its cascade; the mark keeps it apart from any id.
    def known(df: DataFrame) -> DataFrame:
        return df.withColumn("user_id", F.coalesce(F.concat(F.lit("="), "user_id"), F.lit("")))

    tweets, users = known(tweets), known(users)
    hot_users = hot_keys(tweets, ["news_id", "user_id"])
    # A user's tweets in one cascade may be many, so the index lookup is spread as well.
    indexed = salted_join(
        tweets.where(F.col("news_id").isNotNull()).select("news_id", "tweet_id", "user_id"),
        users,
        ["news_id", "user_id"],
        hot_users,
        ["tweet_id"],
    )
    pairs = _match_ends(edges.select("source", "target"), indexed, "user_idx").where(F.col("_src") != F.col("_dst"))
    both = pairs.select(
        "news_id",
        F.explode(
            F.array(
                F.struct(F.col("_src").alias("s"), F.col("_dst").alias("d")),
                F.struct(F.col("_dst").alias("s"), F.col("_src").alias("d")),
            )
        ).alias("e"),
    )
    return _edges(both, F.col("e.s"), F.col("e.d"), "interaction")


# --- look-back rule ---------------------------------------------------------------------------


def heuristic_edge_prob(ordered: DataFrame, hot: HotKeys) -> DataFrame:
    """Candidate edges from each tweet's five predecessors, with their probability ``p``."""
    kind = F.coalesce("user_type", F.lit("regular")) if "user_type" in ordered.columns else F.lit("regular")
    slim = ordered.select("news_id", *ORDER, "retweets", "pos", "node_idx", kind.alias("user_type"))
    fields = ["node_idx", "timestamp", "retweets", "user_type"]
    pairs = lookback(slim, "news_id", ORDER, LOOKBACK, fields, "before", hot).select(
        "news_id", "node_idx", "timestamp", "user_type", F.explode("before").alias("prev")
    )
    decay = F.exp(-hours_between(F.col("timestamp"), F.col("prev.timestamp")) / F.lit(DECAY_HOURS))
    kinship = F.when(F.col("user_type") == F.col("prev.user_type"), SAME_TYPE_FACTOR).otherwise(1.0)
    # An unknown number of reposts counts as the cap: least() passes over the null.
    reposts = F.col("prev.retweets").cast("double") + 1
    engagement = F.least(F.lit(ENGAGEMENT_CAP), F.pow(reposts, F.lit(ENGAGEMENT_POWER)))
    return pairs.select(
        "news_id",
        F.col("prev.node_idx").alias("src_idx"),
        F.col("node_idx").alias("dst_idx"),
        (decay * kinship * engagement * F.lit(BASE_PROBABILITY)).alias("p"),
    )


def draw_edges(candidates: DataFrame, kind: str, p: Column | str, seed: str = "42") -> DataFrame:
    """Keep each candidate with its probability, by a repeatable draw."""
    chance = F.col(p) if isinstance(p, str) else p
    drawn = coin("news_id", F.lit(kind), "src_idx", "dst_idx", seed=seed) < chance
    return _edges(candidates.where(drawn), F.col("src_idx"), F.col("dst_idx"), kind)


def heuristic_edges(ordered: DataFrame, hot: HotKeys, seed: str = "42") -> DataFrame:
    """Edges drawn from the look-back candidates."""
    return draw_edges(heuristic_edge_prob(ordered, hot), "heuristic", "p", seed)


# --- pattern rules ----------------------------------------------------------------------------


def pattern_match(cascades: DataFrame, patterns: DataFrame, seed: str = "42") -> DataFrame:
    """Give each cascade one pattern of its class and of similar size, picked evenly at random.

    Patterns of a class are ranked by size, so the similar ones are a run of ranks. Where a run starts and
    how long it is depends only on the class and the cascade size, and is read off running counts over the
    *distinct* sizes. Each cascade then draws one rank and fetches it by an equi-join; cascades and
    patterns are never paired off. Without a similar pattern the run is the whole class. Cascades of a class
    without patterns are left out.
    """
    # Both are read several times below: to be counted, ranked, summed and joined.
    patterns = materialise(patterns, "patterns")
    sizes = materialise(cascades.select("is_fake", "cascade_size").distinct(), "sizes")
    small = is_small(patterns) and is_small(sizes)
    # Small tables cannot have hot groups, so there is nothing to look for.
    hot = HotKeys(("is_fake",), MAX_BROADCAST_ROWS) if small else None
    ranked = position(patterns, ["is_fake"], ["num_nodes", "pattern_id"], "rank", hot)
    # Sizes are whole numbers, so rounding the tolerance down changes nothing and keeps the bounds exact.
    tolerance = F.floor(
        F.greatest(F.lit(float(SIZE_TOLERANCE)), F.col("cascade_size") * F.lit(SIZE_TOLERANCE_SHARE))
    )
    none = F.lit(0).cast("long")
    # Each event is (value, turn): patterns count at turn 1, a run's start reads before them, its end after.
    events = union_all(
        [
            patterns.groupBy("is_fake", F.col("num_nodes").alias("value"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select("is_fake", "value", F.lit(1).alias("turn"), F.lit(None).cast("long").alias("cascade_size"), "n"),
            sizes.select("is_fake", (F.col("cascade_size") - tolerance).alias("value"), F.lit(0).alias("turn"),
                         "cascade_size", none.alias("n")),
            sizes.select("is_fake", (F.col("cascade_size") + tolerance).alias("value"), F.lit(2).alias("turn"),
                         "cascade_size", none.alias("n")),
        ]
    )
    counted = running_sums(events, ["is_fake"], ["value", "turn", "cascade_size"], {"seen": F.col("n")}, hot)
    runs = (
        counted.where(F.col("turn") != 1)
        .groupBy("is_fake", "cascade_size")
        .agg(
            F.max(F.when(F.col("turn") == 0, F.col("seen"))).alias("start"),
            F.max(F.when(F.col("turn") == 2, F.col("seen"))).alias("end"),
        )
    )
    per_class = F.broadcast(patterns.groupBy("is_fake").agg(F.count(F.lit(1)).alias("of_class")))  # two rows
    similar = F.col("end") > F.col("start")
    runs = runs.join(per_class, "is_fake").select(
        "is_fake",
        "cascade_size",
        F.when(similar, F.col("start")).otherwise(none).alias("start"),
        F.when(similar, F.col("end") - F.col("start")).otherwise(F.col("of_class")).alias("length"),
    )
    # Many cascades share a size, and many may draw one pattern.
    drawn = lookup_join(cascades, runs, ["is_fake", "cascade_size"], ["news_id"], small).withColumn(
        "rank", F.col("start") + F.floor(coin("news_id", F.lit("pattern"), seed=seed) * F.col("length"))
    )
    return lookup_join(drawn, ranked, ["is_fake", "rank"], ["news_id"], small).select(
        "news_id", "is_fake", "cascade_size", "pattern_id", "num_nodes", "level_0", "level_1", "level_2"
    )


def _pattern_sizes() -> tuple[Column, Column]:
    """How many level-1 and level-2 edges a cascade gets; 0 where the pattern lacks a level."""
    n = F.col("cascade_size")
    deep = F.col("level_0").isNotNull() & F.col("level_1").isNotNull()
    one = F.when(deep, F.least(F.col("level_1"), F.floor(n / 2))).otherwise(0)
    two = F.when(deep & F.col("level_2").isNotNull() & (n > 3), F.least(F.col("level_2"), F.floor(n / 3)))
    return one, F.coalesce(two, F.lit(0))


def with_pattern(ordered: DataFrame, matched: DataFrame, hot: HotKeys) -> DataFrame:
    """Ordered tweets of the matched cascades, with their pattern's level sizes."""
    levels = matched.select("news_id", "is_fake", "level_0", "level_1", "level_2")
    return salted_join(ordered, levels, ["news_id"], hot, ["tweet_id"])


def _level1() -> Rule:
    one, _ = _pattern_sizes()
    linked = (F.col("pos") < one) & (F.col("pos") < F.col("cascade_size") - 1)
    return Rule("level1", linked, F.col("pos") + 1, F.col("pos") + 2)


def _level2() -> Rule:
    one, two = _pattern_sizes()
    n = F.col("cascade_size")
    src = F.least(F.col("pos"), F.floor(n / 2))
    dst = F.least(one + F.col("pos"), n - 1)
    return Rule("level2", (F.col("pos") < two) & (src < dst), src + 1, dst + 1)


def _drawn(kind: str, when: Column, src: Column, dst: Column, share: float, seed: str) -> Rule:
    return Rule(kind, when & (coin("news_id", F.lit(kind), src, dst, seed=seed) < share), src, dst)


def _star(seed: str) -> Rule:
    return _drawn("star", F.col("pos") >= 2, F.col("popular_pos") + 1, F.col("node_idx"), STAR_SHARE, seed)


def _chain(seed: str) -> Rule:
    early = (F.col("pos") >= 1) & (F.col("pos") < CHAIN_TWEETS)
    return _drawn("chain", early, F.col("pos"), F.col("node_idx"), CHAIN_SHARE, seed)


def pattern_level1(patterned: DataFrame) -> DataFrame:
    """A chain over the first tweets, as long as the pattern's level 1 allows."""
    return _apply(patterned, [_level1()])


def pattern_level2(patterned: DataFrame) -> DataFrame:
    """Branches from the first tweets to those after the chain. The i-th branch is made from the i-th tweet's row."""
    return _apply(patterned, [_level2()])


def running_popular(ordered: DataFrame, hot: HotKeys) -> DataFrame:
    """Add ``popular_pos``: the earlier tweet with the most likes and reposts, the first of equals, 0 if none has any."""
    engagement = not_nan(F.col("likes").cast("double") + F.col("retweets").cast("double"))
    key = F.struct(engagement.alias("eng"), (-F.col("pos")).alias("back"))
    found = running_max(ordered, "news_id", ORDER, F.when(engagement > 0, key), "_top", hot)
    return found.withColumn("popular_pos", F.coalesce(-F.col("_top.back"), F.lit(0).cast("long"))).drop("_top")


def popular_star(ordered: DataFrame, hot: HotKeys, seed: str = "42") -> DataFrame:
    """Fake cascades: from the third tweet on, a drawn edge from the most popular earlier tweet."""
    return _apply(running_popular(ordered, hot), [_star(seed)])


def sequential_chain(ordered: DataFrame, seed: str = "42") -> DataFrame:
    """Real cascades: drawn edges along the first eight tweets."""
    return _apply(ordered, [_chain(seed)])


def realistic_edges(
    ordered: DataFrame, graphs: DataFrame, patterns: DataFrame | None, hot: HotKeys, seed: str = "42"
) -> DataFrame:
    """Pattern edges, or the look-back rule where no pattern can be applied.

    Without fake patterns every cascade falls back; with fake but no real patterns, the real ones do.
    """
    have = set()
    if patterns is not None:
        have = {row.is_fake for row in patterns.select("is_fake").distinct().collect()}  # at most two rows
    if True not in have:
        return heuristic_edges(ordered, hot, seed)
    matched = pattern_match(graphs.select("news_id", "is_fake", "cascade_size"), patterns, seed)
    patterned = running_popular(with_pattern(ordered, matched, hot), hot)
    fake = F.col("is_fake")
    star, chain = _star(seed), _chain(seed)
    rules = [
        _level1(),
        _level2(),
        star._replace(when=fake & star.when),
        chain._replace(when=~fake & chain.when),
    ]
    found = _apply(patterned, rules)
    if False in have:
        return found
    real = graphs.where(~F.col("is_fake")).select("news_id")
    rest = salted_join(ordered, real, ["news_id"], hot, ["tweet_id"])
    return found.unionByName(heuristic_edges(rest, hot, seed))


def all_edges(
    ordered: DataFrame,
    edges: DataFrame,
    graphs: DataFrame,
    hot: HotKeys,
    patterns: DataFrame | None = None,
    seed: str = "42",
) -> DataFrame:
    """All edges of the cascade graphs as a bag; every cascade has at least its news edges."""
    return union_all(
        [
            news_edges(ordered),
            cascade_edges(ordered, edges),
            realistic_edges(ordered, graphs, patterns, hot, seed),
        ]
    )


def interarrival(ordered: DataFrame, hot: HotKeys) -> DataFrame:
    """Hours since the previous tweet of the cascade and their decay weight; null for the first tweet."""
    before = lookback(
        ordered.select("news_id", *ORDER, "pos", "node_idx"), "news_id", ORDER, 1, ["timestamp"], "before", hot
    )
    gap = hours_between(F.col("timestamp"), F.try_element_at("before", F.lit(1))["timestamp"])
    return before.select("news_id", "tweet_id", "node_idx", gap.alias("gap_hours")).withColumn(
        "decay", F.exp(-F.col("gap_hours") / F.lit(DECAY_HOURS))
    )
