"""Groups too large for one task give the same results as ordinary ones."""

import pytest
from pyspark.sql import functions as F

from ripplegraph.operators import cascades, edges
from ripplegraph.plans import ordering, skew
from ripplegraph.plans.skew import hot_keys, salted_join


@pytest.fixture
def tweets(spark):
    """600 tweets, a third of them in one cascade, with equal timestamps in it."""
    return spark.range(600).selectExpr(
        "if(id % 3 = 0, 'viral', concat('n', id % 40)) as news_id",
        "concat('t', id) as tweet_id",
        "concat('u', id % 11) as user_id",
        "timestamp_seconds(cast(id * 7919 % 50 as long)) as timestamp",
        "if(id % 13 = 0, null, id * 31 % 17) as likes",
        "id * 17 % 23 as retweets",
        "cast(id % 2 as int) as label",
        "if(id % 5 = 0, 'bot', 'regular') as user_type",
        "'' as text",
    )


def same(a, b):
    columns = sorted(a.columns)
    a, b = a.select(columns), b.select(columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() and a.count() == b.count()


def test_hot_keys(tweets):
    found = hot_keys(tweets, ["news_id"], 50)
    assert [tuple(r) for r in found.table.collect()] == [("viral", 200)]
    assert (found.largest, found.total) == (200, 200)
    assert hot_keys(tweets, ["news_id"], 200).empty


def test_many_hot_keys_stay_distributed(tweets, monkeypatch):
    monkeypatch.setattr(skew, "MAX_BROADCAST_KEYS", 2)
    found = hot_keys(tweets, ["news_id"], 5)
    assert found.table.count() > 2 and found.largest == 200
    assert same(
        ordering.position(tweets, ["news_id"], cascades.ORDER, "pos", found),
        ordering.position(tweets, ["news_id"], cascades.ORDER, "pos"),
    )


@pytest.mark.parametrize("limit", [7, 50])
def test_split_order(tweets, limit):
    hot, cold = cascades.hot_cascades(tweets, limit), cascades.hot_cascades(tweets)
    split, plain = cascades.propagation_order(tweets, hot=hot), cascades.propagation_order(tweets, hot=cold)
    assert not hot.empty and cold.empty
    assert same(split, plain)
    assert same(edges.heuristic_edge_prob(split, hot), edges.heuristic_edge_prob(plain, cold))
    assert same(edges.running_popular(split, hot), edges.running_popular(plain, cold))
    assert same(edges.interarrival(split, hot), edges.interarrival(plain, cold))


def test_lookback_blocks_smaller_than_the_frame(tweets):
    hot, cold = cascades.hot_cascades(tweets, 2), cascades.hot_cascades(tweets)
    plain = cascades.propagation_order(tweets, hot=cold)
    assert same(edges.heuristic_edge_prob(plain, hot), edges.heuristic_edge_prob(plain, cold))


def test_global_position_and_sums(tweets, monkeypatch):
    plain = ordering.position(tweets, [], ["tweet_id"])
    sums = ordering.running_sums(tweets, ["label"], ["tweet_id"], {"seen": F.col("retweets")})
    monkeypatch.setattr(skew, "HOT_ROWS", 60)
    assert same(ordering.position(tweets, [], ["tweet_id"]), plain)
    assert same(ordering.running_sums(tweets, ["label"], ["tweet_id"], {"seen": F.col("retweets")}), sums)
    assert plain.agg(F.max("pos")).first()[0] == 599


@pytest.mark.parametrize("how", ["inner", "left", "left_anti", "left_semi"])
def test_salted_join(spark, tweets, how):
    side = spark.createDataFrame([("viral", 1), ("n1", 2), ("n2", 3)], "news_id string, n int")
    hot = hot_keys(tweets, ["news_id"], 50)
    assert same(salted_join(tweets, side, ["news_id"], hot, ["tweet_id"], how), tweets.join(side, ["news_id"], how))


def test_lookup_join(spark, tweets, monkeypatch):
    side = spark.createDataFrame([("viral", 1), ("n1", 2), ("n2", 3)], "news_id string, n int")
    plain = skew.lookup_join(tweets, side, ["news_id"], ["tweet_id"], small=True)
    assert skew.is_small(side)
    monkeypatch.setattr(skew, "MAX_BROADCAST_ROWS", 2)
    monkeypatch.setattr(skew, "HOT_ROWS", 50)
    assert not skew.is_small(side)
    assert same(skew.lookup_join(tweets, side, ["news_id"], ["tweet_id"], small=False), plain)


def test_key_sets_are_counted_together(tweets):
    a, b = skew.hot_key_sets(tweets, [["news_id"], ["user_id"]], 54)
    assert [tuple(r) for r in a.table.collect()] == [("viral", 200)]
    assert a.table.columns == ["news_id", "hot_rows"] and b.table.columns == ["user_id", "hot_rows"]
    assert b.table.count() == tweets.groupBy("user_id").count().where("count > 54").count() > 0


def test_split_results_do_not_depend_on_partitions(tweets):
    hot = cascades.hot_cascades(tweets, 40)
    a = cascades.propagation_order(tweets.repartition(1), hot=hot)
    b = cascades.propagation_order(tweets.repartition(13), hot=hot)
    assert same(a, b)


@pytest.mark.parametrize("ranges", [1, 3, 1 << 16])
def test_hot_keys_in_any_number_of_ranges(tweets, monkeypatch, ranges):
    """Keys that share a range with a hot key are not hot themselves; null is a key as any other."""
    monkeypatch.setattr(skew, "HASH_RANGES", ranges)
    some = tweets.selectExpr("if(news_id = 'viral', null, news_id) as news_id", "user_id")
    found = {tuple(r) for r in hot_keys(some, ["news_id", "user_id"], 3).table.collect()}
    assert found == {tuple(r) for r in some.groupBy("news_id", "user_id").count().where("count > 3").collect()}
    assert [tuple(r) for r in hot_keys(some, ["news_id"], 50).table.collect()] == [(None, 200)]
