"""Stored graphs: which set is re-used, and what a broken write leaves."""

import pytest
from pyspark.sql import functions as F

from ripplegraph.plans import build
from ripplegraph.sources import writers


@pytest.fixture
def inputs(spark):
    tweets = spark.range(60).selectExpr(
        "concat('n', id % 6) as news_id", "concat('n', id % 6, '_t', id div 6) as tweet_id", "concat('u', id % 7) as user_id",
        "'some words' as text", "timestamp_seconds(1704067200 + id * 60) as timestamp", "id as likes", "id % 3 as retweets",
        "id < 6 as is_root", "cast(id % 2 as int) as label", "'regular' as user_type",
    )
    links = tweets.where("not is_root").selectExpr("concat(news_id, '_t0') as source", "tweet_id as target")
    return tweets, links


def _folders(path):
    return sorted(p.name for p in path.iterdir() if p.name.startswith("set-"))


def test_other_inputs_or_settings_give_another_set(spark, inputs, tmp_path):
    tweets, links = inputs
    path = str(tmp_path / "graphs")
    build.build_graphs(tweets, links, path)
    first = _folders(tmp_path / "graphs")
    build.build_graphs(tweets.repartition(5).select(*reversed(tweets.columns)), links.orderBy("target"), path)
    assert _folders(tmp_path / "graphs") == first and len(first) == 1

    plain = build.build_graphs(tweets, links, path, drawn=False)
    assert plain["edges"].select("kind").distinct().count() == 2
    build.build_graphs(tweets, links, path, drawn=False, seed="7")
    assert len(_folders(tmp_path / "graphs")) == 2
    build.build_graphs(tweets, links, path, seed="7")
    fewer = build.build_graphs(tweets.where("news_id != 'n0'"), links, path)
    assert len(_folders(tmp_path / "graphs")) == 4
    assert fewer["graphs"].count() == 5 and build.build_graphs(tweets, links, path)["graphs"].count() == 6
    users = build.build_user_graphs(tweets, links, path)
    assert users["nodes"].where("node_idx = 0").count() == users["graphs"].count()
    assert len(_folders(tmp_path / "graphs")) == 5


def test_named_versions_are_not_compared(spark, inputs, tmp_path):
    tweets, links = inputs
    path = str(tmp_path / "graphs")
    build.build_graphs(tweets, links, path, drawn=False, version="monday")
    again = build.build_graphs(tweets.where("false"), links, path, drawn=False, version="monday")
    assert again["graphs"].count() == 6
    assert build.build_graphs(tweets.where("false"), links, path, drawn=False, version="tuesday")["graphs"].count() == 0


def _tables(spark, n):
    one = spark.range(n).selectExpr("concat('g', id) as news_id")
    return {"nodes": one, "edges": one, "graphs": one}


def test_a_broken_overwrite_leaves_the_set_before(spark, tmp_path):
    path = str(tmp_path / "graphs")
    assert not writers.graphs_stored(spark, path)
    with pytest.raises(FileNotFoundError):
        writers.read_graphs(spark, path)
    read_before = writers.write_graphs(_tables(spark, 3), path)
    broken = _tables(spark, 5) | {"graphs": spark.range(5).select(F.raise_error(F.lit("stop")).cast("string").alias("news_id"))}
    with pytest.raises(Exception, match="stop"):
        writers.write_graphs(broken, path, overwrite=True)
    assert {n: t.count() for n, t in writers.read_graphs(spark, path).items()} == {"nodes": 3, "edges": 3, "graphs": 3}
    writers.write_graphs(_tables(spark, 4), path, overwrite=True)
    assert writers.read_graphs(spark, path)["nodes"].count() == 4 and read_before["nodes"].count() == 3


def test_superseded_sets_are_dropped(spark, tmp_path):
    path = str(tmp_path / "graphs")
    assert writers.drop_superseded(spark, path) == 0
    for n, mark in ((1, "a"), (2, "b"), (3, "a"), (4, "a")):
        writers.write_graphs(_tables(spark, n), path, overwrite=True, mark=mark)
    (tmp_path / "graphs" / "set-unfinished").mkdir()
    assert writers.drop_superseded(spark, path) == 2 and writers.drop_superseded(spark, path) == 0
    assert len(_folders(tmp_path / "graphs")) == 3
    assert writers.read_graphs(spark, path)["graphs"].count() == 4
    assert [writers.read_graphs(spark, path, m)["graphs"].count() for m in "ab"] == [4, 2]


def test_fingerprint(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "n int, t string")
    mark = writers.fingerprint({"rows": rows}, seed="1")
    assert mark == writers.fingerprint({"rows": rows.select("t", "n").repartition(3), "other": None}, seed="1")
    different = [
        writers.fingerprint({"rows": rows}, seed="2"),
        writers.fingerprint({"rows": rows.distinct()}, seed="1"),
        writers.fingerprint({"rows": rows.selectExpr("cast(n as bigint) as n", "t")}, seed="1"),
        writers.fingerprint({"rows": rows.where("false")}, seed="1"),
        writers.fingerprint({}, seed="1"),
    ]
    assert len({mark, *different}) == 6
