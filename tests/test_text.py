"""Text figures of cascades against plain Python, and the plan behind them."""

import math
import statistics
from collections import Counter

import pytest
from pyspark.ml.feature import HashingTF

from ripplegraph.operators import cascades, text

ROWS = [
    ("a", "u1", "So GOOD so good!", 4, 1),
    ("a", "u1", "\tso  bad?　Bad ", None, 2),
    ("a", None, None, 6, None),
    ("a", "u2", "", 0, 0),
    ("b", None, None, None, None),
    (None, "u1", "no cascade", 1, 1),
]


def _rows(spark):
    return spark.createDataFrame(ROWS, "news_id string, user_id string, text string, likes bigint, retweets bigint")


def _mean(values):
    return sum(values) / len(values) if values else None


def test_news_text_stats(spark):
    found = {r["news_id"]: r for r in text.news_text_stats(_rows(spark)).collect()}
    assert set(found) == {"a", "b"}
    for news in found:
        rows = [r for r in ROWS if r[0] == news]
        texts = [r[2] or "" for r in rows]
        words = [w for t in texts for w in t.lower().split()]
        excited = [t.count("!") + t.count("?") + sum(c.isupper() for c in t) / (len(t) + 1) for t in texts]
        got = found[news]
        assert got.n_tweets == len(rows) and got.n_users == len({r[1] for r in rows} - {None})
        for k, name in ((3, "likes"), (4, "retweets")):
            known = [r[k] for r in rows if r[k] is not None]
            assert got[f"sum_{name}"] == sum(known) and got[f"mean_{name}"] == _mean(known)
        assert got.diversity == len(set(words)) / (len(words) + 1)
        assert abs(got.variance - statistics.pvariance(excited)) < 1e-12


def test_news_text_stats_reads_and_splits_once(spark, tmp_path):
    path = str(tmp_path / "tweets")
    _rows(spark).write.parquet(path)
    stats = text.news_text_stats(spark.read.parquet(path))
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("split(") == 1
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan


def test_news_text_stats_of_nothing(spark):
    assert text.news_text_stats(_rows(spark).where("false")).count() == 0


SIZE = 16


def _unit(counts, weights):
    values = [counts[i] * weights[i] for i in range(SIZE)]
    norm = math.sqrt(sum(v * v for v in values))
    return [v / norm if norm else 0.0 for v in values]


def test_user_vectors_by_hand(spark):
    """Texts of one user count as one text, those of the whole cascade as the news node's; small cascades have no nodes."""
    rows = [
        ("a", "u1", "One two", 1), ("a", "u2", "two three three", 2), ("a", "u1", "four\tone", 3), ("a", None, "five", 4),
        ("a", "u4", None, 5), ("a", None, "two", 6), ("b", "u1", "one", 1), ("b", "u2", "six", 2), (None, "u1", "seven", 1),
    ]
    schema = "news_id string, user_id string, text string, at int"
    tweets = spark.createDataFrame(rows, schema).selectExpr("*", "concat(news_id, at) as tweet_id", "timestamp_seconds(at) as timestamp")
    users = cascades.user_index(tweets)
    index = {r["user_id"]: r["user_idx"] for r in users.collect()}
    assert set(index) == {"u1", "u2", None, "u4"}
    nodes = spark.createDataFrame([("a", i, float(i), i / 8) for i in range(5)], "news_id string, node_idx bigint, x0 double, x1 double")
    found = {r["node_idx"]: r["state"] for r in text.user_vectors(nodes, users, tweets, ["x0", "x1"], SIZE).collect()}

    place = HashingTF(numFeatures=SIZE).indexOf
    counts = {u: Counter() for u in index}
    for news, user, words, _ in rows:
        if news == "a":
            counts[user].update(place(w) for w in (words or "").lower().split())
    held = Counter(i for c in counts.values() for i in c)
    weights = [math.log((len(counts) + 1) / (held[i] + 1)) for i in range(SIZE)]
    wanted = {index[u]: _unit(c, weights) for u, c in counts.items()} | {0: _unit(sum(counts.values(), Counter()), weights)}
    assert set(found) == set(wanted) == set(range(5))
    for node, vector in wanted.items():
        assert found[node] == pytest.approx([*vector, float(node), node / 8])
    assert found[index["u4"]][:SIZE] == [0.0] * SIZE
