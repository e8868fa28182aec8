"""Depths by doubled pointers, and attention in one exchange, against plain searches and dense matrices."""

import random
import uuid

import numpy as np
import pytest
from test_graph import random_graphs, tables

from ripplegraph.operators import graph, structure
from ripplegraph.plans import skew

LINKS = "news_id string, source string, target string"


def searched(count, links):
    """Hops from the nearest tweet that is nobody's target, level by level."""
    below = {}
    for s, t in links:
        below.setdefault(s, []).append(t)
    level = [i for i in range(count) if i not in {t for _, t in links}]
    depth = dict.fromkeys(level, 0)
    while level:
        nxt = [t for s in level for t in below.get(s, [])]
        level = [t for t in dict.fromkeys(nxt) if t not in depth]
        for t in level:
            depth[t] = 1 + min(depth[s] for s, to in links if to == t and s in depth and s not in level)
    return {i: depth.get(i) for i in range(count)}


def given(spark, graphs):
    tweets = [(f"c{g}", f"t{i}") for g, (count, _) in enumerate(graphs) for i in range(count)]
    links = [(f"c{g}", f"t{s}", f"t{t}") for g, (_, pairs) in enumerate(graphs) for s, t in pairs]
    return spark.createDataFrame(tweets, "news_id string, tweet_id string"), spark.createDataFrame(links, LINKS)


def depths(df):
    return {(r.news_id, r.tweet_id): r.depth for r in df.collect()}


def jobs_of(spark, run):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "count")
    out = run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_depth_of_forests(spark):
    rng = random.Random(4)
    graphs = [(n, [(rng.randrange(i), i) for i in range(1, n) if rng.random() < 0.9]) for n in (1, 2, 9, 30, 60)]
    found = depths(structure.node_depth(*given(spark, graphs)))
    assert found == {(f"c{g}", f"t{i}"): d for g, (n, pairs) in enumerate(graphs) for i, d in searched(n, pairs).items()}


def test_depth_of_any_graph(spark):
    """Several sources, circles, loops, repeated links."""
    rng = random.Random(7)
    graphs = []
    for n, m in ((6, 5), (10, 14), (25, 24), (25, 40), (40, 44), (3, 9)):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        graphs.append((n, pairs + pairs[:2]))
    graphs.append((6, [(0, 1), (1, 2), (2, 3), (3, 1), (4, 5), (5, 4)]))
    graphs.append((4, [(0, 1), (1, 1), (2, 2), (2, 3)]))
    found = depths(structure.node_depth(*given(spark, graphs)))
    assert found == {(f"c{g}", f"t{i}"): d for g, (n, pairs) in enumerate(graphs) for i, d in searched(n, pairs).items()}


def test_depth_up_to_a_limit(spark):
    found = depths(structure.node_depth(*given(spark, [(5, [(i, i + 1) for i in range(4)])]), max_depth=2))
    assert [found["c0", f"t{i}"] for i in range(5)] == [0, 1, 2, None, None]


def test_jobs_grow_with_the_logarithm_of_the_depth(spark):
    def run(n):
        tweets, links = given(spark, [(n, [(i, i + 1) for i in range(n - 1)])])
        return depths(structure.node_depth(tweets, links))

    _, few = jobs_of(spark, lambda: run(100))
    found, many = jobs_of(spark, lambda: run(10_000))
    assert all(found["c0", f"t{i}"] == i for i in range(10_000))
    # seven doublings more
    assert many <= few + 7 * 8


def test_long_chains_between_tweets_with_several_sources(spark):
    """A search over contracted chains: its rounds don't grow with the chains' length."""
    n = 600
    pairs = [(i, i + 1) for i in range(n - 1)] + [(0, 300), (300, 1), (599, 300)]
    found = depths(structure.node_depth(*given(spark, [(n, pairs)])))
    assert found == {("c0", f"t{i}"): d for i, d in searched(n, pairs).items()}


# --- attention


def dense_attention(x, links, a, b):
    out = np.zeros_like(x)
    for i in range(len(x)):
        sources = [i, *[s for s, d in links if d == i and s != i]]
        e = np.array([x[s] @ a + x[i] @ b for s in sources])
        e = np.where(e > 0, e, 0.2 * e)
        w = np.exp(e - e.max())
        out[i] = (w[:, None] * x[sources]).sum(axis=0) / w.sum()
    return out


@pytest.mark.parametrize("limit", [None, 2])
@pytest.mark.parametrize("scale", [1.0, 800.0])
def test_attention(spark, monkeypatch, limit, scale):
    if limit:
        monkeypatch.setattr(skew, "HOT_ROWS", limit)
    graphs = random_graphs(8, 4) + [(np.array([[0.0, 0, 0, 0], [1, -1, 1, 0], [-1, 1, 2, 0]]), [(0, 1), (1, 2), (2, 1), (0, 2), (0, 2)])]
    nodes, links = tables(spark, graphs)
    a, b = np.array([1.0, -0.5, 0.25, 0.5]) * scale, np.array([-1.0, 0.5, 1, 0.25]) * scale
    names = [f"x{i}" for i in range(4)]
    found = {(r.news_id, r.node_idx): [r[n] for n in names] for r in graph.gat_attention(nodes, links, names, a, b).collect()}
    for g, (x, e) in enumerate(graphs):
        for i, row in enumerate(dense_attention(x, e, a, b)):
            assert found[f"g{g}", i] == pytest.approx(row.tolist())


def test_attention_exchanges_what_is_sent_once(spark):
    nodes, links = tables(spark, random_graphs(8, 2))
    names = [f"x{i}" for i in range(4)]
    plan = graph.gat_attention(nodes, links, names, [1.0] * 4, [1.0] * 4)._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[-1]
    assert plan.count("Join ") == 1 and plan.count("Exchange hashpartitioning") == 3
