"""Propagation over tables that are bucketed by story: no node state is exchanged, neither in a round nor between rounds.

Nodes and links are dealt to buckets by ``news_id`` once. Joins on (news_id, source) and groupings by (news_id, target) then
find their rows in the same bucket. A bucket holds whole stories, so stories above ``skew.HOT_ROWS`` links go the way of salted joins
instead. Stories don't touch one another, which makes the two results one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame

from ripplegraph.operators import graph
from ripplegraph.plans.skew import HotKeys, hot_keys, split_hot
from ripplegraph.session import materialise, scratch_path
from ripplegraph.sources.writers import drop_bucketed, save_bucketed

# Links that a bucket holds on average.
BUCKET_ROWS = 1_000_000
MAX_BUCKETS = 100_000
# Lets a table bucketed by a part of a join's keys meet another one as it lies. Off elsewhere: salted joins need the full key.
_FULL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
ORDINARY = HotKeys(("news_id",), 0)

Work = Callable[[DataFrame, DataFrame], DataFrame]


@contextmanager
def stored_by_story(nodes: DataFrame, links: DataFrame, buckets: int) -> Iterator[tuple[DataFrame, DataFrame]]:
    """Both tables, bucketed alike in the scratch folder. What is computed from them must be stored before the scope ends.

    Joins are asked to merge, so that a small table isn't sent to all tasks in place of lying where it is needed.
    """
    spark = nodes.sparkSession
    names = [f"{kind}_{uuid.uuid4().hex}" for kind in ("nodes", "links")]
    paths = [scratch_path(spark, "bucketed") for _ in names]
    before = spark.conf.get(_FULL_KEYS)
    try:
        tables = [save_bucketed(df, n, buckets, path=p) for df, n, p in zip((nodes, links), names, paths)]
        spark.conf.set(_FULL_KEYS, "false")
        yield tables[0].hint("merge"), tables[1].hint("merge")
    finally:
        spark.conf.set(_FULL_KEYS, before)
        for name, path in zip(names, paths):
            drop_bucketed(spark, name, path)


def _in_buckets(nodes: DataFrame, links: DataFrame, work: Work, salted: Work) -> DataFrame:
    """``work`` on the bucketed tables of ordinary stories, and ``salted`` on those of hot ones."""
    links = materialise(links, "links")
    hot = hot_keys(links, ["news_id"])
    parts = []
    if not hot.empty:
        (nodes, large), (links, many) = split_hot(nodes, hot), split_hot(links, hot)
        parts = [salted(large.drop("hot_rows"), many.drop("hot_rows"))]
    buckets = min(MAX_BUCKETS, -(-links.count() // BUCKET_ROWS) or 1)
    with stored_by_story(nodes, links, buckets) as (lying, meeting):
        done = materialise(work(lying, meeting), "propagated")
    return done.unionByName(parts[0]) if parts else done


def gcn_propagate(nodes: DataFrame, edges: DataFrame, names: list[str], rounds: int = 1) -> DataFrame:
    """As :func:`graph.gcn_propagate`: all rounds run on the stored buckets, in one stage."""
    slim = nodes.select(*graph.NODE, *names)

    def salted(large: DataFrame, links: DataFrame) -> DataFrame:
        return graph.gcn_rounds(large, links, names, rounds, hot_keys(links, ["news_id", "src_idx"]))

    def bucketed(lying: DataFrame, links: DataFrame) -> DataFrame:
        return graph.gcn_rounds(lying, links, names, rounds, ORDINARY, store_every=rounds + 1)

    return _in_buckets(slim, graph.links_of(slim, edges), bucketed, salted)


def sage_mean(nodes: DataFrame, edges: DataFrame, names: list[str], prefix: str = "mean_") -> DataFrame:
    """As :func:`graph.sage_mean`, on the stored buckets."""
    slim = nodes.select(*graph.NODE, *names)

    def salted(large: DataFrame, links: DataFrame) -> DataFrame:
        return graph.sage_round(large, links, names, prefix, hot_keys(links, ["news_id", "src_idx"]))

    def bucketed(lying: DataFrame, links: DataFrame) -> DataFrame:
        return graph.sage_round(lying, links, names, prefix, ORDINARY)

    return _in_buckets(slim, graph.links_of(slim, edges, drop_loops=False), bucketed, salted)
