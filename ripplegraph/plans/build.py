"""Building the stored graphs of a dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.operators import cascades, edges, features
from ripplegraph.operators.text import DIMENSIONS, news_text_stats, user_vectors
from ripplegraph.plans.ordering import union_all
from ripplegraph.session import materialise
from ripplegraph.sources import writers


def stored_order(tweets: DataFrame):
    """The ordered slim tweets, stored: nodes, edges and graphs all start from them."""
    hot = cascades.hot_cascades(tweets)
    return materialise(cascades.propagation_order(features.slim_tweets(tweets), hot=hot), "ordered"), hot


def whole_graph(tweets: DataFrame, links: DataFrame, patterns: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Stored node matrix, and stored edges of all kinds: news, cascade and drawn ones."""
    ordered, hot = stored_order(tweets)
    nodes = features.node_matrix(ordered, features.news_features(ordered))
    joined = edges.all_edges(ordered, links, cascades.graphs_of(ordered), hot, patterns)
    return materialise(nodes, "nodes"), materialise(joined, "edges")


def build_graphs(
    tweets: DataFrame,
    links: DataFrame,
    path: str,
    patterns: DataFrame | None = None,
    drawn: bool = True,
    seed: str = "42",
    overwrite: bool = False,
    version: str | None = None,
) -> dict[str, DataFrame]:
    """Build and store nodes, edges and graphs; those built earlier from the same inputs with the same settings are re-used.

    ``drawn=False`` leaves out the edges that are drawn at random, with ``patterns`` and ``seed``. A caller that knows the version of
    the input tables can name it and save the scan that compares their rows.
    """
    spark = tweets.sparkSession
    patterns, seed = (patterns, seed) if drawn else (None, "")
    inputs = {"tweets": tweets, "links": links, "patterns": patterns} if version is None else {}
    mark = writers.fingerprint(inputs, kind="tweets", seed=seed, drawn=drawn, patterns=patterns is not None, version=version)
    if not overwrite and writers.graphs_stored(spark, path, mark):
        return writers.read_graphs(spark, path, mark)
    ordered, hot = stored_order(tweets)
    graphs = cascades.graphs_of(ordered)
    parts = [edges.news_edges(ordered), edges.cascade_edges(ordered, links)]
    if drawn:
        parts.append(edges.realistic_edges(ordered, graphs, patterns, hot, seed))
    nodes = features.node_matrix(ordered, features.news_features(ordered))
    tables = {"nodes": nodes, "edges": union_all(parts), "graphs": graphs}
    return writers.write_graphs(tables, path, overwrite=True, mark=mark)


def user_states(tweets: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """Every node of the graphs of users with its ``state``: the vector of its texts followed by its figures."""
    users = materialise(cascades.user_index(tweets), "users")
    nodes = features.user_matrix(users, news_text_stats(tweets), features.user_features_text(tweets), text=True)
    return user_vectors(nodes, users, tweets, [c for c in nodes.columns if c.startswith("x")], dimensions)


def build_user_graphs(
    tweets: DataFrame,
    links: DataFrame,
    path: str,
    text: bool = False,
    overwrite: bool = False,
    vectors: bool = False,
    version: str | None = None,
) -> dict[str, DataFrame]:
    """Build and store the graphs of users around each news item; those built earlier from the same inputs are re-used.

    ``text`` uses the figures with text features; ``vectors`` also gives every node a ``state`` of its text vector and these figures.
    """
    spark = tweets.sparkSession
    inputs = {"tweets": tweets, "links": links} if version is None else {}
    mark = writers.fingerprint(inputs, kind="users", text=text or vectors, vectors=vectors, version=version)
    if not overwrite and writers.graphs_stored(spark, path, mark):
        return writers.read_graphs(spark, path, mark)
    users = materialise(cascades.user_index(tweets), "users")
    if text or vectors:
        nodes = features.user_matrix(users, news_text_stats(tweets), features.user_features_text(tweets), text=True)
    else:
        nodes = features.user_matrix(users, features.news_features(tweets), features.user_features(tweets))
    if vectors:
        nodes = materialise(nodes, "nodes")
        names = [c for c in nodes.columns if c.startswith("x")]
        nodes = nodes.join(user_vectors(nodes, users, tweets, names), ["news_id", "node_idx"])
    joined = edges.user_star(users).unionByName(edges.user_interaction(tweets, users, links))
    sized = users.groupBy("news_id").agg((F.max("user_idx") + 1).alias("num_nodes"))
    graphs = cascades.cascade_label(tweets).join(sized, "news_id")
    return writers.write_graphs({"nodes": nodes, "edges": joined, "graphs": graphs}, path, overwrite=True, mark=mark)


def sizes(stored: dict[str, DataFrame]) -> DataFrame:
    """Stored graphs with their numbers of nodes and edges."""
    counted = [
        stored[name].groupBy("news_id").agg(F.count(F.lit(1)).alias(name)) for name in ("nodes", "edges")
    ]
    return stored["graphs"].join(counted[0], "news_id").join(counted[1], "news_id")
