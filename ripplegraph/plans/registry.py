"""One named query per operator, over whole test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripplegraph.operators import analysis, cascades, checks, edges, features, graph, learning, metrics, structure, text, vectors
from ripplegraph.plans import build, colocated
from ripplegraph.plans.ordering import union_all
from ripplegraph.plans.skew import HotKeys
from ripplegraph.schema import align_schema
from ripplegraph.session import materialise, scratch_path
from ripplegraph.sources import adapters, readers, writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

MATRIX = [f"x{i}" for i in range(8)]
A, B = "structure", "text"


def _plain(df: DataFrame) -> DataFrame:
    """Doubles to six places, so that sums taken in another order compare equal; -0 becomes 0."""
    def shown(field: T.StructField):
        value = F.col(field.name)
        return (F.round(value, 6) + F.lit(0.0)).alias(field.name) if isinstance(field.dataType, T.DoubleType) else value

    return df.select(*[shown(f) for f in df.schema.fields])


def query(run: Query, name: str | None = None) -> Query:
    """Register a query under its function's name, or another."""

    @wraps(run)
    def rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _plain(run(spark, sf_dir))

    QUERIES[name or run.__name__] = rounded
    return run


def _ordered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, HotKeys]:
    tweets = adapters.tweets(spark, sf_dir)
    hot = cascades.hot_cascades(tweets)
    return cascades.propagation_order(tweets, hot=hot), hot


def _links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    tweets = adapters.tweets(spark, sf_dir)
    return tweets, materialise(structure.tweet_links(tweets, adapters.edges(spark, sf_dir)), "links")


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tweets = adapters.tweets(spark, sf_dir)
    ordered = cascades.propagation_order(features.slim_tweets(tweets))
    return features.node_matrix(ordered, features.news_features(tweets))


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The stored node matrix and all edges of every graph."""
    return build.whole_graph(adapters.tweets(spark, sf_dir), adapters.edges(spark, sf_dir), adapters.patterns(spark, sf_dir))


# --- sources, sinks, schema -------------------------------------------------------------------


@query
def read_tweets(spark, sf_dir):
    """Tweets written as CSV and read back."""
    path = scratch_path(spark, "tweets")
    writers.write_csv(adapters.tweets(spark, sf_dir), path)
    return readers.read_tweets(spark, path).select(
        "tweet_id", "user_id", "text", F.unix_micros("timestamp").alias("ts_us"), "likes", "retweets", "is_root",
        "label", "news_id", "user_followers", "user_verified", "user_credibility", "user_type",
    )


@query
def read_edges(spark, sf_dir):
    """Edges written as CSV and read back."""
    path = scratch_path(spark, "edges")
    writers.write_csv(adapters.edges(spark, sf_dir).drop("event_id"), path)
    return readers.read_edges(spark, path).select("source", "target", F.unix_micros("timestamp").alias("ts_us"))


@query
def read_patterns(spark, sf_dir):
    """Patterns written as JSON trees and read back as level sizes."""
    path = scratch_path(spark, "patterns")

    def members(n: int):
        size = F.coalesce(F.col(f"level_{n}"), F.lit(0).cast("long")).cast("int")
        return F.transform(F.when(size > 0, F.sequence(F.lit(1), size)), lambda i: i.cast("string"))

    tree = F.map_filter(F.map_from_arrays(F.array(*[F.lit(str(n)) for n in range(3)]), F.array(*[members(n) for n in range(3)])),
                        lambda _, v: v.isNotNull())
    adapters.patterns(spark, sf_dir).select(
        "is_fake", F.col("num_nodes").cast("int").alias("num_nodes"), tree.alias("propagation_tree")
    ).write.json(path)
    return readers.read_patterns(spark, path, lines=True).drop("pattern_id")


def _aligned(spark, sf_dir):
    """Tweets without verified flags and with unknown scores, filled with the cascade defaults."""
    bare = adapters.tweets(spark, sf_dir).drop("user_verified").withColumn(
        "user_bot_score", F.when(F.col("retweets") % 2 == 0, F.col("user_bot_score"))
    )
    return align_schema(bare, "cascade").select(
        "tweet_id", "user_followers", "user_verified", "user_credibility", "user_bot_score", "user_type"
    )


query(_aligned, "align_schema")


@query
def align_schema_user(spark, sf_dir):
    bare = adapters.user_tweets(spark, sf_dir).drop("following")
    filled = align_schema(bare, "user").select("tweet_id", "followers", "following", "verified", "credibility")
    guessed = align_schema(adapters.tweets(spark, sf_dir), "user_text").select("tweet_id", "user_following")
    return filled.join(guessed, "tweet_id")


@query
def write_graphs(spark, sf_dir):
    """Nodes, edges and graphs stored and read back: their sizes per graph."""
    stored = build.build_graphs(
        adapters.tweets(spark, sf_dir), adapters.edges(spark, sf_dir), scratch_path(spark, "graphs"),
        adapters.patterns(spark, sf_dir),
    )
    return build.sizes(stored)


@query
def write_user_graphs(spark, sf_dir):
    """The same for the graphs of users."""
    tweets = adapters.tweets(spark, sf_dir).join(
        adapters.user_tweets(spark, sf_dir).select("tweet_id", "followers", "following", "verified", "credibility"), "tweet_id"
    )
    # Both inputs are read for the digest and again for every table: each is joined once.
    tweets, links = materialise(tweets, "tweets"), materialise(adapters.edges(spark, sf_dir), "links")
    return build.sizes(build.build_user_graphs(tweets, links, scratch_path(spark, "graphs")))


@query
def write_edges_tweets(spark, sf_dir):
    """Both CSV sinks, read back and counted per cascade."""
    tweets_path, edges_path = scratch_path(spark, "tweets"), scratch_path(spark, "edges")
    writers.write_csv(adapters.tweets(spark, sf_dir), tweets_path)
    writers.write_csv(adapters.edges(spark, sf_dir).drop("event_id"), edges_path)
    tweets, repost = readers.read_tweets(spark, tweets_path), readers.read_edges(spark, edges_path)
    outgoing = repost.groupBy(F.split_part("source", F.lit("_t"), F.lit(1)).alias("news_id")).agg(
        F.count(F.lit(1)).alias("edges")
    )
    sized = tweets.groupBy("news_id").agg(F.count(F.lit(1)).alias("tweets"), F.sum("likes").alias("likes"))
    return sized.join(outgoing, "news_id", "left").withColumn("edges", F.coalesce("edges", F.lit(0).cast("long")))


def _metric_parts(spark, sf_dir) -> DataFrame:
    scored = adapters.predictions(spark, sf_dir)
    even = F.substring("news_id", 2, 20).cast("long") % 2 == 0
    return union_all(
        [metrics.metric_records(scored.where(even), "even"), metrics.metric_records(scored.where(~even), "odd")]
    )


@query
def results_table(spark, sf_dir):
    """Metrics of two runs appended to one table, read back and pivoted."""
    path = scratch_path(spark, "metrics")
    records = _metric_parts(spark, sf_dir)
    writers.append_metrics(records.where("run = 'even'"), path)
    writers.append_metrics(records.where("run = 'odd'"), path)
    return writers.results_table(spark.read.parquet(path), ["accuracy", "f1", "auc", "log_loss"])


# --- cascades ---------------------------------------------------------------------------------


@query
def cascade_group(spark, sf_dir):
    return cascades.cascade_sizes(adapters.tweets(spark, sf_dir))


@query
def min_size_filter(spark, sf_dir):
    return cascades.min_size_filter(adapters.tweets(spark, sf_dir))


@query
def min_users_filter(spark, sf_dir):
    return cascades.min_users_filter(adapters.conversation_tweets(spark, sf_dir))


@query
def propagation_order(spark, sf_dir):
    ordered, _ = _ordered(spark, sf_dir)
    return ordered.select("news_id", "tweet_id", "node_idx", "cascade_size")


@query
def propagation_order_ties(spark, sf_dir):
    """The order of the part cascades, where many rows share a date."""
    ordered = cascades.propagation_order(adapters.big_cascades(spark, sf_dir))
    return ordered.select("news_id", "tweet_id", "node_idx", "cascade_size")


@query
def user_index(spark, sf_dir):
    return cascades.user_index(adapters.tweets(spark, sf_dir))


@query
def cascade_label(spark, sf_dir):
    return cascades.cascade_label(adapters.tweets(spark, sf_dir))


@query
def node_table(spark, sf_dir):
    ordered, _ = _ordered(spark, sf_dir)
    return cascades.node_table(ordered, cascades.graphs_of(ordered))


@query
def user_node_table(spark, sf_dir):
    return cascades.user_node_table(cascades.user_index(adapters.tweets(spark, sf_dir)))


@query
def graph_table(spark, sf_dir):
    return cascades.graph_table(adapters.tweets(spark, sf_dir))


@query
def credibility_sample(spark, sf_dir):
    return cascades.credibility_sample(adapters.users(spark, sf_dir), "team", 5).select(
        "team", "user_id", "credibility", "pick"
    )


@query
def user_tier(spark, sf_dir):
    users = adapters.users(spark, sf_dir).select("user_id", "user_no").distinct()
    return cascades.user_tier(users, ["user_no"]).select("user_id", "user_type", "place", "tier_no")


@query
def head_examples(spark, sf_dir):
    return cascades.head_examples(cascades.graph_table(adapters.tweets(spark, sf_dir)), ["news_id"], 50)


# --- edges ------------------------------------------------------------------------------------


@query
def news_edges(spark, sf_dir):
    return edges.news_edges(_ordered(spark, sf_dir)[0])


@query
def cascade_edges(spark, sf_dir):
    return edges.cascade_edges(_ordered(spark, sf_dir)[0], adapters.edges_noisy(spark, sf_dir))


@query
def heuristic_edges(spark, sf_dir):
    return edges.heuristic_edges(*_ordered(spark, sf_dir))


@query
def heuristic_edge_prob(spark, sf_dir):
    return edges.heuristic_edge_prob(*_ordered(spark, sf_dir))


def _matched(spark, sf_dir) -> DataFrame:
    graphs = cascades.graph_table(adapters.tweets(spark, sf_dir))
    return edges.pattern_match(graphs.select("news_id", "is_fake", "cascade_size"), adapters.patterns(spark, sf_dir))


def _patterned(spark, sf_dir) -> tuple[DataFrame, HotKeys]:
    ordered, hot = _ordered(spark, sf_dir)
    return edges.with_pattern(ordered, _matched(spark, sf_dir), hot), hot


@query
def pattern_match(spark, sf_dir):
    return _matched(spark, sf_dir)


@query
def pattern_level1(spark, sf_dir):
    return edges.pattern_level1(_patterned(spark, sf_dir)[0])


@query
def pattern_level2(spark, sf_dir):
    return edges.pattern_level2(_patterned(spark, sf_dir)[0])


@query
def popular_star(spark, sf_dir):
    ordered, hot = _ordered(spark, sf_dir)
    return edges.popular_star(ordered, hot)


@query
def sequential_chain(spark, sf_dir):
    return edges.sequential_chain(_ordered(spark, sf_dir)[0])


def _all_edges(spark, sf_dir, patterns: DataFrame | None) -> DataFrame:
    ordered, hot = build.stored_order(adapters.tweets(spark, sf_dir))
    return edges.all_edges(ordered, adapters.edges(spark, sf_dir), cascades.graphs_of(ordered), hot, patterns)


@query
def all_edges(spark, sf_dir):
    return _all_edges(spark, sf_dir, adapters.patterns(spark, sf_dir))


@query
def all_edges_lookback(spark, sf_dir):
    """All edges where there are no patterns."""
    return _all_edges(spark, sf_dir, None)


@query
def user_star(spark, sf_dir):
    return edges.user_star(cascades.user_index(adapters.tweets(spark, sf_dir)))


@query
def user_interaction(spark, sf_dir):
    tweets = adapters.tweets(spark, sf_dir)
    return edges.user_interaction(tweets, cascades.user_index(tweets), adapters.edges(spark, sf_dir))


@query
def text_lookup(spark, sf_dir):
    """Texts for every node; in the text table some tweets go by another id."""
    tweets = adapters.tweets(spark, sf_dir)
    ordered, _ = _ordered(spark, sf_dir)
    nodes = cascades.node_table(ordered, cascades.graphs_of(ordered))
    renamed = F.substring_index("tweet_id", "_t", -1).cast("long") % 17 == 0
    other = F.when(renamed, F.concat(F.lit("lost_"), "tweet_id")).otherwise(F.col("tweet_id"))
    return text.text_lookup(nodes, tweets.withColumn("tweet_id", other))


@query
def feature_concat(spark, sf_dir):
    names = features.TWEET_FEATURES
    tweets = features.tweet_features(adapters.tweets(spark, sf_dir))
    joined = text.feature_concat(tweets, adapters.vectors(spark, sf_dir), ["news_id", "tweet_id"], names)
    return graph.spread_array(joined, ["tweet_id"], "features", len(names) + 64)


# --- features ---------------------------------------------------------------------------------


@query
def news_features(spark, sf_dir):
    return features.news_features(adapters.tweets(spark, sf_dir))


@query
def tweet_features(spark, sf_dir):
    return features.tweet_features(adapters.tweets(spark, sf_dir))


@query
def user_features(spark, sf_dir):
    return features.user_features(adapters.user_tweets(spark, sf_dir))


@query
def user_features_text(spark, sf_dir):
    return features.user_features_text(adapters.document_tweets(spark, sf_dir))


@query
def user_matrix(spark, sf_dir):
    tweets = adapters.user_tweets(spark, sf_dir)
    return features.user_matrix(cascades.user_index(tweets), features.news_features(tweets), features.user_features(tweets))


@query
def user_matrix_text(spark, sf_dir):
    """User graphs of the documents; the news rows are padded to the users' width."""
    tweets = adapters.document_tweets(spark, sf_dir)
    return features.user_matrix(
        cascades.user_index(tweets), text.news_text_stats(tweets), features.user_features_text(tweets), text=True
    )


@query
def news_text_stats(spark, sf_dir):
    return text.news_text_stats(adapters.document_tweets(spark, sf_dir))


@query
def text_diversity(spark, sf_dir):
    return text.text_diversity(adapters.document_tweets(spark, sf_dir))


@query
def sentiment_variance(spark, sf_dir):
    return text.sentiment_variance(adapters.document_tweets(spark, sf_dir))


@query
def writing_style(spark, sf_dir):
    return text.writing_style(adapters.document_tweets(spark, sf_dir))


@query
def time_since_news(spark, sf_dir):
    tweets = adapters.tweets(spark, sf_dir)
    return structure.time_since_news(tweets, cascades.hot_cascades(tweets))


@query
def node_degree(spark, sf_dir):
    return structure.node_degree(*_links(spark, sf_dir))


@query
def cascade_depth(spark, sf_dir):
    """Depth of every tweet, with the depth of its cascade."""
    depths = structure.node_depth(*_links(spark, sf_dir))
    return depths.join(structure.cascade_depth(depths), "news_id")


@query
def reply_retweet_count(spark, sf_dir):
    return structure.reply_retweet_count(*_links(spark, sf_dir))


@query
def local_influence(spark, sf_dir):
    return structure.local_influence(*_links(spark, sf_dir))


@query
def local_influence_noisy(spark, sf_dir):
    """Reach within two hops where links are no forest: some are there twice, some lead back."""
    tweets = adapters.tweets(spark, sf_dir)
    links = materialise(structure.tweet_links(tweets, adapters.edges_noisy(spark, sf_dir)), "links")
    return structure.local_influence(tweets, links)


@query
def branching_by_level(spark, sf_dir):
    return structure.branching_by_level(structure.node_depth(*_links(spark, sf_dir)))


@query
def patterns_from_cascades(spark, sf_dir):
    """Propagation patterns learnt from the cascades."""
    tweets, links = _links(spark, sf_dir)
    branching = structure.branching_by_level(structure.node_depth(tweets, links))
    return structure.patterns_from(branching, cascades.graph_table(tweets))


@query
def declared_features(spark, sf_dir):
    tweets, links = _links(spark, sf_dir)
    return structure.declared_features(tweets, links, cascades.hot_cascades(tweets))


@query
def cascade_size(spark, sf_dir):
    """The cascade size next to every tweet."""
    ordered, _ = _ordered(spark, sf_dir)
    return ordered.select("tweet_id", "cascade_size")


@query
def dataset_profile(spark, sf_dir):
    return features.dataset_profile(adapters.tweets(spark, sf_dir), adapters.edges(spark, sf_dir))


@query
def tweet_text_clean(spark, sf_dir):
    """Document texts as tweets; some get a preamble or white space around them."""
    documents = adapters.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(
            F.when(F.col("doc_id") % 3 == 0, F.lit(" \tSure, here it is: ")).otherwise(F.lit("")), "text", F.lit(" \n")
        ).alias("text"),
    )
    return text.tweet_text_clean(documents).select("doc_id", "clean_text")


@query
def retweet_text(spark, sf_dir):
    return text.retweet_text(adapters.tweets(spark, sf_dir), adapters.edges(spark, sf_dir))


@query
def text_embedding(spark, sf_dir):
    """A unit vector per document."""
    documents = adapters.document_tweets(spark, sf_dir)
    return text.text_embedding(documents, text.fit_idf(documents), ["tweet_id"])


@query
def text_embedding_news(spark, sf_dir):
    """A unit vector per cascade, as if its texts were joined."""
    documents = adapters.document_tweets(spark, sf_dir)
    return text.text_embedding(documents, text.fit_idf(documents), ["news_id"], per_row=False)


# --- windows ----------------------------------------------------------------------------------


@query
def lookback_window(spark, sf_dir):
    """How many and which predecessors each tweet's frame holds."""
    pairs = edges.heuristic_edge_prob(*_ordered(spark, sf_dir))
    return pairs.groupBy("news_id", F.col("dst_idx").alias("node_idx")).agg(
        F.count(F.lit(1)).alias("seen"), F.min("src_idx").alias("first_seen"), F.max("src_idx").alias("last_seen")
    )


@query
def running_popular(spark, sf_dir):
    return edges.running_popular(*_ordered(spark, sf_dir)).select("news_id", "tweet_id", "pos", "popular_pos")


@query
def interarrival(spark, sf_dir):
    return edges.interarrival(*_ordered(spark, sf_dir))


@query
def rank_features(spark, sf_dir):
    scored = adapters.predictions(spark, sf_dir, features=True)
    return analysis.feature_importance(scored, adapters.SCORED_FEATURES).select("model", "rank", "feature")


# --- graph compute ----------------------------------------------------------------------------


@query
def gcn_norm(spark, sf_dir):
    return graph.gcn_norm(*_graph(spark, sf_dir))


@query
def gcn_propagate(spark, sf_dir):
    """Two rounds. Sums that end in an exact half of the last shown place are put back on it first."""
    state = graph.gcn_propagate(*_graph(spark, sf_dir), MATRIX, rounds=2)
    return state.withColumns({n: F.round(n, 12) for n in MATRIX})


@query
def gcn_propagate_bucketed(spark, sf_dir):
    """Two rounds over tables bucketed by story, without an exchange of states."""
    state = colocated.gcn_propagate(*_graph(spark, sf_dir), MATRIX, rounds=2)
    return state.withColumns({n: F.round(n, 12) for n in MATRIX})


@query
def sage_mean_bucketed(spark, sf_dir):
    return colocated.sage_mean(*_graph(spark, sf_dir), MATRIX)


@query
def sage_mean(spark, sf_dir):
    return graph.sage_mean(*_graph(spark, sf_dir), MATRIX)


# Attention vectors and layers for the registered queries: small numbers from a rule.
ATTENTION = ([0.01 * (i + 1) for i in range(8)], [0.02 * (4 - i) for i in range(8)])


def rule_layer(outputs: int, inputs: int, scale: float = 0.1) -> graph.Layer:
    j, i = np.mgrid[0:outputs, 0:inputs]
    weight = (((3 * j + 5 * i) % 11) - 5) * scale
    return graph.Layer(weight, ((np.arange(outputs) % 3) - 1) * scale)


@query
def gat_attention(spark, sf_dir):
    return graph.gat_attention(*_graph(spark, sf_dir), MATRIX, *ATTENTION)


@query
def mean_max_pool(spark, sf_dir):
    return graph.mean_max_pool(_nodes(spark, sf_dir), MATRIX)


@query
def max_pool(spark, sf_dir):
    return graph.max_pool(_nodes(spark, sf_dir), MATRIX)


@query
def news_concat(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    return graph.news_concat(graph.max_pool(nodes, MATRIX), nodes, MATRIX)


@query
def graph_mean_features(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    with_news = graph.graph_mean_features(nodes, MATRIX)
    without = graph.graph_mean_features(nodes, MATRIX, include_news=False)
    return with_news.join(without.toDF("news_id", *[f"tweets_{n}" for n in MATRIX]), "news_id")


@query
def linear_layer(spark, sf_dir):
    return graph.linear_layer(_nodes(spark, sf_dir), graph.NODE, MATRIX, rule_layer(4, 8), relu=True)


def pooled_network(inputs: int, hidden: int = 64) -> graph.Network:
    return graph.Network(
        "pooled",
        [rule_layer(hidden, hidden, 0.01), rule_layer(hidden, hidden, 0.01)],
        rule_layer(2, hidden, 0.01),
        embedding=rule_layer(hidden, inputs, 0.001),
        projection=rule_layer(hidden, 2 * hidden, 0.01),
    )


@query
def gnn_infer(spark, sf_dir):
    return graph.gnn_infer(*_graph(spark, sf_dir), MATRIX, pooled_network(8))


def small_network() -> graph.Network:
    return graph.Network(
        "pooled",
        [rule_layer(4, 4), rule_layer(4, 4)],
        rule_layer(2, 4),
        embedding=rule_layer(4, 8, 0.001),
        projection=rule_layer(4, 8),
    )


@query
def gnn_infer_small(spark, sf_dir):
    """The forward pass with four hidden columns, which SQL can follow."""
    return graph.gnn_infer(*_graph(spark, sf_dir), MATRIX, small_network())


@query
def gnn_infer_simple(spark, sf_dir):
    """Two convolutions, maximum pooling and a classifier, with three hidden columns."""
    net = graph.Network("simple", [rule_layer(3, 8, 0.001), rule_layer(3, 3)], rule_layer(2, 3))
    return graph.gnn_infer(*_graph(spark, sf_dir), MATRIX, net)


@query
def graph_embeddings_small(spark, sf_dir):
    graphs = cascades.graph_table(adapters.tweets(spark, sf_dir))
    found = graph.graph_embeddings(*_graph(spark, sf_dir), MATRIX, small_network(), graphs)
    return graph.spread_array(found, ["news_id", "label"], "embedding", 4, "h")


@query
def gnn_infer_news(spark, sf_dir):
    """One convolution next to the news node's features, and the simple network, side by side."""
    nodes, joined = _graph(spark, sf_dir)
    told = graph.Network(
        "news", [rule_layer(16, 8, 0.001)], rule_layer(2, 16), news=rule_layer(16, 8, 0.001), joined=rule_layer(16, 32),
        convolution="sage", neighbours=rule_layer(16, 8, 0.002),
    )
    simple = graph.Network("simple", [rule_layer(16, 8, 0.001), rule_layer(16, 16)], rule_layer(2, 16))
    first = graph.gnn_infer(nodes, joined, MATRIX, told).select("news_id", F.col("p_fake").alias("p_news"))
    return first.join(graph.gnn_infer(nodes, joined, MATRIX, simple).select("news_id", "p_fake", "pred"), "news_id")


def _text_nodes(spark, sf_dir, built: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes with structure features and text vectors in one sparse vector, and all edges."""
    nodes, joined = built or _graph(spark, sf_dir)
    return materialise(text.node_vectors(nodes, adapters.tweets(spark, sf_dir), MATRIX, sparse=True), "vectors"), joined


@query
def gnn_infer_text(spark, sf_dir):
    """The forward pass on structure features and text vectors, 392 numbers per node."""
    return vectors.vector_infer(*_text_nodes(spark, sf_dir), pooled_network(len(MATRIX) + text.DIMENSIONS))


@query
def user_states_text(spark, sf_dir):
    """User graphs of the documents: the vector of every node's texts, followed by its figures."""
    return build.user_states(adapters.document_tweets(spark, sf_dir))


@query
def gnn_infer_user_text(spark, sf_dir):
    """The forward pass over graphs of users on text vectors and figures, 393 numbers per node."""
    tweets = adapters.document_tweets(spark, sf_dir)
    states = materialise(build.user_states(tweets), "states")
    star = edges.user_star(cascades.user_index(tweets))
    return vectors.vector_infer(states, materialise(star, "edges"), pooled_network(9 + text.DIMENSIONS))


@query
def gnn_infer_arrays(spark, sf_dir):
    """The small forward pass with node states in arrays."""
    nodes, joined = _graph(spark, sf_dir)
    return vectors.vector_infer(nodes.select(*graph.NODE, F.array(*MATRIX).alias("state")), joined, small_network())


@query
def gcn_propagate_arrays(spark, sf_dir):
    """Two rounds on node states in arrays; no state travels between them."""
    nodes, joined = _graph(spark, sf_dir)
    state = vectors.vector_propagate(nodes.select(*graph.NODE, F.array(*MATRIX).alias("state")), joined, rounds=2)
    return graph.spread_array(state, graph.NODE, "state", len(MATRIX)).withColumns({n: F.round(n, 12) for n in MATRIX})


@query
def graph_embeddings(spark, sf_dir):
    graphs = cascades.graph_table(adapters.tweets(spark, sf_dir))
    return graph.graph_embeddings(*_graph(spark, sf_dir), MATRIX, pooled_network(8), graphs)


# --- learning ---------------------------------------------------------------------------------


@query
def stratified_split(spark, sf_dir):
    return learning.stratified_split(cascades.graph_table(adapters.tweets(spark, sf_dir)))


@query
def stratified_split_items(spark, sf_dir):
    """The split of all documents by toxicity: part sizes per label."""
    documents = adapters.document_tweets(spark, sf_dir).select(F.col("tweet_id").alias("news_id"), "label")
    return learning.split_sizes(learning.stratified_split(documents))


def _pooled(spark, sf_dir, built: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, list[str]]:
    nodes, joined = built or _graph(spark, sf_dir)
    pooled = graph.mean_max_pool(graph.gcn_propagate(nodes, joined, MATRIX, rounds=2), MATRIX)
    return pooled, [c for c in pooled.columns if c != "news_id"]


def _parts(spark, sf_dir, pooled: DataFrame) -> dict[str, DataFrame]:
    split = learning.stratified_split(cascades.graph_table(adapters.tweets(spark, sf_dir)))
    # The training loop reads its input many times.
    return learning.labelled_parts(materialise(pooled.join(split, "news_id"), "pooled"))


def _staged(spark, parts: dict[str, DataFrame], names: list[str], name: str, width: int | None = None) -> DataFrame:
    """Test metrics of a perceptron fitted in stages, and how the fit went."""
    staged = learning.fit_staged(parts["train"], parts["val"], names, width)
    found = metrics.metric_records(learning.predict_graphs(staged.model, parts["test"], name), "fit")
    return found.unionByName(learning.staged_records(staged, name, "fit", spark))


@query
def fit_structure(spark, sf_dir):
    """A perceptron on propagated and pooled structure features, chosen by its validation F1."""
    pooled, names = _pooled(spark, sf_dir)
    return _staged(spark, _parts(spark, sf_dir, pooled), names, A)


def _text_pooled(spark, sf_dir, built: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Graphs by node states of structure and text, propagated twice: mean and maximum as one vector."""
    pooled = vectors.vector_pool(vectors.vector_propagate(*_text_nodes(spark, sf_dir, built), rounds=2))
    return pooled.select("news_id", array_to_vector("state").alias("pooled"))


TEXT_WIDTH = 2 * (len(MATRIX) + text.DIMENSIONS)


@query
def fit_structure_text(spark, sf_dir):
    """The same with a text vector on every node next to its structure features."""
    return _staged(spark, _parts(spark, sf_dir, _text_pooled(spark, sf_dir)), ["pooled"], B, TEXT_WIDTH)


def _both_parts(spark, sf_dir) -> tuple[dict[str, DataFrame], list[str]]:
    """One train, val and test part with the inputs of both models, and the names of those of the first."""
    built = _graph(spark, sf_dir)
    pooled, names = _pooled(spark, sf_dir, built)
    return _parts(spark, sf_dir, pooled.join(_text_pooled(spark, sf_dir, built), "news_id")), names


def _test_predictions(parts: dict[str, DataFrame], models: dict[str, PipelineModel]) -> DataFrame:
    scored = union_all([learning.predict_graphs(model, parts["test"], name) for name, model in models.items()])
    return materialise(scored, "predictions")


def _fitted_predictions(spark, sf_dir) -> DataFrame:
    """Both models fitted on one train part and scored on one test part."""
    parts, names = _both_parts(spark, sf_dir)
    return _test_predictions(parts, {
        A: learning.fit_structure(parts["train"], names, learning.logistic()),
        B: learning.fit_structure_text(parts["train"], [], "pooled", learning.logistic()),
    })


def _staged_predictions(spark, sf_dir) -> DataFrame:
    """Both models fitted in stages and chosen by validation F1, as in ``fit_structure``, and scored on one test part."""
    parts, names = _both_parts(spark, sf_dir)
    return _test_predictions(parts, {
        A: learning.fit_staged(parts["train"], parts["val"], names).model,
        B: learning.fit_staged(parts["train"], parts["val"], ["pooled"], TEXT_WIDTH).model,
    })


@query
def fitted_agreement(spark, sf_dir):
    """How often the two fitted models agree on the test part, and which of them is right where they don't."""
    found = _fitted_predictions(spark, sf_dir)
    agreed = analysis.model_agreement(found, A, B).withColumn("model", F.lit(A))
    sides = analysis.disagreement_direction(found, A, B).agg(F.coalesce(F.sum("a_right"), F.lit(0).cast("long")).alias("a_right"))
    return agreed.join(sides.withColumn("model", F.lit(A)), "model").drop("model")


@query
def fitted_comparison(spark, sf_dir):
    """Precision, recall and F1 of the two models chosen by validation F1, and their sure cases and bands, side by side."""
    found = _staged_predictions(spark, sf_dir)
    return analysis.model_comparison(found, A, B).unionByName(analysis.confidence_comparison(found, A, B))


@query
def select_by_val_f1(spark, sf_dir):
    return learning.select_by_val_f1(adapters.candidates(spark, sf_dir))


@query
def save_load_model(spark, sf_dir):
    """The best of three candidates, stored, loaded and used on the test part."""
    pooled, names = _pooled(spark, sf_dir)
    parts = _parts(spark, sf_dir, pooled)
    found = learning.fit_candidates(parts["train"], parts["val"], names, [learning.logistic(n) for n in (1, 5, 20)])
    best = learning.best_candidate(parts["train"], found)
    path = scratch_path(spark, "model")
    learning.save_model(best.model, path)
    return learning.predict_graphs(learning.load_model(path), parts["test"], A).select("news_id", "label", "p_fake", "pred")


@query
def predict_graphs(spark, sf_dir):
    """Every graph scored by a logistic model fitted on the train part."""
    pooled, names = _pooled(spark, sf_dir)
    parts = _parts(spark, sf_dir, pooled)
    model = learning.fit_structure(parts["train"], names, learning.logistic())
    return learning.predict_graphs(model, union_all(list(parts.values())), A)


@query
def graph_feature_importance(spark, sf_dir):
    """Which mean node features of the graphs go with a fitted model's predictions."""
    nodes, joined = _graph(spark, sf_dir)
    pooled = graph.mean_max_pool(graph.gcn_propagate(nodes, joined, MATRIX, rounds=2), MATRIX)
    names = [c for c in pooled.columns if c != "news_id"]
    parts = _parts(spark, sf_dir, pooled)
    model = learning.fit_structure(parts["train"], names, learning.logistic())
    scored = learning.predict_graphs(model, parts["test"], A).join(graph.graph_mean_features(nodes, MATRIX), "news_id")
    return analysis.feature_importance(scored, MATRIX)


# --- metrics and analysis ---------------------------------------------------------------------


def _on_predictions(name: str, run: Callable[[DataFrame], DataFrame], with_features: bool = False) -> None:
    query(lambda spark, sf_dir: run(adapters.predictions(spark, sf_dir, with_features)), name)


_FEATURES = adapters.SCORED_FEATURES
_on_predictions("accuracy", metrics.accuracy)
_on_predictions("f1_binary", metrics.f1_binary)
_on_predictions("auc", metrics.auc)
_on_predictions("confusion_matrix", metrics.confusion_matrix)
_on_predictions("classification_report", metrics.classification_report)
_on_predictions("log_loss", metrics.log_loss)
_on_predictions("model_agreement", lambda p: analysis.model_agreement(p, A, B))
_on_predictions("disagreement_cases", lambda p: analysis.disagreement_cases(p, A, B))
_on_predictions("disagreement_direction", lambda p: analysis.disagreement_direction(p, A, B))
_on_predictions("high_confidence", analysis.high_confidence)
_on_predictions("confidence_bands", analysis.confidence_bands)
_on_predictions("confidence_histogram", analysis.confidence_histogram)
_on_predictions("model_comparison", lambda p: analysis.model_comparison(p, A, B))
_on_predictions("feature_ratio", lambda p: analysis.feature_ratio(p, _FEATURES), True)
_on_predictions(
    "relative_proportion", lambda p: analysis.relative_proportion(analysis.feature_ratio(p, _FEATURES)), True
)
_on_predictions("ratio_direction", lambda p: analysis.ratio_direction(analysis.feature_ratio(p, _FEATURES)), True)
_on_predictions("feature_importance", lambda p: analysis.feature_importance(p, _FEATURES), True)
_on_predictions("error_vs_correct", lambda p: analysis.error_vs_correct(p, _FEATURES), True)


@query
def relative_gain(spark, sf_dir):
    return metrics.relative_gain(_metric_parts(spark, sf_dir), A, B)


# --- checks -----------------------------------------------------------------------------------


@query
def dangling_edges(spark, sf_dir):
    return checks.dangling_edges(adapters.tweets(spark, sf_dir), adapters.edges_noisy(spark, sf_dir))


@query
def duplicate_tweets(spark, sf_dir):
    """Repeated (order, line) pairs of the line items."""
    items = adapters.table(spark, sf_dir, "lineitem").select(
        F.concat_ws("_", "l_orderkey", "l_linenumber").alias("tweet_id")
    )
    return checks.duplicate_tweets(items)


@query
def time_violations(spark, sf_dir):
    return checks.time_violations(adapters.tweets(spark, sf_dir), adapters.edges_noisy(spark, sf_dir))


@query
def label_conflicts(spark, sf_dir):
    return checks.label_conflicts(adapters.document_tweets(spark, sf_dir))
