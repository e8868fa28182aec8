"""Cascades, edges and features against numbers worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from ripplegraph.operators import cascades, checks, edges, features, structure, text
from ripplegraph.plans.skew import HotKeys
from ripplegraph.schema import align_schema

COLD = HotKeys(("news_id",), 1_000)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def tweets_of(spark, specs):
    """Tweets from (tweet_id, user_id, news_id, label, second)."""
    return spark.createDataFrame(specs, "tweet_id string, user_id string, news_id string, label int, s long").select(
        "tweet_id", "user_id", "news_id", "label", F.timestamp_seconds("s").alias("timestamp"),
        F.lit(1).cast("long").alias("likes"), F.lit(1).cast("long").alias("retweets"), F.lit("").alias("text"),
    )


def test_news_features(one_cascade):
    row = features.news_features(one_cascade).first()
    assert tuple(row)[1:] == (5, 4, 19.0, 16.0, 3.8, 3.2, 24.0, 0.2)


def test_tweet_features_defaults(one_cascade):
    found = rows(features.tweet_features(one_cascade).drop("news_id"), "tweet_id")
    assert found == [
        ("c1_t0", 10, 4, 1, 1000, 1, 0.9, 0.1, 1),
        ("c1_t1", 0, 2, 0, 50, 0, 0.5, 0.8, 0),
        ("c1_t2", 3, 0, 0, 1000, 1, 0.9, 0.1, 0),
        ("c1_t3", 5, 9, 0, 200, 0, 0.4, 0.2, 0),
        ("c1_t4", 1, 1, 0, 7, 0, 0.3, 0.1, 0),
    ]


def test_tweet_features_nan(one_cascade):
    found = {r.tweet_id: r for r in features.tweet_features(one_cascade, missing="nan").collect()}
    assert math.isnan(found["c1_t0"].bot_score) and math.isnan(found["c1_t1"].likes)
    assert found["c1_t0"].followers == 1000 and found["c1_t1"].credibility == 0.5
    with pytest.raises(ValueError):
        features.tweet_features(one_cascade, missing="zero")


def test_tweet_features_without_optional_columns(one_cascade):
    bare = one_cascade.drop("user_followers", "user_verified", "user_credibility", "user_bot_score", "is_root")
    row = features.tweet_features(bare, missing="nan").where("tweet_id = 'c1_t3'").first()
    assert (row.followers, row.verified, row.credibility, row.bot_score, row.is_root) == (1000, 0, 0.5, 0.1, 0)


def test_user_features(one_cascade):
    named = one_cascade.withColumnsRenamed({"user_followers": "followers", "user_verified": "verified"})
    found = {r.user_id: r for r in features.user_features(named).collect()}
    assert tuple(found["u1"])[2:] == (2, 6.5, 2.0, 1.0, 0.0, 0.0, 1.0, 0.5)
    assert found["u2"].mean_likes == 0.0
    assert {r.any_root for r in features.user_features(named.drop("is_root")).collect()} == {0.0}


def test_user_features_text(one_cascade):
    found = {r.user_id: r for r in features.user_features_text(one_cascade).collect()}
    assert found["u2"].mean_likes is None
    assert found["u3"].following == pytest.approx(20.0)
    assert found["u1"].style == pytest.approx(9 / 7)
    assert found["u2"].style == pytest.approx(2 / 7)


def test_text_features(one_cascade):
    row = text.text_diversity(one_cascade).first()
    assert (row.unique_words, row.total_words) == (15, 16)
    assert row.diversity == pytest.approx(15 / 17)
    scores = {r.tweet_id: r.e for r in one_cascade.select("tweet_id", text.excitement().alias("e")).collect()}
    assert scores["c1_t0"] == pytest.approx(3.272727, abs=1e-6)
    assert scores["c1_t4"] == pytest.approx(2.555556, abs=1e-6)
    assert text.sentiment_variance(one_cascade).first().variance == pytest.approx(1.605820, abs=1e-6)
    style = {r.user_id: tuple(r)[2:9] for r in text.writing_style(one_cascade).collect()}
    assert style["u1"] == (3, 0, 0, 3, 1, 1, 1) and style["u2"] == (0, 1, 1, 0, 0, 0, 0)


def test_text_features_of_unknown_text(spark):
    df = spark.createDataFrame([("n", "u", None), ("n", "u", "  "), ("m", "u", "Éa éA ÉA")], "news_id string, user_id string, text string")
    found = {r.news_id: r for r in text.text_diversity(df).collect()}
    assert (found["n"].unique_words, found["n"].total_words, found["n"].diversity) == (0, 0, 0.0)
    assert (found["m"].unique_words, found["m"].total_words) == (1, 3)
    assert text.sentiment_variance(df.where("news_id = 'n'")).first().variance == 0.0


def test_tweet_text_clean(spark):
    texts = [" \n Sure: the news\nhere ", "x" * 60 + ": late colon", "a" * 400, "no colon", "a:b:c"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = [r.clean_text for r in text.tweet_text_clean(df).orderBy("id").collect()]
    assert found == ["the news here", "x" * 60 + ": late colon", "a" * 280, "no colon", "b:c"]


def test_heuristic_probabilities(one_cascade):
    ordered = cascades.propagation_order(one_cascade, hot=COLD)
    found = {(r.src_idx - 1, r.dst_idx - 1): r.p for r in edges.heuristic_edge_prob(ordered, COLD).collect()}
    expected = {
        (0, 1): 0.595540, (0, 2): 0.547923, (1, 2): 0.515758, (0, 3): 0.483541, (1, 3): 0.455154,
        (2, 3): 0.397124, (0, 4): 0.228408, (1, 4): 0.215000, (2, 4): 0.187588, (3, 4): 0.336893,
    }
    assert found.keys() == expected.keys()
    assert all(found[k] == pytest.approx(p, abs=1e-6) for k, p in expected.items())


def test_running_popular(one_cascade):
    ordered = cascades.propagation_order(one_cascade, hot=COLD)
    found = rows(edges.running_popular(ordered, COLD).select("pos", "popular_pos"), "pos")
    assert found == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 0)]


def test_draws_match_their_probabilities(spark):
    candidates = spark.range(20_000).selectExpr("concat('n', id % 7) as news_id", "id as src_idx", "id + 1 as dst_idx")
    share = edges.draw_edges(candidates, "star", F.lit(0.6)).count() / 20_000
    assert abs(share - 0.6) < 4 * math.sqrt(0.6 * 0.4 / 20_000)
    again = edges.draw_edges(candidates.repartition(13), "star", F.lit(0.6)).count() / 20_000
    assert again == share
    assert edges.draw_edges(candidates, "star", F.lit(0.6), seed="7").count() / 20_000 != share


def test_small_cascades_are_dropped(spark):
    tweets = tweets_of(spark, [("a_t0", "u1", "a", 0, 0), ("b_t0", "u1", "b", 1, 0), ("b_t1", "u2", "b", 1, 0)])
    graphs = cascades.graph_table(tweets)
    assert [r.news_id for r in graphs.collect()] == ["b"]
    assert cascades.graphs_of(cascades.propagation_order(tweets)).collect() == graphs.collect()
    assert {r.news_id for r in cascades.propagation_order(tweets).collect()} == {"b"}
    assert cascades.min_users_filter(tweets).count() == 0 and cascades.user_index(tweets).count() == 0
    # Equal times: no duration, and a speed equal to the count.
    row = features.news_features(tweets).first()
    assert (row.span_hours, row.velocity) == (0.0, 2.0)


def test_user_index_is_in_first_seen_order(spark):
    tweets = tweets_of(spark, [(f"a_t{i}", u, "a", 0, i) for i, u in enumerate(["z", "y", "z", "x", "y"])])
    assert rows(cascades.user_index(tweets).select("user_id", "user_idx"), "user_idx") == [("z", 1), ("y", 2), ("x", 3)]


def test_label_is_that_of_the_first_tweet(spark):
    tweets = tweets_of(spark, [("a_t0", "u", "a", 0, 9), ("a_t1", "u", "a", 1, 1)])
    row = cascades.cascade_label(tweets).first()
    assert (row.label, row.is_fake) == (1, True)
    assert rows(checks.label_conflicts(tweets), "news_id") == [("a", 2, 2)]


def test_cascade_edges_need_both_ends(spark):
    tweets = tweets_of(
        spark,
        [(f"news_{n}_t{i}", "u", f"news_{n}", 0, i) for n in (1, 10) for i in range(3)],
    )
    links = spark.createDataFrame(
        [
            ("news_1_t0", "news_1_t1"),
            ("news_1_t0", "news_1_t1"),
            ("news_10_t0", "news_10_t2"),
            ("news_1_t0", "news_10_t1"),
            ("news_1_t0", "gone"),
        ],
        "source string, target string",
    )
    ordered = cascades.propagation_order(tweets, hot=COLD)
    found = rows(edges.cascade_edges(ordered, links).drop("kind"), "news_id", "src_idx")
    assert found == [("news_1", 1, 2), ("news_1", 1, 2), ("news_10", 1, 3)]
    named = links.withColumn("news_id", F.lit("news_10"))
    assert rows(edges.cascade_edges(ordered, named).drop("kind"), "src_idx") == [("news_10", 1, 3)]
    assert edges.cascade_edges(ordered, links.limit(0)).count() == 0
    assert {r.reason for r in checks.dangling_edges(tweets, links).collect()} == {"two cascades", "target unknown"}


def test_user_interaction_is_symmetric(spark):
    tweets = tweets_of(spark, [(f"a_t{i}", u, "a", 0, i) for i, u in enumerate(["x", "y", "z", "x"])])
    links = spark.createDataFrame([("a_t0", "a_t1"), ("a_t1", "a_t2"), ("a_t0", "a_t3")], "source string, target string")
    users = cascades.user_index(tweets)
    found = rows(edges.user_interaction(tweets, users, links).drop("kind", "news_id"), "src_idx", "dst_idx")
    assert found == [(1, 2), (2, 1), (2, 3), (3, 2)]  # the self-loop x-x is gone
    star = rows(edges.user_star(users).drop("kind", "news_id"), "src_idx", "dst_idx")
    assert star == [(0, 1), (0, 2), (0, 3), (1, 0), (2, 0), (3, 0)]


def pattern_table(spark, specs):
    return spark.createDataFrame(
        specs, "pattern_id string, is_fake boolean, num_nodes long, level_0 long, level_1 long, level_2 long"
    )


def test_pattern_edges_by_hand(spark):
    tweets = tweets_of(spark, [(f"a_t{i}", f"u{i}", "a", 1, i) for i in range(9)])
    ordered = cascades.propagation_order(tweets, hot=COLD)
    graphs = cascades.graph_table(tweets)
    patterns = pattern_table(spark, [("p", True, 12, 1, 7, 2)])
    matched = edges.pattern_match(graphs.select("news_id", "is_fake", "cascade_size"), patterns)
    patterned = edges.with_pattern(ordered, matched, COLD)
    one = rows(edges.pattern_level1(patterned).select("src_idx", "dst_idx"), "src_idx")
    assert one == [(1, 2), (2, 3), (3, 4), (4, 5)]  # min(7, 9 // 2)
    two = rows(edges.pattern_level2(patterned).select("src_idx", "dst_idx"), "src_idx")
    assert two == [(1, 5), (2, 6)]  # i -> 4 + i


def test_pattern_match_prefers_similar_sizes(spark):
    patterns = pattern_table(spark, [(f"p{n}", True, n, 1, 1, 1) for n in (5, 10, 13, 40)] + [("r", False, 3, 1, 1, 1)])
    cascades_ = spark.createDataFrame(
        [(f"n{i}", True, 10) for i in range(60)] + [(f"big{i}", True, 1000) for i in range(60)] + [("real", False, 500)],
        "news_id string, is_fake boolean, cascade_size long",
    )
    found = edges.pattern_match(cascades_, patterns)
    picked = {}
    for row in found.collect():
        picked.setdefault(row.news_id[:3], set()).add(row.pattern_id)
    assert picked["n10"] <= {"p5", "p10", "p13"}
    assert {p for k, v in picked.items() if k[0] == "n" for p in v} == {"p5", "p10", "p13"}
    assert picked["big"] == {"p5", "p10", "p13", "p40"}  # none is similar: any of the class
    assert picked["rea"] == {"r"}


def test_realistic_edges_fall_back(spark):
    specs = [(f"{n}_t{i}", f"u{i}", n, label, i) for n, label in (("f", 1), ("r", 0)) for i in range(6)]
    tweets = tweets_of(spark, specs)
    ordered, graphs = cascades.propagation_order(tweets, hot=COLD), cascades.graph_table(tweets)

    def kinds(patterns):
        found = edges.realistic_edges(ordered, graphs, patterns, COLD)
        return {(r.news_id, r.kind) for r in found.select("news_id", "kind").distinct().collect()}

    assert {k for _, k in kinds(None)} == {"heuristic"}
    assert {k for _, k in kinds(pattern_table(spark, [("r", False, 6, 1, 2, 1)]))} == {"heuristic"}
    only_fake = kinds(pattern_table(spark, [("p", True, 6, 1, 2, 1)]))
    assert ("r", "heuristic") in only_fake and ("f", "heuristic") not in only_fake
    assert ("f", "level1") in only_fake


def test_all_edges_is_the_sum_of_its_parts(spark):
    specs = [(f"n{n}_t{i}", f"u{i % 3}", f"n{n}", n % 2, i) for n in range(4) for i in range(7)]
    tweets = tweets_of(spark, specs)
    links = spark.createDataFrame([(f"n{n}_t0", f"n{n}_t{i}") for n in range(4) for i in (1, 2)], "source string, target string")
    ordered, graphs = cascades.propagation_order(tweets, hot=COLD), cascades.graph_table(tweets)
    whole = edges.all_edges(ordered, links, graphs, COLD)
    counts = {r.kind: r["count"] for r in whole.groupBy("kind").count().collect()}
    assert counts["news"] == len(specs) and counts["cascade"] == 8
    drawn = edges.heuristic_edges(ordered, COLD)
    assert counts["heuristic"] == drawn.count()
    assert drawn.where("src_idx >= dst_idx").count() == 0


def test_structure_of_a_forest(spark):
    tweets = tweets_of(spark, [(f"a_t{i}", "u", "a", 0, i) for i in range(6)]).withColumn(
        "text", F.when(F.col("tweet_id") == "a_t1", "RT @u: x").otherwise("reply")
    )
    links = spark.createDataFrame(
        [("a_t0", "a_t1"), ("a_t0", "a_t2"), ("a_t1", "a_t3"), ("a_t4", "a_t0"), ("a_t3", "gone")],
        "source string, target string",
    )
    inner = structure.tweet_links(tweets, links)
    assert inner.count() == 4
    depths = structure.node_depth(tweets, inner)
    assert rows(depths.select("tweet_id", "depth"), "tweet_id") == [
        ("a_t0", 1), ("a_t1", 2), ("a_t2", 2), ("a_t3", 3), ("a_t4", 0), ("a_t5", 0),
    ]
    assert structure.cascade_depth(depths).first().max_depth == 3
    assert rows(structure.branching_by_level(depths).drop("news_id"), "depth") == [(0, 2), (1, 1), (2, 2), (3, 1)]
    assert rows(structure.local_influence(tweets, inner).drop("news_id"), "tweet_id") == [
        ("a_t0", 3), ("a_t1", 1), ("a_t2", 0), ("a_t3", 0), ("a_t4", 3), ("a_t5", 0),
    ]
    children = {r.tweet_id: tuple(r)[2:] for r in structure.reply_retweet_count(tweets, inner).collect()}
    assert children["a_t0"] == (2, 1, 1) and children["a_t5"] == (0, 0, 0)
    degrees = {r.tweet_id: tuple(r)[2:] for r in structure.node_degree(tweets, inner).collect()}
    assert degrees["a_t0"] == (1, 2, 3) and degrees["a_t5"] == (0, 0, 0)
    assert rows(checks.time_violations(tweets, links), "source") == [("a_t4", "a_t0", 4.0)]


def test_depth_ends_on_cycles(spark):
    tweets = tweets_of(spark, [(f"a_t{i}", "u", "a", 0, i) for i in range(4)])
    links = spark.createDataFrame(
        [("a", "a_t0", "a_t1"), ("a", "a_t1", "a_t0"), ("a", "a_t2", "a_t3")], "news_id string, source string, target string"
    )
    found = rows(structure.node_depth(tweets, links).select("tweet_id", "depth"), "tweet_id")
    assert found == [("a_t0", None), ("a_t1", None), ("a_t2", 0), ("a_t3", 1)]


def test_text_lookup_defaults(spark, one_cascade):
    ordered = cascades.propagation_order(one_cascade, hot=COLD)
    nodes = cascades.node_table(ordered, cascades.graph_table(one_cascade))
    known = one_cascade.where("tweet_id <> 'c1_t1'").withColumn("text", F.when(F.col("tweet_id") != "c1_t2", F.col("text")))
    found = {r.node_idx: r.text for r in text.text_lookup(nodes, known).collect()}
    assert found[0] == "News article 0" and found[2] == "Tweet c1_t1" and found[3] == "" and found[4] == "calm words calm"


def test_align_schema(spark):
    bare = spark.createDataFrame([("t", 10.0)], "tweet_id string, user_followers double")
    row = align_schema(bare, "cascade").first()
    assert (row.user_followers, row.user_credibility, row.user_bot_score, row.user_verified, row.user_type) == (
        10.0, 0.5, 0.1, False, "regular",
    )
    row = align_schema(bare, "user").first()
    assert (row.followers, row.following, row.verified, row.credibility) == (0.0, 0.0, False, 0.5)
    assert align_schema(bare, "user_text").first().user_following == pytest.approx(1.0)


def test_sampling_and_tiers(spark):
    users = spark.range(40).selectExpr("concat('g', id % 2) as team", "concat('u', id) as user_id", "id / 40 as credibility", "id")
    picked = cascades.credibility_sample(users, "team", 3)
    assert picked.groupBy("team").count().where("count = 3").count() == 2
    assert picked.where("credibility >= 0.4").count() == 0
    assert cascades.credibility_sample(users, "team", 3, below=None).count() == 6
    tiers = cascades.user_tier(users, ["id"])
    assert {r.user_type: r["count"] for r in tiers.groupBy("user_type").count().collect()} == {
        "verified": 2, "bot": 4, "regular": 34,
    }
    assert tiers.groupBy("user_type").agg(F.min("tier_no").alias("n")).where("n = 0").count() == 3


def test_dataset_profile(spark, one_cascade):
    links = spark.createDataFrame([("c1_t0", "c1_t1")], "source string, target string")
    total = features.dataset_profile(one_cascade, links).where("label is null").first()
    assert (total.articles, total.tweets, total.mean_size, total.edges, total.share) == (1, 5, 5.0, 1, 1.0)


def test_text_vectors(spark, one_cascade):
    model = text.fit_idf(one_cascade, 16)
    units = text.text_embedding(one_cascade, model, ["tweet_id"], dimensions=16)
    norms = [sum(v * v for v in r.embedding) for r in units.collect()]
    assert len(norms) == 5 and all(n == pytest.approx(1.0, abs=1e-5) or n == 0 for n in norms)
    # A group's vector equals that of its joined text.
    joined = one_cascade.groupBy("news_id").agg(F.concat_ws(" ", F.collect_list("text")).alias("text"))
    a = text.text_embedding(one_cascade, model, ["news_id"], per_row=False, dimensions=16).first().embedding
    b = text.text_embedding(joined, model, ["news_id"], dimensions=16).first().embedding
    assert a == pytest.approx(b)
    own = text.encode_texts(one_cascade, ["tweet_id"], lambda ts: [[len(t), 1.0] for t in ts], "tweet_id string")
    both = text.feature_concat(features.tweet_features(one_cascade), own, ["tweet_id"], features.TWEET_FEATURES)
    row = both.where("tweet_id = 'c1_t4'").first()
    assert row.features == pytest.approx([1, 1, 0, 7, 0, 0.3, 0.1, 0, 8, 1])


def test_local_influence_counts_each_descendant_once(spark):
    from ripplegraph.operators.structure import local_influence

    tweets = spark.createDataFrame([("n", t) for t in "ABCDEF"], "news_id string, tweet_id string")
    links = [("n", "A", "B"), ("n", "A", "C"), ("n", "B", "D"), ("n", "C", "D"), ("n", "E", "F"), ("n", "F", "E")]
    found = local_influence(tweets, spark.createDataFrame(links, "news_id string, source string, target string"))
    assert {r["tweet_id"]: r["local_influence"] for r in found.collect()} == {"A": 3, "B": 1, "C": 1, "D": 0, "E": 1, "F": 1}
