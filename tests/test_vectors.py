"""Node states in arrays against dense matrices, for stories in one group and cut into cells."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from test_graph import EDGES, X, dense, random_graphs, tables

from ripplegraph.operators import graph, learning, text, vectors
from ripplegraph.operators.graph import Layer, Network

CELLS = [None, 3]


def arrayed(spark, graphs):
    nodes, links = tables(spark, graphs)
    names = [c for c in nodes.columns if c.startswith("x")]
    return nodes.select("news_id", "node_idx", F.array(*names).alias("state")), links


def states(df):
    return {(r.news_id, r.node_idx): r.state for r in df.collect()}


def wide_network(inputs, hidden=6, seed=0):
    rng = np.random.default_rng(seed)
    made = lambda o, i: Layer(rng.normal(size=(o, i)) * 0.3, rng.normal(size=o))
    return Network("pooled", [made(hidden, hidden), made(hidden, hidden)], made(2, hidden), embedding=made(hidden, inputs), projection=made(hidden, 2 * hidden))


def dense_pass(x, links, net):
    a, relu = dense(x, [e for e in links if e[0] != e[1]]), lambda v: np.maximum(v, 0)
    linear = lambda v, layer: v @ layer.weight.T + layer.offsets()
    h = relu(linear(x, net.embedding))
    for layer in net.convolutions:
        h = relu(linear(a @ h, layer))
    z = linear(linear(np.append(h.mean(axis=0), h.max(axis=0)), net.projection), net.classifier)
    return h, z - np.logaddexp(*z)


@pytest.fixture(params=CELLS)
def cell(request, monkeypatch):
    if request.param:
        monkeypatch.setattr(vectors, "CELL", request.param)
        monkeypatch.setattr(vectors, "GATHERED", 8)
    return request.param


def test_propagation(spark, cell):
    graphs = [(X, EDGES), *random_graphs(2, 4), (np.ones((1, 4)), [])]
    graphs = [(x[:, :2], e) for x, e in graphs]
    found = states(vectors.vector_propagate(*arrayed(spark, graphs), rounds=3))
    for g, (x, links) in enumerate(graphs):
        a = dense(x, links)
        for i, row in enumerate(a @ a @ a @ x):
            assert found[(f"g{g}", i)] == pytest.approx(row.tolist())
    assert len(found) == sum(len(x) for x, _ in graphs)


def test_large_star_with_loops_and_repeated_edges(spark, cell):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 3))
    links = [(0, i) for i in range(1, 40)] + [(i, i) for i in range(5)] + [(i, 0) for i in range(0, 40, 3)] + [(7, 8)] * 4
    found = states(vectors.vector_propagate(*arrayed(spark, [(x, links)]), rounds=2))
    a = dense(x, [e for e in links if e[0] != e[1]])
    for i, row in enumerate(a @ a @ x):
        assert found[("g0", i)] == pytest.approx(row.tolist())


def test_forward_pass_of_392_inputs(spark, cell):
    graphs = random_graphs(9, 5, 392)
    net = wide_network(392)
    nodes, links = arrayed(spark, graphs)
    last = states(vectors.vector_states(nodes, links, net))
    found = {r.news_id: r for r in vectors.vector_infer(nodes, links, net).collect()}
    for g, (x, e) in enumerate(graphs):
        h, z = dense_pass(x, e, net)
        for i, row in enumerate(h):
            assert last[(f"g{g}", i)] == pytest.approx(row.tolist())
        r = found[f"g{g}"]
        assert [r.log_p_real, r.log_p_fake] == pytest.approx(z.tolist())
        assert r.pred == int(z[1] > z[0]) and r.p_fake == pytest.approx(np.exp(z[1]))


def test_no_state_travels_between_rounds(spark):
    """However many rounds, a node's state is exchanged once."""
    nodes, links = arrayed(spark, random_graphs(4))
    plans = [vectors.vector_propagate(nodes, links, n)._jdf.queryExecution().executedPlan().toString() for n in (1, 4)]
    assert plans[0].count("Exchange") == plans[1].count("Exchange")


def test_story_beyond_a_block_is_one_group(spark, monkeypatch):
    """More nodes than a block has don't send a story to the cells; its zeros stay behind and its columns go in slices."""
    monkeypatch.setattr(vectors, "CELL", 8)
    monkeypatch.setattr(vectors, "SLICED", 40)
    monkeypatch.setattr(vectors, "_in_cells", None)
    rng = np.random.default_rng(5)
    links = [(0, i) for i in range(1, 20)] + [(int(a), int(b)) for a, b in rng.integers(0, 20, (10, 2))]
    sparse = rng.normal(size=(20, 6)) * (rng.random((20, 6)) < 0.2)
    sparse[3, 2] = np.nan
    for x in (sparse, rng.normal(size=(20, 6))):
        found = states(vectors.vector_propagate(*arrayed(spark, [(x, links)]), rounds=2))
        a = dense(np.zeros_like(x), [e for e in links if e[0] != e[1]])
        for i, row in enumerate(a @ a @ np.nan_to_num(x)):
            known = ~np.isnan(found[("g0", i)])
            assert np.array(found[("g0", i)])[known] == pytest.approx(row[known])
        assert np.isnan(found[("g0", 3)][2]) == np.isnan(x[3, 2])


def test_links_decide_too(spark, monkeypatch):
    """A story of few nodes with very many links isn't one group."""
    monkeypatch.setattr(vectors, "CELL", 4)
    x = np.ones((3, 2))
    nodes, links = arrayed(spark, [(x, [(0, 1)] * 9), (x, [(0, 1)])])
    assert [r.news_id for r in vectors._large(nodes, links, 2).collect()] == ["g0"]


def test_pooling(spark):
    graphs = random_graphs(6, 4)
    found = {r.news_id: r.state for r in vectors.vector_pool(arrayed(spark, graphs)[0]).collect()}
    for g, (x, _) in enumerate(graphs):
        assert found[f"g{g}"] == pytest.approx([*x.mean(axis=0), *x.max(axis=0)])


def test_layer_keeps_nulls_as_nan(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [None, 2.0])], "news_id string, state array<double>")
    found = {r.news_id: r.state for r in vectors.vector_layer(df, ["news_id"], Layer(np.array([[1.0, 1], [0, -1]])), relu=True).collect()}
    assert found["a"] == [3.0, 0.0] and np.isnan(found["b"][0])


def test_other_networks_are_refused(spark):
    nodes, links = arrayed(spark, [(X, EDGES)])
    with pytest.raises(ValueError):
        vectors.vector_infer(nodes, links, Network("simple", [Layer(np.ones((2, 2)))], Layer(np.ones((2, 2)))))
    with pytest.raises(ValueError):
        vectors.vector_states(nodes, links, Network("pooled", [Layer(np.ones((2, 2)))], Layer(np.ones((2, 2))), convolution="sage"))


def text_nodes(spark):
    rows = [("c1", 0, 0, None), ("c1", 1, 1, "t1"), ("c1", 2, 1, "t2"), ("c2", 0, 0, None), ("c2", 1, 1, "t3")]
    nodes = spark.createDataFrame(rows, "news_id string, node_idx long, node_type int, tweet_id string").withColumn("x0", F.col("node_idx") + 0.5)
    tweets = spark.createDataFrame([("t1", "some words"), ("t2", None)], "tweet_id string, text string")
    return nodes, tweets


def test_node_vectors(spark):
    """Structure first, then the unit vector of the text; an unknown tweet goes by its id, the news by its number."""
    nodes, tweets = text_nodes(spark)
    found = states(text.node_vectors(nodes, tweets, ["x0"], dimensions=64))
    assert {len(v) for v in found.values()} == {65} and found[("c1", 2)][0] == 2.5
    size = {k: np.linalg.norm(v[1:]) for k, v in found.items()}
    assert size[("c1", 2)] == 0 and all(size[k] == pytest.approx(1) for k in size if k != ("c1", 2))
    # the same by hand: term counts times log((texts + 1) / (texts with the term + 1))
    words = {("c1", 0): "news article 0", ("c1", 1): "some words", ("c1", 2): "", ("c2", 0): "news article 1", ("c2", 1): "tweet t3"}
    terms = sorted({w for t in words.values() for w in t.split()})
    place = {w: int(text._term_counts(spark.createDataFrame([(w,)], "text string"), 64).first()["_tf"].indices[0]) for w in terms}
    counts = {k: np.bincount([place[w] for w in t.split()], minlength=64).astype(float) for k, t in words.items()}
    idf = np.log(6 / (1 + sum((c > 0).astype(int) for c in counts.values())))
    for k, c in counts.items():
        v = c * idf
        assert found[k][1:] == pytest.approx((v / (np.linalg.norm(v) or 1)).tolist(), abs=1e-6)


def test_sparse_node_vectors_equal_arrays(spark):
    """ML vectors hold what the arrays hold, a missing figure as NaN, without the zeros."""
    nodes, tweets = text_nodes(spark)
    nodes = nodes.withColumn("x1", F.when(F.col("node_idx") != 2, F.col("node_idx").cast("double")))
    dense = states(text.node_vectors(nodes, tweets, ["x0", "x1"], dimensions=64))
    found = states(text.node_vectors(nodes, tweets, ["x0", "x1"], dimensions=64, sparse=True))
    assert set(found) == set(dense)
    for k, v in found.items():
        filled = [np.nan if n is None else n for n in dense[k]]
        assert v.toArray().tolist() == pytest.approx(filled, abs=1e-6, nan_ok=True) and len(v.values) < 8


def test_stored_text_nodes_hold_no_zeros(spark):
    from ripplegraph.plans import registry

    nodes, _ = registry._text_nodes(spark, "/root/testdata/sf0.001")
    row = nodes.first()
    assert row.state.size == 392 and len(row.state.values) < 30


@pytest.mark.parametrize("size", [None, 3, 9])
def test_vectors_equal_arrays(spark, monkeypatch, size):
    """ML vectors, sparse and dense ones, in one group, embedded before they travel, and in cells."""
    if size:
        monkeypatch.setattr(vectors, "CELL", size)
        monkeypatch.setattr(vectors, "SLICED", 60)
    rng = np.random.default_rng(8)
    graphs = [(x * (rng.random(x.shape) < 0.1 + 0.9 * (np.arange(len(x)) % 3 == 0)[:, None]), e) for x, e in random_graphs(15, 4, 40)]
    nodes, links = arrayed(spark, graphs)
    sent = nodes.select("news_id", "node_idx", F.col("state").alias("_s"))
    packed = F.udf(lambda v: (Vectors.sparse(40, [(i, n) for i, n in enumerate(v) if n]) if sum(map(bool, v)) < 20 else Vectors.dense(v)), VectorUDT())
    sent = sent.select("news_id", "node_idx", packed("_s").alias("state"))
    net = wide_network(40, 4)
    last, spread = states(vectors.vector_states(sent, links, net)), states(vectors.vector_propagate(sent, links, 2))
    found = {r.news_id: r.p_fake for r in vectors.vector_infer(sent, links, net).collect()}
    for g, (x, e) in enumerate(graphs):
        h, z = dense_pass(x, e, net)
        a = dense(x, [e for e in e if e[0] != e[1]])
        for i in range(len(x)):
            assert last[(f"g{g}", i)] == pytest.approx(h[i].tolist())
            assert spread[(f"g{g}", i)] == pytest.approx((a @ a @ x)[i].tolist())
        assert found[f"g{g}"] == pytest.approx(np.exp(z[1]))


def test_encoder_of_the_caller(spark):
    nodes, tweets = text_nodes(spark)
    found = text.encode_texts(tweets, ["tweet_id"], lambda texts: [[len(t), 1.0] for t in texts], "tweet_id string")
    assert {r.tweet_id: r.embedding for r in found.collect()} == {"t1": [10.0, 1.0], "t2": [0.0, 1.0]}


def test_fit_on_text_states(spark):
    """Graphs whose class shows in a few of 40 numbers of their nodes are told apart."""
    rng = np.random.default_rng(1)
    graphs = [(rng.normal(size=(5, 40)) + (g % 2) * np.eye(1, 40, 3) * 4, [(0, i) for i in range(1, 5)]) for g in range(60)]
    pooled = vectors.vector_pool(vectors.vector_propagate(*arrayed(spark, graphs), rounds=2))
    label = F.substring("news_id", 2, 9).cast("int") % 2
    rows = pooled.select("news_id", label.cast("double").alias("label"), array_to_vector("state").alias("pooled"))
    model = learning.fit_structure_text(rows, [], "pooled", learning.logistic())
    assert learning.predict_graphs(model, rows, "text").where("label = pred").count() == 60


def test_arrays_equal_named_columns(spark):
    graphs = random_graphs(11, 3)
    nodes, links = tables(spark, graphs)
    net = wide_network(4)
    named = {r.news_id: r.p_fake for r in graph.gnn_infer(nodes, links, [f"x{i}" for i in range(4)], net).collect()}
    found = {r.news_id: r.p_fake for r in vectors.vector_infer(*arrayed(spark, graphs), net).collect()}
    assert found == pytest.approx(named)


def test_wide_named_states_go_as_arrays(spark):
    """The forward pass on named columns: a wide state is exchanged once, and gives what dense matrices give."""
    graphs = random_graphs(13, 3)
    nodes, links = tables(spark, graphs)
    names, net = [f"x{i}" for i in range(4)], wide_network(4, 20)
    state, hidden = graph.node_states(nodes, links, names, net, last_relu=True)
    assert state._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 2
    found = {(r.news_id, r.node_idx): [r[h] for h in hidden] for r in state.collect()}
    for g, (x, e) in enumerate(graphs):
        for i, row in enumerate(dense_pass(x, e, net)[0]):
            assert found[(f"g{g}", i)] == pytest.approx(row.tolist())


def test_inputs_of_user_graphs_are_joined_once(spark, monkeypatch):
    from ripplegraph.plans import registry

    stored, inner = [], registry.materialise
    monkeypatch.setattr(registry, "materialise", lambda df, name: stored.append(name) or inner(df, name))
    assert registry.write_user_graphs(spark, "/root/testdata/sf0.001").count() and stored == ["tweets", "links"]
