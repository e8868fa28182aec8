"""Message passing and forward passes against dense matrices."""

import numpy as np
import pytest

from ripplegraph.operators import graph
from ripplegraph.operators.graph import Layer, Network
from ripplegraph.plans import colocated, skew

EDGES = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 2)]
X = np.array([[1.0, 2], [3, 1], [0, 5], [2, 2]])


def tables(spark, graphs):
    """Nodes and edges of several graphs, each given as (features, edges)."""
    width = graphs[0][0].shape[1]
    nodes = [(f"g{g}", i, *map(float, row)) for g, (x, _) in enumerate(graphs) for i, row in enumerate(x)]
    links = [(f"g{g}", s, d) for g, (_, e) in enumerate(graphs) for s, d in e]
    schema = "news_id string, node_idx long, " + ", ".join(f"x{i} double" for i in range(width))
    return spark.createDataFrame(nodes, schema), spark.createDataFrame(links, "news_id string, src_idx long, dst_idx long")


def random_graphs(seed, count=3, width=4):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(count):
        n = int(rng.integers(3, 9))
        star = [(0, i) for i in range(1, n)]
        extra = [tuple(map(int, rng.integers(1, n, 2))) for _ in range(5)]
        out.append((rng.normal(size=(n, width)), star + [e for e in extra if e[0] != e[1]]))
    return out


def dense(x, links):
    n = len(x)
    a = np.eye(n)
    for s, d in links:
        a[d, s] += 1
    root = 1 / np.sqrt(a.sum(axis=1))
    return root[:, None] * a * root[None, :]


def collected(df, names):
    return {(r.news_id, r.node_idx): [r[n] for n in names] for r in df.collect()}


def test_propagation_by_hand(spark):
    nodes, links = tables(spark, [(X, EDGES)])
    found = collected(graph.gcn_propagate(nodes, links, ["x0", "x1"]), ["x0", "x1"])
    expected = [[1, 2], [2.207107, 1.914214], [2.621320, 2.957107], [1.707107, 2.414214]]
    for i, row in enumerate(expected):
        assert found[("g0", i)] == pytest.approx(row, abs=1e-6)
    degrees = {r.node_idx: r.degree for r in graph.in_degrees(nodes, links).collect()}
    assert degrees == {0: 1, 1: 2, 2: 4, 3: 2}


@pytest.mark.parametrize("hot", [False, True])
def test_bucketed_propagation_matches(spark, monkeypatch, hot):
    """Rounds over bucketed tables, also with the largest story above the limit; nothing is left of the tables."""
    nodes, links = tables(spark, random_graphs(1))
    names = [f"x{i}" for i in range(4)]
    if hot:
        sizes = [r["count"] for r in graph.links_of(nodes, links).groupBy("news_id").count().collect()]
        assert min(sizes) < max(sizes)
        monkeypatch.setattr(skew, "HOT_ROWS", max(sizes) - 1)
    monkeypatch.setattr(colocated, "BUCKET_ROWS", 5)
    found = collected(colocated.gcn_propagate(nodes, links, names, rounds=4), names)
    expected = collected(graph.gcn_propagate(nodes, links, names, rounds=4), names)
    assert found.keys() == expected.keys() and all(row == pytest.approx(expected[k]) for k, row in found.items())
    means = [*names, *[f"mean_{n}" for n in names]]
    found, expected = [collected(m.sage_mean(nodes, links, names), means) for m in (colocated, graph)]
    assert found.keys() == expected.keys() and all(row == pytest.approx(expected[k]) for k, row in found.items())
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(("nodes_", "links_"))]
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_bucketed_rounds_exchange_nothing(spark):
    nodes, links = tables(spark, random_graphs(1))
    names = [f"x{i}" for i in range(4)]
    with colocated.stored_by_story(nodes, graph.links_of(nodes, links), 3) as (lying, meeting):
        done = graph.gcn_rounds(lying, meeting, names, 3, colocated.ORDINARY, store_every=4)
        plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("SortMergeJoin") == 4


@pytest.mark.parametrize("limit", [None, 2])
def test_many_rounds_match_the_dense_matrix(spark, monkeypatch, limit):
    if limit:
        monkeypatch.setattr(skew, "HOT_ROWS", limit)
    many = random_graphs(1)
    nodes, links = tables(spark, many)
    names = [f"x{i}" for i in range(4)]
    found = collected(graph.gcn_propagate(nodes, links, names, rounds=4), names)
    for g, (x, e) in enumerate(many):
        a = dense(x, e)
        expected = a @ a @ a @ a @ x
        for i, row in enumerate(expected):
            assert found[(f"g{g}", i)] == pytest.approx(row)
        summed = np.zeros_like(a)
        for r in graph.gcn_norm(nodes, links).where(f"news_id = 'g{g}'").collect():
            summed[r.dst_idx, r.src_idx] += r.weight
        assert np.allclose(summed, a)


def test_sage_and_isolated_nodes(spark):
    nodes, links = tables(spark, [(X, EDGES)])
    found = collected(graph.sage_mean(nodes, links, ["x0", "x1"]), ["x0", "mean_x0", "mean_x1"])
    assert found[("g0", 0)] == [1, 0, 0]
    assert found[("g0", 2)] == pytest.approx([0, (1 + 3 + 3) / 3, (2 + 1 + 1) / 3])


def attention(x, links, a_s, a_d):
    out = np.zeros_like(x)
    for i in range(len(x)):
        sources = [s for s, d in links if d == i] + [i]
        e = np.array([x[s] @ a_s + x[i] @ a_d for s in sources])
        e = np.where(e > 0, e, 0.2 * e)
        w = np.exp(e - e.max())
        out[i] = (w[:, None] * x[sources]).sum(axis=0) / w.sum()
    return out


@pytest.mark.parametrize("limit", [None, 2])
def test_attention(spark, monkeypatch, limit):
    if limit:
        monkeypatch.setattr(skew, "HOT_ROWS", limit)
    many = random_graphs(2)
    nodes, links = tables(spark, many)
    names = [f"x{i}" for i in range(4)]
    a_s, a_d = np.array([0.5, -1, 2, 0.1]), np.array([-0.3, 0.2, 1, 1])
    found = collected(graph.gat_attention(nodes, links, names, a_s, a_d), names)
    for g, (x, e) in enumerate(many):
        for i, row in enumerate(attention(x, e, a_s, a_d)):
            assert found[(f"g{g}", i)] == pytest.approx(row)


def test_attention_does_not_overflow(spark):
    nodes, links = tables(spark, [(X * 1000, EDGES)])
    found = collected(graph.gat_attention(nodes, links, ["x0", "x1"], [1.0, 1.0], [1.0, 1.0]), ["x0", "x1"])
    assert np.isfinite(list(found.values())).all()


def test_pooling(spark):
    nodes, _ = tables(spark, [(X, EDGES), (X * 2, [])])
    pooled = {r.news_id: tuple(r)[1:] for r in graph.mean_max_pool(nodes, ["x0", "x1"]).collect()}
    assert pooled["g0"] == (1.5, 2.5, 3.0, 5.0) and pooled["g1"] == (3.0, 5.0, 6.0, 10.0)
    joined = graph.news_concat(graph.max_pool(nodes, ["x0"]), nodes, ["x0", "x1"]).where("news_id = 'g1'").first()
    assert tuple(joined)[1:] == (6.0, 2.0, 4.0)
    assert graph.graph_mean_features(nodes, ["x0"], include_news=False).where("news_id = 'g0'").first().x0 == pytest.approx(5 / 3)
    wide = graph.pad_news(nodes, ["x0", "x1"], 4).first()
    assert (wide.x2, wide.x3) == (0.0, 0.0)


@pytest.mark.parametrize("outputs", [3, 80])
def test_linear_layer(spark, outputs):
    rng = np.random.default_rng(0)
    many = random_graphs(3)
    nodes, _ = tables(spark, many)
    layer = Layer(rng.normal(size=(outputs, 4)), rng.normal(size=outputs))
    names = [f"x{i}" for i in range(4)]
    found = collected(graph.linear_layer(nodes, graph.NODE, names, layer, relu=True), [f"h{j}" for j in range(outputs)])
    for g, (x, _) in enumerate(many):
        expected = np.maximum(x @ layer.weight.T + layer.bias, 0)
        for i, row in enumerate(expected):
            assert found[(f"g{g}", i)] == pytest.approx(row)
    with pytest.raises(ValueError):
        graph.linear_layer(nodes, graph.NODE, names[:2], layer)


def layer(rng, out, inp):
    return Layer(rng.normal(size=(out, inp)) / np.sqrt(inp), rng.normal(size=out) * 0.1)


def apply(l, x):
    return x @ l.weight.T + l.offsets()


def relu(x):
    return np.maximum(x, 0)


def forward(net, x, e):
    """The network on one graph with dense matrices; the state after the last convolution and the log-probabilities."""
    h = relu(apply(net.embedding, x)) if net.embedding else x
    last = None
    for number, conv in enumerate(net.convolutions, 1):
        if net.convolution == "gcn":
            last = dense(x, e) @ (h @ conv.weight.T) + conv.offsets()
        elif net.convolution == "gat":
            last = attention(h @ conv.weight.T, e, *net.attention) + conv.offsets()
        else:
            mean = np.zeros_like(h)
            for i in range(len(h)):
                near = [s for s, d in e if d == i]
                mean[i] = h[near].mean(axis=0) if near else 0
            last = mean @ net.neighbours.weight.T + net.neighbours.offsets() + h @ conv.weight.T
        h = last if net.kind == "simple" and number == len(net.convolutions) else relu(last)
    if net.kind == "pooled":
        g = apply(net.projection, np.concatenate([h.mean(axis=0), h.max(axis=0)]))
    else:
        g = h.max(axis=0)
        if net.news is not None:
            g = relu(apply(net.joined, np.concatenate([g, relu(apply(net.news, x[0]))])))
    z = apply(net.classifier, g)
    return last, z - z.max() - np.log(np.exp(z - z.max()).sum())


def networks():
    rng = np.random.default_rng(5)
    yield Network("pooled", [layer(rng, 6, 6), layer(rng, 6, 6)], layer(rng, 2, 6), embedding=layer(rng, 6, 4), projection=layer(rng, 6, 12))
    yield Network("simple", [layer(rng, 5, 4), layer(rng, 3, 5)], layer(rng, 2, 3))
    for kind in ("gcn", "sage", "gat"):
        yield Network(
            "news",
            [layer(rng, 5, 4) if kind != "sage" else Layer(rng.normal(size=(5, 4)))],
            layer(rng, 2, 5),
            news=layer(rng, 5, 4),
            joined=layer(rng, 5, 10),
            convolution=kind,
            neighbours=layer(rng, 5, 4),
            attention=(rng.normal(size=5), rng.normal(size=5)),
        )
    yield Network("news", [layer(rng, 5, 4)], layer(rng, 2, 5))


@pytest.mark.parametrize("number", range(6))
def test_forward_passes(spark, number):
    net = list(networks())[number]
    many = random_graphs(number + 10)
    nodes, links = tables(spark, many)
    names = [f"x{i}" for i in range(4)]
    found = {r.news_id: r for r in graph.gnn_infer(nodes, links, names, net).collect()}
    for g, (x, e) in enumerate(many):
        _, logp = forward(net, x, e)
        row = found[f"g{g}"]
        assert [row.log_p_real, row.log_p_fake] == pytest.approx(logp)
        assert row.p_real + row.p_fake == pytest.approx(1)
        assert row.pred == int(logp[1] > logp[0])


def test_graph_embeddings_are_taken_before_the_relu(spark):
    net = next(networks())
    many = random_graphs(20)
    nodes, links = tables(spark, many)
    graphs = spark.createDataFrame([(f"g{i}", i % 2) for i in range(3)], "news_id string, label int")
    found = {r.news_id: r for r in graph.graph_embeddings(nodes, links, [f"x{i}" for i in range(4)], net, graphs).collect()}
    for g, (x, e) in enumerate(many):
        assert found[f"g{g}"].embedding == pytest.approx(forward(net, x, e)[0].mean(axis=0))


def test_ties_give_class_zero(spark):
    nodes, links = tables(spark, [(X, EDGES)])
    flat = Network("simple", [Layer(np.ones((2, 2))), Layer(np.ones((2, 2)))], Layer(np.zeros((2, 2))))
    row = graph.gnn_infer(nodes, links, ["x0", "x1"], flat).first()
    assert (row.p_fake, row.pred) == (0.5, 0)


def test_weights_as_a_table(spark, tmp_path):
    rng = np.random.default_rng(1)
    layers = {"a": layer(rng, 3, 4), "b": Layer(rng.normal(size=(2, 3)))}
    graph.write_weights(spark, layers, str(tmp_path / "weights"))
    back = graph.read_weights(spark, str(tmp_path / "weights"))
    assert np.allclose(back["a"].weight, layers["a"].weight) and np.allclose(back["a"].bias, layers["a"].bias)
    assert np.allclose(back["b"].weight, layers["b"].weight) and back["b"].bias is None
