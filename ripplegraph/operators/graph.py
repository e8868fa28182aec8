"""Message passing, pooling and forward passes over all graphs at once.

Nodes are ``news_id, node_idx`` with named feature columns, edges ``news_id, src_idx, dst_idx``. One round is one
equi-join (edges to source nodes) and one grouping (by target, with partial sums before the shuffle). The news
node points at every tweet, so a large cascade has a source shared by very many edges: such sources are spread.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplegraph.plans.skew import HotKeys, hot_key_sets, hot_keys, salted_join, split_hot
from ripplegraph.session import materialise

NODE = ["news_id", "node_idx"]
LEAK = 0.2
# Rounds after which the state is stored, to keep the plan short.
STORE_EVERY = 3
# Layers up to this many weights are written out as column expressions; larger ones run on Arrow batches.
MAX_EXPRESSION_WEIGHTS = 256
# States wider than this travel as arrays, once for all rounds, where the convolution is a normalised sum.
MAX_NAMED_STATE = 16


# --- propagation ------------------------------------------------------------------------------


def hot_sources(edges: DataFrame) -> HotKeys:
    return hot_keys(edges, ["news_id", "src_idx"])


def hot_ends(edges: DataFrame) -> list[HotKeys]:
    """Sources and targets shared by very many edges."""
    return hot_key_sets(edges, [["news_id", "src_idx"], ["news_id", "dst_idx"]])


def links_of(nodes: DataFrame, edges: DataFrame, drop_loops: bool = True) -> DataFrame:
    """Edges plus one link of every node to itself, marked ``own``. Loops in the input give way to it."""
    real = edges.where(F.col("src_idx") != F.col("dst_idx")) if drop_loops else edges
    return real.select("news_id", "src_idx", "dst_idx", F.lit(False).alias("own")).unionByName(
        nodes.select(
            "news_id", F.col("node_idx").alias("src_idx"), F.col("node_idx").alias("dst_idx"), F.lit(True).alias("own")
        )
    )


def in_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Incoming edges per node, counting one loop and every one of several equal edges."""
    return (
        links_of(nodes, edges)
        .groupBy("news_id", F.col("dst_idx").alias("node_idx"))
        .agg(F.count(F.lit(1)).cast("double").alias("degree"))
    )


def gcn_norm(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Weight 1/sqrt(d_src * d_dst) per edge, loops included."""
    hot, hot_targets = hot_ends(edges)
    degrees = in_degrees(nodes, edges)
    src = degrees.select("news_id", F.col("node_idx").alias("src_idx"), F.col("degree").alias("d_src"))
    dst = degrees.select("news_id", F.col("node_idx").alias("dst_idx"), F.col("degree").alias("d_dst"))
    linked = salted_join(links_of(nodes, edges), src, ["news_id", "src_idx"], hot, ["dst_idx"])
    linked = salted_join(linked, dst, ["news_id", "dst_idx"], hot_targets, ["src_idx"])
    weight = F.lit(1.0) / F.sqrt(F.col("d_src") * F.col("d_dst"))
    return linked.select("news_id", "src_idx", "dst_idx", weight.alias("weight"))


def _as_source(state: DataFrame, *names: str) -> DataFrame:
    return state.select("news_id", F.col("node_idx").alias("src_idx"), *names)


def _with_degree(nodes: DataFrame, links: DataFrame, names: list[str]) -> DataFrame:
    degrees = links.groupBy("news_id", F.col("dst_idx").alias("node_idx")).agg(
        F.count(F.lit(1)).cast("double").alias("degree")
    )
    return nodes.select(*NODE, *names).join(degrees, NODE)


def _gcn_round(state: DataFrame, links: DataFrame, names: list[str], hot: HotKeys) -> DataFrame:
    """One normalised neighbour sum over ``state``, which carries ``degree`` and is read once.

    An edge's weight splits into a factor of its source and one of its target, so no weight is looked up: states
    are divided by the root of their degree before and after the sum. A node's own link takes its degree along.
    """
    root = F.sqrt("degree")
    scaled = state.withColumns({n: F.col(n) / root for n in names})
    sent = salted_join(links, _as_source(scaled, "degree", *names), ["news_id", "src_idx"], hot, ["dst_idx"])
    return (
        sent.groupBy("news_id", F.col("dst_idx").alias("node_idx"))
        .agg(F.max(F.when(F.col("own"), F.col("degree"))).alias("degree"), *[F.sum(n).alias(n) for n in names])
        .withColumns({n: F.col(n) / root for n in names})
    )


def gcn_propagate(
    nodes: DataFrame, edges: DataFrame, names: list[str], rounds: int = 1, hot: HotKeys | None = None
) -> DataFrame:
    """``rounds`` rounds of the normalised neighbour sum, without weights: one join and one grouping each."""
    hot = hot_sources(edges) if hot is None else hot
    return gcn_rounds(nodes, links_of(nodes, edges), names, rounds, hot)


def gcn_rounds(nodes: DataFrame, links: DataFrame, names: list[str], rounds: int, hot: HotKeys, store_every: int = STORE_EVERY) -> DataFrame:
    """The rounds over ``links``, which hold one link of every node to itself, marked ``own``."""
    state = _with_degree(nodes, links, names)
    for done in range(1, rounds + 1):
        state = _gcn_round(state, links, names, hot)
        if done % store_every == 0 and done < rounds:
            state = materialise(state)
    return state.select(*NODE, *names)


def sage_round(state: DataFrame, links: DataFrame, names: list[str], prefix: str, hot: HotKeys) -> DataFrame:
    sent = salted_join(links, _as_source(state, *names), ["news_id", "src_idx"], hot, ["dst_idx"])
    own, heard = F.col("own"), ~F.col("own")
    return sent.groupBy("news_id", F.col("dst_idx").alias("node_idx")).agg(
        *[F.max(F.when(own, F.col(n))).alias(n) for n in names],
        *[F.coalesce(F.avg(F.when(heard, F.col(n))), F.lit(0.0)).alias(f"{prefix}{n}") for n in names],
    )


def sage_mean(
    nodes: DataFrame, edges: DataFrame, names: list[str], prefix: str = "mean_", hot: HotKeys | None = None
) -> DataFrame:
    """Each node's own columns and the mean over its in-neighbours (0 for a node without any)."""
    hot = hot_sources(edges) if hot is None else hot
    return sage_round(nodes, links_of(nodes, edges, drop_loops=False), names, prefix, hot)


def _weighted(names: list[str], weights) -> Column:
    return sum((F.col(n) * F.lit(float(w)) for n, w in zip(names, weights)), F.lit(0.0))


def _leaky(value: Column) -> Column:
    return F.when(value > 0, value).otherwise(value * F.lit(LEAK))


def _attended(rows: DataFrame, names: list[str]) -> DataFrame:
    """Weighted means per target of rows that know the target's part ``_d`` and its largest source part ``_top``."""
    share = F.exp(_leaky(F.col("_s") + F.col("_d")) - _leaky(F.col("_top") + F.col("_d")))
    summed = rows.withColumn("_w", share).groupBy("news_id", F.col("dst_idx").alias("node_idx")).agg(
        F.sum("_w").alias("_total"), *[F.sum(F.col("_w") * F.col(n)).alias(n) for n in names]
    )
    return summed.select(*NODE, *[(F.col(n) / F.col("_total")).alias(n) for n in names])


def _gat_round(
    state: DataFrame, links: DataFrame, names: list[str], attention, hot: HotKeys, hot_targets: HotKeys
) -> DataFrame:
    """The leaky score grows with its argument, so the largest score of a target follows from the largest
    source part, and no exponential can overflow. A target's own part comes with its link to itself.

    The rows sent to a target are exchanged once: largest part, own part and sums are all taken where they have met.
    Only targets with very many links get a grouping that combines before its exchange, and a join back.
    """
    scored = state.select(
        *NODE, *names, _weighted(names, attention[0]).alias("_s"), _weighted(names, attention[1]).alias("_t")
    )
    sent = salted_join(links, _as_source(scored, "_s", "_t", *names), ["news_id", "src_idx"], hot, ["dst_idx"])
    own = F.when(F.col("own"), F.col("_t"))
    met, many = (sent, None) if hot_targets.empty else split_hot(sent, hot_targets)
    here = Window.partitionBy("news_id", "dst_idx")
    found = _attended(met.withColumns({"_top": F.max("_s").over(here), "_d": F.max(own).over(here)}), names)
    if many is None:
        return found
    targets = many.groupBy("news_id", "dst_idx").agg(F.max("_s").alias("_top"), F.max(own).alias("_d"))
    return found.unionByName(_attended(salted_join(many, targets, ["news_id", "dst_idx"], hot_targets, ["src_idx"]), names))


def gat_attention(
    nodes: DataFrame, edges: DataFrame, names: list[str], source_weights, target_weights
) -> DataFrame:
    """Attention-weighted sum over in-neighbours and the node itself, for given attention vectors."""
    return _gat_round(nodes, links_of(nodes, edges), names, (source_weights, target_weights), *hot_ends(edges))


# --- pooling ----------------------------------------------------------------------------------


def mean_max_pool(nodes: DataFrame, names: list[str]) -> DataFrame:
    """Per graph the mean and the maximum of every column."""
    return nodes.groupBy("news_id").agg(
        *[F.avg(n).alias(f"mean_{n}") for n in names], *[F.max(n).alias(f"max_{n}") for n in names]
    )


def max_pool(nodes: DataFrame, names: list[str]) -> DataFrame:
    return nodes.groupBy("news_id").agg(*[F.max(n).alias(f"max_{n}") for n in names])


def news_concat(pooled: DataFrame, nodes: DataFrame, names: list[str]) -> DataFrame:
    """Pooled columns next to the raw features of the news node."""
    news = nodes.where(F.col("node_idx") == 0).select("news_id", *[F.col(n).alias(f"news_{n}") for n in names])
    return pooled.join(news, "news_id")


def graph_mean_features(nodes: DataFrame, names: list[str], include_news: bool = True) -> DataFrame:
    """Mean node features per graph, with or without the news node."""
    kept = nodes if include_news else nodes.where(F.col("node_idx") != 0)
    return kept.groupBy("news_id").agg(*[F.avg(n).alias(n) for n in names])


# --- dense layers -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Layer:
    """A linear map: ``weight`` has one row per output; ``bias`` may be absent."""

    weight: np.ndarray
    bias: np.ndarray | None = None

    @property
    def outputs(self) -> int:
        return self.weight.shape[0]

    def offsets(self) -> np.ndarray:
        return np.zeros(self.outputs) if self.bias is None else np.asarray(self.bias, dtype=float)


def linear_layer(
    df: DataFrame, keep: list[str], inputs: list[str], layer: Layer, prefix: str = "h", relu: bool = False
) -> DataFrame:
    """``x W' + b`` on named columns, giving ``prefix0, prefix1, ..`` next to the ``keep`` columns.

    Small layers become column expressions inside code generation, large ones one matrix product per Arrow batch.
    """
    weight = np.asarray(layer.weight, dtype=float)
    if weight.shape[1] != len(inputs):
        raise ValueError(f"the layer takes {weight.shape[1]} inputs, not {len(inputs)}")
    names = [f"{prefix}{j}" for j in range(layer.outputs)]
    if weight.size > MAX_EXPRESSION_WEIGHTS:
        return _linear_batches(df, keep, inputs, weight, layer.offsets(), names, relu)
    outputs = []
    for row, offset, name in zip(weight, layer.offsets(), names):
        # A null among the inputs makes the outputs NaN, as in the product of batches.
        value = F.coalesce(_weighted(inputs, row) + F.lit(float(offset)), F.lit(float("nan")))
        outputs.append((F.greatest(value, F.lit(0.0)) if relu else value).alias(name))
    return df.select(*keep, *outputs)


def _linear_batches(
    df: DataFrame, keep: list[str], inputs: list[str], weight: np.ndarray, offset: np.ndarray, names: list[str], relu: bool
) -> DataFrame:
    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in inputs])
            y = x.astype(float) @ weight.T + offset
            y = np.maximum(y, 0.0) if relu else y
            kept = [batch.column(n) for n in keep]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(c) for c in y.T]], names=[*keep, *names])

    narrow = df.select(*keep, *[F.col(n).cast("double") for n in inputs])
    kept = ", ".join(f"{n} {narrow.schema[n].dataType.simpleString()}" for n in keep)
    return narrow.mapInArrow(multiply, f"{kept}, " + ", ".join(f"{n} double" for n in names))


def spread_array(df: DataFrame, keep: list[str], array: str, width: int, prefix: str = "x") -> DataFrame:
    """An array column of known width as named columns."""
    return df.select(*keep, *[F.col(array)[i].cast("double").alias(f"{prefix}{i}") for i in range(width)])


# --- forward passes ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Network:
    """Caller-supplied weights of a graph classifier.

    ``kind`` is ``pooled`` (embedding, convolutions with relu, mean and max pooling, projection, classifier),
    ``simple`` (two convolutions, max pooling, classifier) or ``news`` (one convolution, max pooling, optionally
    joined with the news node's features, classifier). ``convolution`` is ``gcn``, ``sage`` or ``gat``.
    """

    kind: str
    convolutions: list[Layer]
    classifier: Layer
    embedding: Layer | None = None
    projection: Layer | None = None
    news: Layer | None = None
    joined: Layer | None = None
    convolution: str = "gcn"
    neighbours: Layer | None = None  # sage: weights of the neighbour mean; its bias is added
    attention: tuple[np.ndarray, np.ndarray] = field(default_factory=tuple)  # gat: source and target vectors


def _names(prefix: str, n: int) -> list[str]:
    return [f"{prefix}{j}" for j in range(n)]


def node_states(
    nodes: DataFrame, edges: DataFrame, names: list[str], net: Network, last_relu: bool, hot: HotKeys | None = None
) -> tuple[DataFrame, list[str]]:
    """Node states after the last convolution, before or after its relu.

    Links and degrees come from the node table, never from a state, so a layer reads the state before it once. As
    neighbour sums and linear maps commute, the sum runs on the narrower side of a layer.
    """
    gcn = net.convolution == "gcn"
    if gcn and min(layer.weight.shape[1] for layer in net.convolutions) > MAX_NAMED_STATE:
        from ripplegraph.operators import vectors  # it builds on this module

        arrayed = nodes.select(*NODE, F.array(*[F.col(n).cast("double") for n in names]).alias("state"))
        width = net.convolutions[-1].outputs
        return spread_array(vectors.vector_states(arrayed, edges, net, last_relu), NODE, "state", width, "h"), _names("h", width)
    hot = hot_sources(edges) if hot is None else hot
    links = links_of(nodes, edges, drop_loops=net.convolution != "sage")
    state, inputs = (_with_degree(nodes, links, names) if gcn else nodes.select(*NODE, *names)), names
    keep = [*NODE, "degree"] if gcn else NODE
    if net.embedding is not None:
        state = linear_layer(state, keep, inputs, net.embedding, "h", relu=True)
        inputs = _names("h", net.embedding.outputs)
    for number, layer in enumerate(net.convolutions, 1):
        relu = last_relu or number < len(net.convolutions)
        names_out = _names("h", layer.outputs)
        if net.convolution == "sage":
            heard = sage_round(state, links, inputs, "m_", hot)
            both = Layer(np.hstack([net.neighbours.weight, layer.weight]), net.neighbours.offsets())
            state = linear_layer(heard, keep, [f"m_{n}" for n in inputs] + inputs, both, "h", relu)
        elif net.convolution == "gat":
            mapped = linear_layer(state, keep, inputs, Layer(layer.weight), "h")
            hot_targets = hot_keys(edges, ["news_id", "dst_idx"])
            summed = _gat_round(mapped, links, names_out, net.attention, hot, hot_targets)
            state = _biased(summed, keep, names_out, layer.offsets(), relu)
        elif layer.outputs < len(inputs):
            mapped = linear_layer(state, keep, inputs, Layer(layer.weight), "h")
            state = _biased(_gcn_round(mapped, links, names_out, hot), keep, names_out, layer.offsets(), relu)
        else:
            state = linear_layer(_gcn_round(state, links, inputs, hot), keep, inputs, layer, "h", relu)
        inputs = names_out
    return state.select(*NODE, *inputs), inputs


def _biased(df: DataFrame, keep: list[str], names: list[str], bias, relu: bool) -> DataFrame:
    shifted = {n: F.col(n) + F.lit(float(b)) for n, b in zip(names, bias)}
    if relu:
        shifted = {n: F.greatest(c, F.lit(0.0)) for n, c in shifted.items()}
    return df.select(*keep, *[c.alias(n) for n, c in shifted.items()])


def gnn_infer(
    nodes: DataFrame, edges: DataFrame, names: list[str], net: Network, hot: HotKeys | None = None
) -> DataFrame:
    """The whole forward pass: log-probabilities, probability of fake and the predicted class per graph."""
    state, hidden = node_states(nodes, edges, names, net, last_relu=net.kind != "simple", hot=hot)
    if net.kind == "pooled":
        pooled = mean_max_pool(state, hidden)
        inputs = [f"mean_{n}" for n in hidden] + [f"max_{n}" for n in hidden]
        pooled = linear_layer(pooled, ["news_id"], inputs, net.projection, "g")
        inputs = _names("g", net.projection.outputs)
    else:
        pooled = max_pool(state, hidden)
        inputs = [f"max_{n}" for n in hidden]
        if net.kind == "news" and net.news is not None:
            news = nodes.where(F.col("node_idx") == 0)
            told = linear_layer(news, ["news_id"], names, net.news, "n", relu=True)
            both = pooled.join(told, "news_id")
            pooled = linear_layer(both, ["news_id"], inputs + _names("n", net.news.outputs), net.joined, "g", relu=True)
            inputs = _names("g", net.joined.outputs)
    return classify(linear_layer(pooled, ["news_id"], inputs, net.classifier, "z"))


def classify(scores: DataFrame) -> DataFrame:
    """Log-softmax of the two scores; equal scores give class 0."""
    top = F.greatest("z0", "z1")
    norm = top + F.log(F.exp(F.col("z0") - top) + F.exp(F.col("z1") - top))
    logged = scores.select("news_id", (F.col("z0") - norm).alias("log_p_real"), (F.col("z1") - norm).alias("log_p_fake"))
    return logged.withColumns(
        {
            "p_real": F.exp("log_p_real"),
            "p_fake": F.exp("log_p_fake"),
            "pred": F.when(F.col("log_p_fake") > F.col("log_p_real"), 1).otherwise(0),
        }
    )


def graph_embeddings(
    nodes: DataFrame, edges: DataFrame, names: list[str], net: Network, graphs: DataFrame, hot: HotKeys | None = None
) -> DataFrame:
    """Mean of the last convolution's output per graph, as an array, with the label."""
    state, hidden = node_states(nodes, edges, names, net, last_relu=False, hot=hot)
    means = graph_mean_features(state, hidden)
    return means.join(graphs.select("news_id", "label"), "news_id").select(
        "news_id", "label", F.array(*hidden).alias("embedding")
    )


# --- weights as a table -----------------------------------------------------------------------


def write_weights(spark: SparkSession, layers: dict[str, Layer], path: str) -> None:
    """Store named layers as rows ``layer, output, input, value`` (input -1 holds the bias)."""
    rows = []
    for name, layer in layers.items():
        for j, row in enumerate(np.asarray(layer.weight, dtype=float)):
            rows += [(name, j, i, float(v)) for i, v in enumerate(row)]
        if layer.bias is not None:
            rows += [(name, j, -1, float(v)) for j, v in enumerate(layer.bias)]
    spark.createDataFrame(rows, "layer string, output int, input int, value double").write.mode("overwrite").parquet(path)


def read_weights(spark: SparkSession, path: str) -> dict[str, Layer]:
    """Read layers back. A model's weights are small whatever the size of the data it scores."""
    table = spark.read.parquet(path).toPandas()
    layers = {}
    for name, rows in table.groupby("layer"):
        grid = rows.pivot(index="output", columns="input", values="value").sort_index()
        weight = grid[[c for c in sorted(grid.columns) if c >= 0]].to_numpy()
        layers[name] = Layer(weight, grid[-1].to_numpy() if -1 in grid.columns else None)
    return layers


def pad_news(nodes: DataFrame, names: list[str], width: int) -> DataFrame:
    """Zero columns up to ``width``, so that news and user rows fit one matrix."""
    extra = {f"x{i}": F.lit(0.0) for i in range(len(names), width)}
    return nodes.withColumns(extra) if extra else nodes
