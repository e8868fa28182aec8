"""Message passing on nodes whose state is one array column, for states too wide for named columns.

Nodes are ``news_id, node_idx, state`` (arrays of one width, or ML vectors of one size), edges ``news_id, src_idx, dst_idx``. ML
vectors travel as they are, sparse ones without zeros, and a first linear map meets them in their story. A story of up to
``whole_numbers()`` numbers (256 MB) meets its edges in one group, where all rounds run as matrix products: its states don't
travel between rounds. They travel there without their zeros, if most are. Rounds without a linear map run on a few columns
at a time. A larger story is cut into cells, a block of sources by a block of targets: each cell sums what its sources send,
and the partial sums of a target are added. Whatever its size, no such group holds more than ``CELL`` states, and equal edges
are merged first, so a story's size doesn't bound what can be run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripplegraph.operators.graph import NODE, Layer, Network, classify
from ripplegraph.plans.skew import is_small
from ripplegraph.session import materialise, ship_package

# Nodes of a block of a story.
CELL = 4_096
# Numbers that a sum over edges gathers at once.
GATHERED = 1 << 22
# Numbers in a column slice of a story's states.
SLICED = 1 << 22


@dataclass(frozen=True)
class Step:
    """What follows a normalised neighbour sum: nothing, or a linear map, with or without relu."""

    layer: Layer | None = None
    relu: bool = False

    def apply(self, x: np.ndarray) -> np.ndarray:
        if self.layer is not None:
            x = x @ np.asarray(self.layer.weight, float).T + self.layer.offsets()
        return np.maximum(x, 0.0) if self.relu else x


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The arrays of a column as rows; they must have one length."""
    flat = pa.chunked_array([column]) if isinstance(column, pa.Array) else column
    if pa.types.is_struct(flat.type):
        return _dense(*_entries(*_vector_parts(flat)), len(flat), _vector_size(flat))
    values = np.concatenate([np.zeros(0), *[c.flatten().to_numpy(zero_copy_only=False) for c in flat.chunks]]).astype(float)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def _vector_parts(column: pa.ChunkedArray) -> tuple[pa.Array, pa.Array]:
    """Of ML vectors the places (null where all numbers are kept) and the numbers."""
    vectors = column.combine_chunks()
    if isinstance(vectors, pa.ChunkedArray):
        vectors = pa.concat_arrays(vectors.chunks) if vectors.num_chunks else pa.array([], vectors.type)
    return vectors.field("indices"), vectors.field("values")


def _vector_size(column: pa.ChunkedArray) -> int:
    """The size of ML vectors, which dense ones tell by their numbers."""
    for vector in column:
        found = vector.as_py()
        return len(found["values"]) if found["size"] is None else found["size"]
    return 0


def _dense(row: np.ndarray, at: np.ndarray, value: np.ndarray, rows: int, width: int) -> np.ndarray:
    x = np.zeros((rows, width))
    x[row, at] = value
    return x


def arrays(rows: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    n, width = rows.shape
    values = pa.array(np.ascontiguousarray(rows).ravel(), kind or pa.float64())
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width, pa.int32()), values)


def _mapped(df: DataFrame, keep: list[str], change: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """The ``keep`` columns with a new ``state`` for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                kept = [batch.column(n) for n in keep]
                yield pa.RecordBatch.from_arrays([*kept, arrays(change(batch))], names=[*keep, "state"])

    ship_package(df.sparkSession)
    schema = T.StructType([*[df.schema[n] for n in keep], T.StructField("state", T.ArrayType(T.DoubleType()))])
    return df.mapInArrow(run, schema)


def vector_layer(df: DataFrame, keep: list[str], layer: Layer, relu: bool = False) -> DataFrame:
    """``x W' + b`` on the array column ``state``, one matrix product per Arrow batch."""
    step = Step(layer, relu)
    return _mapped(df.select(*keep, "state"), keep, lambda batch: step.apply(matrix(batch.column("state"))))


def _sums(x: np.ndarray, src: np.ndarray, dst: np.ndarray, n: np.ndarray | None, size: int) -> np.ndarray:
    """Per target the sum of its sources' rows, each times its number of edges (1 without ``n``); edges are sorted by target."""
    out = np.zeros((size, x.shape[1]))
    run = max(1, GATHERED // max(1, x.shape[1]))
    for at in range(0, len(src), run):
        part = slice(at, at + run)
        own = dst[part]
        starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        sent = x[src[part]]
        out[own[starts]] += np.add.reduceat(sent if n is None else sent * n[part, None], starts)
    return out


def _with_own(nodes: np.ndarray, links: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the ends of all links, one link of every node to itself included, by target."""
    own = np.arange(len(nodes))
    src, dst = (np.searchsorted(nodes, links[c].to_numpy()) for c in ("src_idx", "dst_idx"))
    src, dst = np.append(src, own), np.append(dst, own)
    order = np.argsort(dst, kind="stable")
    return src[order], dst[order]


def _shortened(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The states of a batch as ``value`` with the places ``at`` of the numbers, zeros left out; ``at`` is null where all are kept."""
    x = matrix(batch.column("state"))
    row, column = np.nonzero(x)
    if 3 * len(row) < x.size:
        ends = pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=len(x)))).astype(np.int32), pa.int32())
        at, value = (pa.ListArray.from_arrays(ends, pa.array(v)) for v in (column.astype(np.int32), x[row, column]))
    else:
        at, value = pa.nulls(len(x), pa.list_(pa.int32())), arrays(x)
    return pa.RecordBatch.from_arrays([batch.column("news_id"), batch.column("node_idx"), at, value], names=[*NODE, "at", "value"])


def _short(nodes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _shortened(batch)

    ints, numbers = T.ArrayType(T.IntegerType()), T.ArrayType(T.DoubleType())
    return nodes.mapInArrow(run, T.StructType([*[nodes.schema[n] for n in NODE], T.StructField("at", ints), T.StructField("value", numbers)]))


def _entries(at: pa.Array, value: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of all numbers that were sent."""
    counts = pc.fill_null(value.value_lengths(), 0).to_numpy()
    row, values = np.repeat(np.arange(len(counts), dtype=np.int32), counts), value.flatten().to_numpy(zero_copy_only=False)
    column = (np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)
    column[np.repeat(at.is_valid().to_numpy(zero_copy_only=False), counts)] = at.flatten().to_numpy()
    return row, column, values


def _embedded(at: pa.Array, value: pa.Array, width: int, first: Step) -> np.ndarray:
    """The first step on the states of a story, a block of nodes at a time."""
    run = max(1, SLICED // width)
    parts = []
    for lo in range(0, len(value), run):
        block = value.slice(lo, run)
        parts.append(first.apply(_dense(*_entries(at.slice(lo, run), block), len(block), width)))
    return np.concatenate(parts)


def _whole_stories(steps: list[Step], width: int, first: Step | None = None):
    """All rounds of one story, after a ``first`` step on its own states if there is one."""

    def rounds(x: np.ndarray, src: np.ndarray, dst: np.ndarray, root: np.ndarray) -> np.ndarray:
        for step in steps:
            x /= root
            x = _sums(x, src, dst, None, len(x))
            x /= root
            x = step.apply(x)
        return x

    def run(nodes: pa.Table, links: pa.Table) -> pa.Table:
        nodes = nodes.take(pa.array(np.argsort(nodes["node_idx"].to_numpy(), kind="stable")))
        idx = nodes["node_idx"].to_numpy()
        if not len(idx):
            return pa.table({**{n: nodes[n] for n in NODE}, "state": arrays(np.zeros((0, width)))})
        src, dst = _with_own(idx, links)
        root = np.sqrt(np.bincount(dst, minlength=len(idx)))[:, None]
        at, value = _vector_parts(nodes["state"]) if "state" in nodes.column_names else (nodes[n].combine_chunks() for n in ("at", "value"))
        if first is not None:
            x = rounds(_embedded(at, value, width, first), src, dst, root)
            return pa.table({**{n: nodes[n] for n in NODE}, "state": arrays(x)})
        full = matrix(value) if at.null_count == len(idx) else None
        if full is None:
            row, column, numbers = _entries(at, value)
            order = np.argsort(column, kind="stable")
            row, column, numbers = row[order], column[order], numbers[order]
        # a linear map needs all columns, a sum of neighbours none but its own
        each = max(1, SLICED // len(idx)) if all(s.layer is None for s in steps) else width
        out = np.empty((len(idx), width)) if each < width else None
        for lo in range(0, width, each):
            hi = min(width, lo + each)
            if full is None:
                a, b = np.searchsorted(column, [lo, hi])
                x = _dense(row[a:b], column[a:b] - lo, numbers[a:b], len(idx), hi - lo)
            else:
                x = full if each >= width else full[:, lo:hi].copy()
            x = rounds(x, src, dst, root)
            if out is not None:
                out[:, lo:hi] = x
        return pa.table({**{n: nodes[n] for n in NODE}, "state": arrays(x if out is None else out)})

    return run


def _cell_sums(nodes: pa.Table, links: pa.Table) -> pa.Table:
    """Partial sums of one cell, for the targets that it has links to."""
    if not nodes.num_rows or not links.num_rows:
        return pa.table({"news_id": pa.array([], links["news_id"].type), "node_idx": pa.array([], pa.int64()), "state": arrays(np.zeros((0, 1)))})
    nodes, links = nodes.sort_by("node_idx"), links.sort_by("dst_idx")
    targets, dst = np.unique(links["dst_idx"].to_numpy(), return_inverse=True)
    src = np.searchsorted(nodes["node_idx"].to_numpy(), links["src_idx"].to_numpy())
    sums = _sums(matrix(nodes["state"]), src, dst, links["n"].to_numpy().astype(float), len(targets))
    story = pa.array([nodes["news_id"][0].as_py()] * len(targets), nodes["news_id"].type)
    return pa.table({"news_id": story, "node_idx": targets, "state": arrays(sums)})


def _in_cells(state: DataFrame, links: DataFrame, steps: list[Step]) -> DataFrame:
    """All rounds for stories of any size: per round one meeting of sources and links by cell, and one grouping."""
    own = state.select("news_id", F.col("node_idx").alias("src_idx"), F.col("node_idx").alias("dst_idx"), F.lit(1).cast("long").alias("n"))
    block = {"sb": F.floor(F.col("src_idx") / CELL), "db": F.floor(F.col("dst_idx") / CELL)}
    links = materialise(links.unionByName(own).withColumns(block), "cells")
    degrees = links.groupBy("news_id", F.col("dst_idx").alias("node_idx")).agg(F.sum("n").cast("double").alias("degree"))
    # where a source is wanted: in every cell that it has links in
    wanted = materialise(links.select("news_id", F.col("src_idx").alias("node_idx"), "sb", "db").distinct().join(degrees, NODE), "wanted")
    schema = T.StructType([state.schema["news_id"], T.StructField("node_idx", T.LongType()), state.schema["state"]])
    for step in steps:
        sent = wanted.join(state, NODE)
        scaled = _mapped(
            sent.select("news_id", "sb", "db", "node_idx", "degree", "state"), ["news_id", "sb", "db", "node_idx"],
            lambda batch: matrix(batch.column("state")) / np.sqrt(batch.column("degree").to_numpy())[:, None],
        )
        cell = ["news_id", "sb", "db"]
        parts = scaled.groupBy(*cell).cogroup(links.groupBy(*cell)).applyInArrow(_cell_sums, schema)
        summed = parts.groupBy(*NODE).agg(vector_to_array(Summarizer.sum(array_to_vector("state"))).alias("state")).join(degrees, NODE)
        state = _mapped(
            summed.select(*NODE, "degree", "state"), NODE,
            lambda batch, step=step: step.apply(matrix(batch.column("state")) / np.sqrt(batch.column("degree").to_numpy())[:, None]),
        )
        state = materialise(state, "state")
    return state


def whole_numbers() -> int:
    """Numbers that the states of a story may have for it to be one group."""
    return 2 * CELL * CELL


def _large(nodes: DataFrame, edges: DataFrame, width: int) -> DataFrame:
    """The stories that are too large for one group, by numbers of their states or by links."""
    most = whole_numbers()
    by_nodes = nodes.groupBy("news_id").agg(F.max("node_idx").alias("last")).where((F.col("last") + 1) * width > most)
    by_links = edges.groupBy("news_id").agg(F.count(F.lit(1)).alias("links")).where(F.col("links") * 4 > most)
    return materialise(by_nodes.select("news_id").union(by_links.select("news_id")).distinct(), "large")


def _is_vector(nodes: DataFrame) -> bool:
    return isinstance(nodes.schema["state"].dataType, VectorUDT)


def vector_rounds(
    nodes: DataFrame, edges: DataFrame, steps: list[Step], listed: DataFrame | None = None, first: Layer | None = None
) -> DataFrame:
    """One normalised neighbour sum per step, each followed by the step: the nodes with their last state.

    Loops among the edges give way to the link of every node to itself; equal edges count each. ``listed`` is a table of the
    same nodes that is cheaper to read, for the sizes of stories. A layer ``first``, with relu, is applied before the rounds: to
    ML vectors in their story, if that may hold them without zeros left out, else before they travel.
    """
    ship_package(nodes.sparkSession)
    vector = _is_vector(nodes)
    if first is not None and not vector:
        return vector_rounds(vector_layer(nodes, NODE, first, relu=True), edges, steps, nodes if listed is None else listed)
    states = vector_to_array("state") if vector else F.col("state")
    top = nodes.select(F.size(states)).first()
    width = top[0] if top else 1
    ends = [F.col(c).cast("long").alias(c) for c in ("src_idx", "dst_idx")]
    links = edges.where(F.col("src_idx") != F.col("dst_idx")).select("news_id", *ends)
    kept = F.col("state") if vector else F.col("state").cast("array<double>").alias("state")
    nodes = nodes.select("news_id", F.col("node_idx").cast("long").alias("node_idx"), kept)
    # states are there twice while a linear map is applied
    room = width if all(s.layer is None for s in steps) else 2 * width
    if first is not None:
        room = max(width, 2 * first.weight.shape[0])
    large = _large(nodes if listed is None else listed, links, room)
    small_nodes, small_links = nodes, links
    some = not large.isEmpty()
    if some:
        told = F.broadcast(large) if is_small(large) else large
        small_nodes, small_links = nodes.join(told, "news_id", "left_anti"), links.join(told, "news_id", "left_anti")
    schema = T.StructType([*[nodes.schema[n] for n in NODE], T.StructField("state", T.ArrayType(T.DoubleType()))])
    run = _whole_stories(steps, width, None if first is None else Step(first, relu=True))
    sent = small_nodes if vector else _short(small_nodes)
    done = sent.groupBy("news_id").cogroup(small_links.groupBy("news_id")).applyInArrow(run, schema)
    if some:
        rest, rest_links = nodes.join(told, "news_id"), links.join(told, "news_id")
        if first is not None:
            return done.unionByName(vector_rounds(vector_layer(rest, NODE, first, relu=True), rest_links, steps, rest))
        merged = rest_links.groupBy("news_id", "src_idx", "dst_idx").agg(F.count(F.lit(1)).alias("n"))
        rest = _mapped(rest, NODE, lambda batch: matrix(batch.column("state"))) if vector else rest
        done = done.unionByName(_in_cells(rest, merged, steps))
    return done


def vector_propagate(nodes: DataFrame, edges: DataFrame, rounds: int = 1) -> DataFrame:
    """``rounds`` rounds of the normalised neighbour sum, without weights."""
    return vector_rounds(nodes, edges, [Step()] * rounds)


def vector_pool(nodes: DataFrame) -> DataFrame:
    """Per graph one ``state``: the mean of its nodes' states followed by their maximum."""
    both = Summarizer.metrics("mean", "max").summary(array_to_vector("state"))
    pooled = nodes.groupBy("news_id").agg(both.alias("_both"))
    return pooled.select("news_id", F.concat(vector_to_array("_both.mean"), vector_to_array("_both.max")).alias("state"))


def vector_states(nodes: DataFrame, edges: DataFrame, net: Network, last_relu: bool = True) -> DataFrame:
    """Node states after the last convolution of a network of normalised sums."""
    if net.convolution != "gcn":
        raise ValueError("array states run through normalised sums only")
    last = len(net.convolutions) - 1
    steps = [Step(layer, last_relu or k < last) for k, layer in enumerate(net.convolutions)]
    return vector_rounds(nodes.select(*NODE, "state"), edges, steps, listed=nodes, first=net.embedding)


def vector_infer(nodes: DataFrame, edges: DataFrame, net: Network) -> DataFrame:
    """The forward pass of a ``pooled`` network: log-probabilities, probability of fake and class per graph."""
    if net.kind != "pooled":
        raise ValueError("array states run through pooled networks only")
    pooled = vector_layer(vector_pool(vector_states(nodes, edges, net)), ["news_id"], net.projection)
    scores = vector_layer(pooled, ["news_id"], net.classifier)
    return classify(scores.select("news_id", F.col("state")[0].alias("z0"), F.col("state")[1].alias("z1")))
