"""Quality rules: fixed limits on word statistics, and an isolation forest for documents that are odd in a combination.

Trees split a bounded sample of the statistics at random places, more often by the statistics in which labelled good and bad
rows differ. A document that ends after few splits is an anomaly. The
limit is calibrated on labelled rows: it lies where at most ``loss`` of the good documents would be rejected and
rejected labelled documents are mostly bad ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ripplegraph.llm import common, stats
from ripplegraph.session import materialise

TREES, LEAF_SAMPLE, SAMPLE = 128, 256, 20_000
LOSS, BINS = 0.002, 4_096


@dataclass(frozen=True)
class Forest:
    """Trees as arrays of nodes: feature (-1 in a leaf), split value, children, and the leaf's path length."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    right: np.ndarray
    path: np.ndarray
    norm: float


def rates(counts: dict[str, np.ndarray]) -> np.ndarray:
    """What the forest looks at: statistics as shares, so that long documents aren't odd for their length."""
    c = {n: v.astype(float) for n, v in counts.items()}
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["n_chars"], 1), np.maximum(c["n_lines"], 1)
    return np.column_stack(
        [
            c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / lines, c["n_repeat_words"] / words,
            c["n_upper"] / chars, c["n_digit"] / chars, c["n_punct"] / chars,
            np.log1p(c["n_distinct_words"]) / np.log1p(words),
        ]
    )


def _mean_path(n: float) -> float:
    """Mean path length of a failed search in a binary tree of n entries."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2.0 * (np.log(n - 1) + np.euler_gamma) - 2.0 * (n - 1) / n


def grow(rows: np.ndarray, weights: np.ndarray | None = None, trees: int = TREES, each: int = LEAF_SAMPLE, seed: int = 7) -> Forest:
    """An isolation forest on ``rows``, of which the columns are split as often as ``weights`` say.

    The same rows in the same order give the same forest.
    """
    rng = np.random.default_rng(seed)
    weights = np.ones(rows.shape[1]) if weights is None else weights
    each = min(each, len(rows))
    limit = int(np.ceil(np.log2(max(each, 2))))
    nodes: list[list[tuple]] = []
    for _ in range(trees):
        own: list[tuple] = []

        def build(part: np.ndarray, depth: int) -> int:
            at = len(own)
            own.append((-1, 0.0, 0, 0, depth + _mean_path(len(part))))
            low, high = (part.min(axis=0), part.max(axis=0)) if len(part) else (np.zeros(1), np.zeros(1))
            wide = np.flatnonzero(high > low)
            if depth < limit and len(part) > 1 and len(wide):
                f = int(rng.choice(wide, p=weights[wide] / weights[wide].sum()))
                value = rng.uniform(low[f], high[f])
                below = part[:, f] <= value
                own[at] = (f, value, build(part[below], depth + 1), build(part[~below], depth + 1), 0.0)
            return at

        build(rows[rng.choice(len(rows), each, replace=False)], 0)
        nodes.append(own)
    size = max(map(len, nodes))
    column = lambda k, kind: np.array([[x[k] for x in own] + [-1 if k == 0 else 0] * (size - len(own)) for own in nodes], kind)
    return Forest(column(0, np.int64), column(1, float), column(2, np.int64), column(3, np.int64), column(4, float), max(_mean_path(each), 1e-9))


def anomaly(forest: Forest, rows: np.ndarray) -> np.ndarray:
    """Score from 0 to 1: the shorter the mean path, the nearer to 1."""
    total = np.zeros(len(rows))
    every = np.arange(len(rows))
    for t in range(len(forest.feature)):
        node = np.zeros(len(rows), np.int64)
        while True:
            feature = forest.feature[t, node]
            going = feature >= 0
            if not going.any():
                break
            left = rows[every, np.maximum(feature, 0)] <= forest.split[t, node]
            node = np.where(going, np.where(left, forest.left[t, node], forest.right[t, node]), node)
        total += forest.path[t, node]
    return 2.0 ** (-total / len(forest.feature) / forest.norm)


def separation(sums: np.ndarray) -> np.ndarray:
    """How far the two qualities lie apart in each column: squared distance of the means over the variance.

    ``sums`` has a row for each quality: number, sums and sums of squares. Equal weights where a quality is absent.
    """
    columns = (sums.shape[1] - 1) // 2
    if (sums[:, 0] == 0).any():
        return np.ones(columns)
    mean = sums[:, 1 : 1 + columns] / sums[:, :1]
    spread = sums[:, 1 + columns :] / sums[:, :1] - mean**2
    found = (mean[0] - mean[1]) ** 2 / np.maximum(spread.mean(axis=0), 1e-12)
    return found / max(found.sum(), 1e-12) + 1e-3


def calibrated(labelled: DataFrame, loss: float = LOSS) -> int:
    """The smallest class of ``anomaly`` from which rejecting loses at most the share ``loss`` of rows with quality 1.

    Of what lies above it, most must have quality 0, else it is raised. Without labelled rows nothing is rejected.
    Rows are counted in BINS classes of the score, all labelled rows.
    """
    bins = labelled.groupBy(F.floor(F.col("anomaly") * BINS).alias("bin")).agg(
        F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad")
    )
    rows = sorted(tuple(r) for r in bins.collect())  # at most BINS + 1 rows
    total, good, bad, limit = sum(r[1] for r in rows), 0, 0, BINS + 1
    for at, g, b in reversed(rows):
        good, bad = good + g, bad + b
        if good > loss * total:
            break
        if bad > good:
            limit = at
    return limit


@dataclass(frozen=True)
class Rules:
    """A grown forest (None: rejects nothing) and the class of the anomaly score from which documents are rejected."""

    forest: Forest | None
    limit: int

    def kept(self, counts: dict[str, np.ndarray]) -> np.ndarray:
        good = ~failed(counts)
        if self.forest is not None:
            some = np.flatnonzero(good)
            found = anomaly(self.forest, rates({n: v[some] for n, v in counts.items()}))
            good[some] = np.floor(found * BINS) < self.limit
        return good


def failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    """The fixed rules: fewer than 50 words, or more than half of the words in repeated windows."""
    return (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])


def _counts(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {n: batch[n].to_numpy(zero_copy_only=False) for n in stats.COUNTS + stats.MORE}


def fit(counted: DataFrame, labels: DataFrame, loss: float = LOSS) -> Rules:
    """Grow the forest on at most SAMPLE documents that pass the fixed rules, those with the smallest hash of doc_id.

    ``counted`` has doc_id and the statistics. The limit is calibrated on all labelled documents that pass.
    """
    names = stats.COUNTS + stats.MORE
    passed = counted.where("not (n_words < 50 or 100 * n_repeat_words > 50 * n_words)")
    place = F.xxhash64(F.lit(11), "doc_id")
    # Hashes are even, so about twice the sample lies below this bound: without it each task would send a whole sample.
    bound = -(1 << 63) + int(min(1.0, 2.0 * SAMPLE / max(passed.count(), 1)) * (1 << 64))
    near = passed.where(place < F.lit(bound)) if bound < 1 << 63 else passed
    sample = near.orderBy(place, "doc_id", *names).limit(SAMPLE).select(*names).toPandas()
    if sample.empty:
        return Rules(None, BINS + 1)
    known = labels.where("quality in (0, 1)").select("doc_id", "quality")
    labelled = materialise(passed.join(known, "doc_id").select("quality", *names), "labelled")

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x, quality = rates(_counts(batch)), batch["quality"].to_numpy(zero_copy_only=False)
        parts = [x[quality == q] for q in (0, 1)]
        return np.concatenate([np.concatenate([[len(p)], p.sum(axis=0), (p * p).sum(axis=0)]) for p in parts])

    sums = common.partition_sums(labelled, moments)
    weights = None if sums is None else separation(sums.reshape(2, -1))
    forest = grow(rates({n: sample[n].to_numpy() for n in names}), weights)
    shared = counted.sparkSession.sparkContext.broadcast(forest)  # TREES times at most 2 * LEAF_SAMPLE nodes

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = anomaly(shared.value, rates(_counts(batch)))
            yield pa.RecordBatch.from_arrays([pa.array(found), batch["quality"].cast(pa.int64())], ["anomaly", "quality"])

    return Rules(forest, calibrated(labelled.mapInArrow(score, "anomaly double, quality long"), loss))


def judged(docs: DataFrame, labels: DataFrame, loss: float = LOSS) -> DataFrame:
    """Every document with its statistics, ``base_failed`` and ``kept``.

    ``docs`` has doc_id and text, ``labels`` doc_id and quality (1 good, 0 bad; others and nulls are left out); further columns
    are ignored. A null or empty text has no words, so it fails the fixed rules. Rows are judged one by one: equal rows
    get equal results, a null doc_id is judged but meets no label. An empty table gives no rows; without labels, or if all
    documents fail the fixed rules, the forest rejects nothing.
    """
    counted = materialise(stats.with_statistics(docs), "statistics")
    shared = docs.sparkSession.sparkContext.broadcast(fit(counted, labels, loss))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = _counts(batch)
            yield batch.append_column("base_failed", pa.array(failed(counts))).append_column("kept", pa.array(shared.value.kept(counts)))

    schema = StructType([*counted.schema, StructField("base_failed", BooleanType()), StructField("kept", BooleanType())])
    return counted.mapInArrow(judge, schema)


def filtered(docs: DataFrame, labels: DataFrame, loss: float = LOSS) -> DataFrame:
    """The rows of ``docs`` that ``judged`` keeps, with all their columns. Texts are read twice and never exchanged."""
    counted = materialise(stats.with_statistics(docs), "statistics")
    shared = docs.sparkSession.sparkContext.broadcast(fit(counted, labels, loss))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.kept(stats.text_statistics(common.as_bytes(batch[text])))))

    # under plain names: a task takes no columns with dots in their names
    text, plain = f"x{docs.columns.index('text')}", docs.toDF(*[f"x{k}" for k in range(len(docs.columns))])
    return plain.mapInArrow(keep, plain.schema).toDF(*docs.columns)
