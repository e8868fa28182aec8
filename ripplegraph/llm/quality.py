"""Quality scores: ridge regression on random Fourier features of text statistics, calibrated to be monotone.

Random Fourier features approximate a Gaussian kernel on the standardised statistics. Every partition sums its part of
the normal equations; the sums of partitions are added in groups and then on the driver, which solves one small system.
Scores are then made probabilities by isotonic regression on classes of the raw score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.llm import common, rules, stats
from ripplegraph.session import materialise

FEATURES, WIDTH, RIDGE, BINS = 192, 2.0, 1e-3, 2_000


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    spread: np.ndarray
    waves: np.ndarray
    shifts: np.ndarray
    weights: np.ndarray
    steps: np.ndarray
    levels: np.ndarray


def inputs(counts: dict[str, np.ndarray]) -> np.ndarray:
    """Shares of the statistics, and the logarithm of the length."""
    return np.column_stack([rules.rates(counts), np.log1p(counts["n_words"].astype(float))])


def _counts(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {n: batch[n].to_numpy(zero_copy_only=False) for n in stats.COUNTS + stats.MORE}


def lifted(x: np.ndarray, model: QualityModel) -> np.ndarray:
    z = np.clip((x - model.mean) / model.spread, -6.0, 6.0)
    waves = np.sqrt(2.0 / FEATURES) * np.cos(z @ model.waves + model.shifts)
    return np.column_stack([waves, z, np.ones(len(z))])


def raw_scores(x: np.ndarray, model: QualityModel) -> np.ndarray:
    return lifted(x, model) @ model.weights


def pooled(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to ``values``: neighbours that fall are replaced by their mean."""
    blocks: list[list[float]] = []
    for v, w in zip(values.tolist(), weights.tolist()):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def fit(labelled: DataFrame, seed: int = 5) -> QualityModel | None:
    """A model from all rows of ``labelled``: the statistics and ``quality`` (0 or 1). None without rows."""
    d = 9

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = inputs(_counts(batch))
        return np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])

    found = common.partition_sums(labelled, moments)
    if found is None:
        return None
    n, mean = found[0], found[1 : 1 + d] / found[0]
    spread = np.sqrt(np.maximum(found[1 + d :] / n - mean**2, 0.0))
    rng = np.random.default_rng(seed)
    none = np.zeros(0)
    plain = QualityModel(
        mean, np.where(spread > 1e-9, spread, 1.0), rng.normal(0, 1 / WIDTH, (d, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES), none, none, none
    )
    size = FEATURES + d + 1

    def normal(batch: pa.RecordBatch) -> np.ndarray:
        z, y = lifted(inputs(_counts(batch)), plain), batch["quality"].to_numpy(zero_copy_only=False).astype(float)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    sums = common.partition_sums(labelled, normal)
    gram, right = sums[: size * size].reshape(size, size), sums[size * size :]
    weights = np.linalg.solve(gram + RIDGE * n * np.eye(size) / size, right)
    solved = QualityModel(plain.mean, plain.spread, plain.waves, plain.shifts, weights, none, none)

    def classes(batch: pa.RecordBatch) -> np.ndarray:
        at = _class(raw_scores(inputs(_counts(batch)), solved))
        y = batch["quality"].to_numpy(zero_copy_only=False).astype(float)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, y, minlength=BINS)])

    seen = common.partition_sums(labelled, classes)
    count, good = seen[:BINS], seen[BINS:]
    filled = np.flatnonzero(count)
    levels = pooled(good[filled] / count[filled], count[filled])
    return QualityModel(plain.mean, plain.spread, plain.waves, plain.shifts, weights, (filled + 0.5) / BINS * 2 - 0.5, levels)


def _class(raw: np.ndarray) -> np.ndarray:
    return np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int64)


def scored(docs: DataFrame, labels: DataFrame, limit: float = 0.7) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 where score >= ``limit``) of every document, learned from ``labels``.

    ``docs`` has doc_id and text, ``labels`` doc_id and quality; rows of other values than 0 and 1 are left out, and so are all
    further columns. All labelled documents are used to fit; those to hold out must not be among ``labels``. Null and
    empty texts get a score from their statistics (no words). Rows are scored one by one: equal rows get equal scores.
    Without any label the score is 0.5. An empty table gives no rows.
    """
    counted = materialise(stats.with_statistics(docs), "statistics")
    known = labels.where("quality in (0, 1)").select("doc_id", "quality")
    labelled = materialise(counted.join(known, "doc_id"), "labelled")
    model = fit(labelled)
    if model is None:
        return counted.select("doc_id", F.lit(0.5).alias("score"), F.lit(int(limit <= 0.5)).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = raw_scores(inputs(_counts(batch)), shared.value)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.interp(raw, shared.value.steps, shared.value.levels))], ["doc_id", "score"])

    rows = counted.mapInArrow(score, "doc_id long, score double")
    return rows.withColumn("predicted", (F.col("score") >= limit).cast("int"))
