"""Splits, classifiers on pooled graph features, model choice, storing and scoring."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import ceil

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplegraph.functions.scalars import coin
from ripplegraph.operators.metrics import f1_binary
from ripplegraph.session import materialise

# Fixed values of the training set-up.
TRAIN_SHARE = 0.8
VALIDATION_SHARE = 0.9
HIDDEN = 64
PATIENCE = 5
CHECK_EVERY = 2
# Rows of a hash slice of a class, ranked by one task.
SLICE_ROWS = 100_000


def stratified_split(graphs: DataFrame, seed: str = "42") -> DataFrame:
    """Assign ``train``, ``val`` or ``test`` in the ratio 80/10/10 within each label.

    A graph's place is its rank by hash within its label. As the hash is even, its leading bits cut a label
    into slices of about equal size, as many as the table needs: rows are ranked within a slice, and slice sizes
    give the rank before it. So two labels do not end up in two tasks, and the result doesn't depend on the slices.
    """
    slices = ceil(graphs.count() / SLICE_ROWS) or 1
    drawn = graphs.select("news_id", "label", coin("news_id", F.lit("split"), seed=seed).alias("_draw")).withColumn(
        "_slice", F.floor(F.col("_draw") * slices)
    )
    earlier = Window.partitionBy("label").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        drawn.groupBy("label", "_slice")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumns(
            {
                "_before": F.coalesce(F.sum("_n").over(earlier), F.lit(0).cast("long")),
                "_total": F.sum("_n").over(Window.partitionBy("label")),
            }
        )
        .drop("_n")
    )
    rank = F.row_number().over(Window.partitionBy("label", "_slice").orderBy("_draw", "news_id"))
    placed = drawn.withColumn("_rank", rank).join(sizes, ["label", "_slice"])
    place = (F.col("_before") + F.col("_rank") - 1).cast("double")
    part = (
        F.when(place < F.col("_total") * F.lit(TRAIN_SHARE), "train")
        .when(place < F.col("_total") * F.lit(VALIDATION_SHARE), "val")
        .otherwise("test")
    )
    return placed.select("news_id", "label", part.alias("split"))


def _pipeline(names: list[str], classifier: Estimator) -> Pipeline:
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=names, outputCol="raw", handleInvalid="error"),
            StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True),
            classifier,
        ]
    )


def perceptron(inputs: int, steps: int = 30, hidden: int = HIDDEN, seed: int = 42) -> Estimator:
    return MultilayerPerceptronClassifier(
        featuresCol="scaled", labelCol="label", layers=[inputs, hidden, 2], maxIter=steps, seed=seed
    )


def logistic(steps: int = 30) -> Estimator:
    return LogisticRegression(featuresCol="scaled", labelCol="label", maxIter=steps)


def fit_structure(train: DataFrame, names: list[str], classifier: Estimator | None = None) -> PipelineModel:
    """Fit a classifier on pooled graph features (columns ``names`` and ``label``)."""
    return _pipeline(names, classifier or perceptron(len(names))).fit(train)


def fit_structure_text(
    train: DataFrame, names: list[str], embedding: str, classifier: Estimator | None = None, width: int | None = None
) -> PipelineModel:
    """As :func:`fit_structure`, on pooled features followed by a vector column."""
    if classifier is None:
        if width is None:
            raise ValueError("give the width of the embedding or a classifier")
        classifier = perceptron(len(names) + width)
    return _pipeline([*names, embedding], classifier).fit(train)


def predict_graphs(model: PipelineModel, graphs: DataFrame, name: str) -> DataFrame:
    """Score graphs into ``news_id, model, label, log_p_real, log_p_fake, p_real, p_fake, pred``; ties give class 0."""
    p = vector_to_array("probability")
    scored = model.transform(graphs).select(
        "news_id", F.lit(name).alias("model"), "label", p[0].alias("p_real"), p[1].alias("p_fake")
    )
    return scored.withColumns(
        {
            # the smallest double in place of 0, of which there is no logarithm
            "log_p_real": F.log(F.greatest("p_real", F.lit(5e-324))),
            "log_p_fake": F.log(F.greatest("p_fake", F.lit(5e-324))),
            "pred": F.when(F.col("p_fake") > F.col("p_real"), 1).otherwise(0),
        }
    )


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def select_by_val_f1(
    candidates: DataFrame, patience: int = PATIENCE, check_every: int = CHECK_EVERY
) -> DataFrame:
    """The step each run keeps: the strictly best validation F1 before ``patience`` checks in a row fail to improve.

    ``candidates`` has ``run, step, val_f1``, one row per step; every ``check_every``-th step from 0 is checked.
    """
    order = Window.partitionBy("run").orderBy("step")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    improved = F.col("val_f1") > F.coalesce(F.max("val_f1").over(before), F.lit(0.0))
    checked = (
        candidates.where(F.col("step") % check_every == 0)
        .withColumn("check_no", F.row_number().over(order))
        .withColumn("improved", improved)
        .withColumn(
            "failures",
            F.col("check_no") - F.coalesce(F.max(F.when(F.col("improved"), F.col("check_no"))).over(so_far), F.lit(0)),
        )
        .withColumn("_stop", F.min(F.when(F.col("failures") >= patience, F.col("check_no"))).over(Window.partitionBy("run")))
    )
    ran = checked.where(F.col("_stop").isNull() | (F.col("check_no") <= F.col("_stop")))
    return ran.groupBy("run").agg(
        F.max(F.when(F.col("improved"), F.col("step"))).alias("best_step"),
        F.max(F.when(F.col("improved"), F.col("val_f1"))).alias("best_f1"),
        F.count(F.lit(1)).alias("checks"),
        F.max(F.when(F.col("check_no") == F.col("_stop"), F.col("step"))).alias("stopped_at"),
    )


@dataclass(frozen=True)
class Candidate:
    step: int
    model: PipelineModel
    val_f1: float


def fit_candidates(
    train: DataFrame, val: DataFrame, names: list[str], classifiers: list[Estimator]
) -> list[Candidate]:
    """Fit each classifier and score it on the validation part (one figure per candidate)."""
    found = []
    for step, classifier in enumerate(classifiers):
        model = fit_structure(train, names, classifier)
        score = f1_binary(predict_graphs(model, val, "candidate")).first()
        found.append(Candidate(step, model, score.f1 if score else 0.0))
    return found


def best_candidate(train: DataFrame, candidates: list[Candidate], patience: int = PATIENCE) -> Candidate:
    """The candidate kept by :func:`select_by_val_f1`, every one of them checked; the first if all have a validation F1 of 0."""
    spark = train.sparkSession
    table = spark.createDataFrame([("run", c.step, c.val_f1) for c in candidates], "run string, step int, val_f1 double")
    kept = select_by_val_f1(table, patience, check_every=1).first()
    return next((c for c in candidates if kept is not None and c.step == kept.best_step), candidates[0])


@dataclass(frozen=True)
class Staged:
    """A model fitted in stages: the one kept, its step (null if none had a validation F1 above 0, then the first is kept),
    and the validation F1 of every step that was checked. ``stopped_at`` is null if the fit went on to the last step."""

    model: PipelineModel
    best_step: int | None
    stopped_at: int | None
    history: list[tuple[int, float]]


def validation_f1(predictions: DataFrame) -> float:
    found = f1_binary(predictions).first()
    return found.f1 if found else 0.0


def fit_staged(
    train: DataFrame,
    val: DataFrame,
    names: list[str],
    width: int | None = None,
    steps: int = 30,
    hidden: int = HIDDEN,
    patience: int = PATIENCE,
    check_every: int = CHECK_EVERY,
    seed: int = 42,
    score: Callable[[DataFrame], float] = validation_f1,
) -> Staged:
    """A perceptron trained on until its validation F1 no longer rises.

    ``names`` are columns of numbers or vectors, ``width`` their numbers in all where that is more than the columns. The first
    stage takes one step, later ones ``check_every`` each and start from the weights of the one before. After each stage the
    validation part is scored; :func:`select_by_val_f1` says which step is kept and when to stop. Inputs are scaled by the
    train part and stored once.
    """
    spark = train.sparkSession
    assembler = VectorAssembler(inputCols=names, outputCol="raw", handleInvalid="error")
    scaler = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True).fit(assembler.transform(train))
    prepared = PipelineModel(stages=[assembler, scaler])
    train_rows = materialise(prepared.transform(train).select("scaled", F.col("label").cast("double").alias("label")), "train")
    val_rows = materialise(prepared.transform(val).select("news_id", "label", "scaled"), "val")
    inputs = len(names) if width is None else width
    models, history, weights, kept, best_check = {}, [], None, None, 0
    for step in range(0, steps, check_every):
        classifier = perceptron(inputs, check_every if step else 1, hidden, seed)
        if weights is not None:
            classifier.setInitialWeights(weights)
        models[step] = fitted = classifier.fit(train_rows)
        weights = fitted.weights
        history.append((step, float(score(predict_graphs(PipelineModel(stages=[fitted]), val_rows, "candidate")))))
        # A fit stops ``patience`` checks after the best one at the earliest; the rule isn't asked before.
        if len(history) < best_check + patience and step + check_every < steps:
            continue
        table = spark.createDataFrame([("run", *row) for row in history], "run string, step int, val_f1 double")
        kept = select_by_val_f1(table, patience, check_every).first()
        if kept.stopped_at is not None:
            break
        best_check = 0 if kept.best_step is None else kept.best_step // check_every + 1
    best = models[0 if kept.best_step is None else kept.best_step]
    return Staged(PipelineModel(stages=[assembler, scaler, best]), kept.best_step, kept.stopped_at, history)


def staged_records(staged: Staged, model: str, run: str, spark: SparkSession) -> DataFrame:
    """How a staged fit went, as records ``run, model, metric, value``: the step kept, its F1, the checks made."""
    best = max([f1 for step, f1 in staged.history if step == staged.best_step], default=0.0)
    found = {"kept_step": staged.best_step, "validation_f1": best, "checks": len(staged.history)}
    rows = [(run, model, k, None if v is None else float(v)) for k, v in found.items()]
    return spark.createDataFrame(rows, "run string, model string, metric string, value double")


def split_sizes(split: DataFrame) -> DataFrame:
    """Graphs per label and part."""
    return split.groupBy("label", "split").agg(F.count(F.lit(1)).alias("graphs"))


def labelled_parts(features: DataFrame) -> dict[str, DataFrame]:
    """The train, val and test parts of feature rows that carry their ``label`` and ``split``."""
    return {part: features.where(F.col("split") == part).drop("split") for part in ("train", "val", "test")}
