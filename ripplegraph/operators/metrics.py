"""Evaluation of predictions ``news_id, model, label, p_real, p_fake, pred``; everything per model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.functions.scalars import ratio
from ripplegraph.plans.ordering import running_sums

CLASSES = (0, 1)
FAKE = 1
SMALLEST = 1e-15
REPORT_COLUMNS = ["model", "entry", "precision", "recall", "f1", "support"]


def _n(condition: Column) -> Column:
    return F.count_if(condition)


def _is(name: str, value: int) -> Column:
    return F.col(name) == value


def _accuracy() -> Column:
    return F.avg((F.col("pred") == F.col("label")).cast("double"))


def _f1() -> Column:
    hits = _n(_is("label", FAKE) & _is("pred", FAKE))
    return ratio(2.0 * hits, _n(_is("pred", FAKE)) + _n(_is("label", FAKE)), 0.0)


def _log_loss(floor: float) -> Column:
    likelihood = F.when(_is("label", FAKE), F.col("p_fake")).otherwise(F.col("p_real"))
    return F.avg(-F.log(F.greatest(likelihood, F.lit(floor))))


def accuracy(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("model").agg(_accuracy().alias("accuracy"))


def f1_binary(predictions: DataFrame) -> DataFrame:
    """Precision, recall and F1 of class 1; 0 where undefined."""
    hits = _n(_is("label", FAKE) & _is("pred", FAKE))
    return predictions.groupBy("model").agg(
        ratio(hits, _n(_is("pred", FAKE)), 0.0).alias("precision"),
        ratio(hits, _n(_is("label", FAKE)), 0.0).alias("recall"),
        _f1().alias("f1"),
    )


def auc(predictions: DataFrame) -> DataFrame:
    """Area under the ROC curve; equal scores count half. Null with only one class.

    Scores are counted per distinct value first. The share of pairs ranked right then follows from the
    number of negatives below each value, a running sum that also works when one model has too many
    distinct scores for one task.
    """
    per_score = predictions.groupBy("model", F.col("p_fake").alias("score")).agg(
        F.count_if(_is("label", FAKE)).alias("pos"), F.count_if(~_is("label", FAKE)).alias("neg")
    )
    below = running_sums(per_score, ["model"], ["score"], {"neg_below": F.col("neg")})
    won = F.col("pos") * (F.col("neg_below").cast("double") + F.col("neg") / F.lit(2.0))
    return (
        below.groupBy("model")
        .agg(F.sum(won).alias("_won"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
        .select(
            "model",
            "positives",
            "negatives",
            ratio(F.col("_won"), F.col("positives").cast("double") * F.col("negatives")).alias("auc"),
        )
    )


def confusion_matrix(predictions: DataFrame) -> DataFrame:
    """Counts per (model, label, pred); empty cells are present."""
    cells = [(a, p) for a in CLASSES for p in CLASSES]
    counted = predictions.groupBy("model").agg(
        *[_n(_is("label", a) & _is("pred", p)).alias(f"c{a}{p}") for a, p in cells]
    )
    rows = F.array(
        *[F.struct(F.lit(a).alias("label"), F.lit(p).alias("pred"), F.col(f"c{a}{p}").alias("n")) for a, p in cells]
    )
    return counted.select("model", F.inline(rows))


def classification_report(predictions: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy, and macro and weighted means."""
    cells = confusion_matrix(predictions).groupBy("model").agg(
        *[
            F.sum(F.when(_is("label", a) & _is("pred", p), F.col("n"))).alias(f"c{a}{p}")
            for a in CLASSES
            for p in CLASSES
        ]
    )
    measures = {}
    for c in CLASSES:
        other = 1 - c
        hit = F.col(f"c{c}{c}")
        measures[f"support{c}"] = F.col(f"c{c}{c}") + F.col(f"c{c}{other}")
        measures[f"precision{c}"] = ratio(hit, hit + F.col(f"c{other}{c}"), 0.0)
        measures[f"recall{c}"] = ratio(hit, hit + F.col(f"c{c}{other}"), 0.0)
        measures[f"f1{c}"] = ratio(2.0 * hit, 2 * hit + F.col(f"c{other}{c}") + F.col(f"c{c}{other}"), 0.0)
    wide = cells.withColumns(measures).withColumn("support", F.col("support0") + F.col("support1"))
    right = ratio(F.col("c00") + F.col("c11"), F.col("support"))

    def mean(name: str, weighted: bool) -> Column:
        if not weighted:
            return (F.col(f"{name}0") + F.col(f"{name}1")) / F.lit(2.0)
        total = F.col(f"{name}0") * F.col("support0") + F.col(f"{name}1") * F.col("support1")
        return ratio(total, F.col("support"))

    def row(entry: str, precision: Column, recall: Column, f1: Column, support: str) -> Column:
        values = [F.lit(entry), precision, recall, f1, F.col(support)]
        return F.struct(*[v.alias(n) for v, n in zip(values, REPORT_COLUMNS[1:])])

    entries = [row(str(c), *[F.col(f"{m}{c}") for m in ("precision", "recall", "f1")], f"support{c}") for c in CLASSES]
    entries.append(row("accuracy", right, right, right, "support"))
    for label, weighted in (("macro avg", False), ("weighted avg", True)):
        entries.append(row(label, *[mean(m, weighted) for m in ("precision", "recall", "f1")], "support"))
    return wide.select("model", F.inline(F.array(*entries)))


def log_loss(predictions: DataFrame, floor: float = SMALLEST) -> DataFrame:
    """Mean negative log-likelihood of the true class; probabilities are kept off 0."""
    return predictions.groupBy("model").agg(_log_loss(floor).alias("log_loss"))


def metric_records(predictions: DataFrame, run: str) -> DataFrame:
    """Accuracy, F1, AUC and log loss as records ``run, model, metric, value``."""
    plain = {"accuracy": _accuracy(), "f1": _f1(), "log_loss": _log_loss(SMALLEST)}
    together = predictions.groupBy("model").agg(*[c.alias(n) for n, c in plain.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in plain])
    curve = auc(predictions).select("model", F.lit("auc").alias("metric"), F.col("auc").alias("value"))
    records = together.select("model", F.inline(rows)).unionByName(curve)
    return records.select(F.lit(run).alias("run"), "model", "metric", "value")


def relative_gain(metrics: DataFrame, base: str, other: str) -> DataFrame:
    """Gain of one model's metrics over another's, absolute and in percent of the base."""
    value = {m: F.max(F.when(F.col("model") == m, F.col("value"))) for m in (base, other)}
    both = metrics.where(F.col("model").isin(base, other)).groupBy("run", "metric").agg(
        value[base].alias("base"), value[other].alias("other")
    )
    gain = F.col("other") - F.col("base")
    return both.withColumns({"gain": gain, "gain_pct": ratio(gain, F.col("base")) * 100})
