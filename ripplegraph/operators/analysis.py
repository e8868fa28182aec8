"""What predictions say about the models and the features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplegraph.functions.scalars import ratio
from ripplegraph.operators.metrics import classification_report

# Fixed thresholds of the confidence analysis.
HIGH_CONFIDENCE = 0.9
BANDS = ((0.9, ">90"), (0.7, "70-90"), (0.5, "50-70"))
RATIO_GUARD = 0.001
BINS = 20


def _pairs(predictions: DataFrame, a: str, b: str) -> DataFrame:
    """One row per item that both models predicted."""
    sides = predictions.where(F.col("model").isin(a, b)).groupBy("news_id").agg(
        F.max(F.when(F.col("model") == a, F.col("pred"))).alias("pred_a"),
        F.max(F.when(F.col("model") == b, F.col("pred"))).alias("pred_b"),
        F.max("label").alias("label"),
    )
    return sides.where(F.col("pred_a").isNotNull() & F.col("pred_b").isNotNull())


def model_agreement(predictions: DataFrame, a: str, b: str) -> DataFrame:
    """How often two models agree and differ, as counts and percentages."""
    counted = _pairs(predictions, a, b).agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(F.col("pred_a") == F.col("pred_b")).alias("agree")
    )
    cases = F.col("cases")
    return counted.select(
        "cases",
        "agree",
        (cases - F.col("agree")).alias("disagree"),
        (ratio(F.col("agree"), cases) * 100).alias("agree_pct"),
        (ratio(cases - F.col("agree"), cases) * 100).alias("disagree_pct"),
    )


def disagreement_cases(predictions: DataFrame, a: str, b: str, k: int = 5) -> DataFrame:
    """The first ``k`` items on which the models differ."""
    differing = _pairs(predictions, a, b).where(F.col("pred_a") != F.col("pred_b"))
    return differing.orderBy("news_id").limit(k).select("news_id", "pred_a", "pred_b", "label")


def disagreement_direction(predictions: DataFrame, a: str, b: str) -> DataFrame:
    """Who says what when the models differ."""
    differing = _pairs(predictions, a, b).where(F.col("pred_a") != F.col("pred_b"))
    return differing.groupBy("pred_a", "pred_b").agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(F.col("pred_a") == F.col("label")).alias("a_right")
    )


def high_confidence(predictions: DataFrame) -> DataFrame:
    """How many items a model is very sure about."""
    return predictions.groupBy("model").agg(
        F.count_if(F.col("p_fake") > HIGH_CONFIDENCE).alias("sure_fake"),
        F.count_if(F.col("p_real") > HIGH_CONFIDENCE).alias("sure_real"),
    )


def confidence_bands(predictions: DataFrame) -> DataFrame:
    """Items per confidence band and predicted class. A band's lower edge is outside the band."""
    sure = F.when(F.col("pred") == 1, F.col("p_fake")).otherwise(F.col("p_real"))
    band = F.lit(None).cast("string")
    for edge, name in reversed(BANDS):
        band = F.when(sure > edge, name).otherwise(band)
    counted = predictions.withColumn("_band", band).groupBy("model").agg(
        *[
            F.count_if((F.col("_band") == name) & (F.col("pred") == c)).alias(f"n{i}_{c}")
            for i, (_, name) in enumerate(BANDS)
            for c in (0, 1)
        ]
    )
    rows = [
        F.struct(
            F.lit(name).alias("band"), F.col(f"n{i}_1").alias("fake_predictions"), F.col(f"n{i}_0").alias("real_predictions")
        )
        for i, (_, name) in enumerate(BANDS)
    ]
    return counted.select("model", F.inline(F.array(*rows)))


def _unpivot(df: DataFrame, keys: list[str], names: list[str], measures: list[str]) -> DataFrame:
    """One row per feature from columns ``<measure>_<feature>``."""
    rows = [
        F.struct(F.lit(n).alias("feature"), F.lit(i).alias("feature_no"), *[F.col(f"{m}_{n}").alias(m) for m in measures])
        for i, n in enumerate(names)
    ]
    return df.select(*keys, F.inline(F.array(*rows)))


def feature_ratio(scored: DataFrame, names: list[str]) -> DataFrame:
    """Mean feature in the sure-fake and the sure-real items and their ratio; null where either set is empty."""
    sure_fake, sure_real = F.col("p_fake") > HIGH_CONFIDENCE, F.col("p_real") > HIGH_CONFIDENCE
    means = []
    for n in names:
        means += [F.avg(F.when(sure_fake, F.col(n))).alias(f"fake_{n}"), F.avg(F.when(sure_real, F.col(n))).alias(f"real_{n}")]
    long = _unpivot(scored.groupBy("model").agg(*means), ["model"], names, ["fake", "real"])
    return long.drop("feature_no").withColumn("ratio", ratio(F.col("fake"), F.col("real") + F.lit(RATIO_GUARD)))


def relative_proportion(ratios: DataFrame) -> DataFrame:
    """The two means of a feature as shares of their sum."""
    total = F.col("fake") + F.col("real")
    return ratios.withColumns(
        {"fake_share": ratio(F.col("fake"), total), "real_share": ratio(F.col("real"), total)}
    )


def ratio_direction(ratios: DataFrame) -> DataFrame:
    """Which class has more of a feature, and the ratio as it is shown (``N/A`` for 0)."""
    shown = F.when(F.col("ratio") > 0, F.format_string("%.2fx", "ratio")).otherwise("N/A")
    return ratios.withColumns({"leans": F.when(F.col("ratio") > 1, "fake").otherwise("real"), "shown": shown})


def confidence_histogram(predictions: DataFrame, bins: int = BINS) -> DataFrame:
    """Histogram of the true class's probability, per model and class, over ``bins`` equal bins from least to most.

    The last bin is closed. Equal values all fall into one bin of a unit-wide range around them.
    """
    p = F.when(F.col("label") == 1, F.col("p_fake")).otherwise(F.col("p_real"))
    scored = predictions.select("model", "label", p.alias("p"))
    one_value = F.col("least") == F.col("most")
    ranges = (
        scored.groupBy("model", "label")
        .agg(F.min("p").alias("least"), F.max("p").alias("most"))
        .select(
            "model",
            "label",
            F.when(one_value, F.col("least") - 0.5).otherwise(F.col("least")).alias("low"),
            F.when(one_value, F.lit(1.0)).otherwise(F.col("most") - F.col("least")).alias("_width"),
        )
        .withColumn("step", F.col("_width") / F.lit(float(bins)))
        .drop("_width")
    )
    # Two classes per model: a handful of rows, whatever the size of the predictions.
    placed = scored.join(F.broadcast(ranges), ["model", "label"]).withColumn(
        "bin", F.least(F.floor((F.col("p") - F.col("low")) / F.col("step")), F.lit(bins - 1)).cast("int")
    )
    counted = placed.groupBy("model", "label", "bin").agg(F.count(F.lit(1)).alias("n"))
    grid = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(counted, ["model", "label", "bin"], "left").select(
        "model", "label", "bin", (F.col("low") + F.col("bin") * F.col("step")).alias("left_edge"),
        F.coalesce("n", F.lit(0).cast("long")).alias("n"),
    )


def feature_importance(scored: DataFrame, names: list[str], target: str = "pred") -> DataFrame:
    """Absolute correlation of each feature with the prediction, ranked; 0 for a constant feature."""
    y = F.col(target).cast("double")

    def correlation(n: str) -> Column:
        x = F.col(n).cast("double")
        spread = F.stddev_pop(x) * F.stddev_pop(y)
        found = F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0))
        return F.coalesce(F.abs(F.when(~F.isnan(found), found)), F.lit(0.0)).alias(f"importance_{n}")

    wide = scored.groupBy("model").agg(*[correlation(n) for n in names])
    return rank_features(_unpivot(wide, ["model"], names, ["importance"]))


def rank_features(importances: DataFrame) -> DataFrame:
    """Rank features by importance; of equals the one with the higher number comes first."""
    order = Window.partitionBy("model").orderBy(F.desc("importance"), F.desc("feature_no"))
    return importances.withColumn("rank", F.row_number().over(order)).select("model", "feature", "importance", "rank")


def error_vs_correct(scored: DataFrame, names: list[str]) -> DataFrame:
    """Mean features of the wrong and of the right predictions."""
    wrong = (F.col("pred") != F.col("label")).alias("is_error")
    return scored.groupBy("model", wrong).agg(
        F.count(F.lit(1)).alias("cases"), *[F.avg(n).alias(n) for n in names]
    )


def _sides(per_model: DataFrame, a: str, b: str, measures: dict[str, Column]) -> DataFrame:
    """One row per measure with the values of two models; null for a model that has none."""
    sides = per_model.agg(
        *[
            F.max(F.when(F.col("model") == m, value)).cast("double").alias(f"{s}_{i}")
            for s, m in (("a", a), ("b", b))
            for i, value in enumerate(measures.values())
        ]
    )
    rows = [F.struct(F.lit(x).alias("measure"), F.col(f"a_{i}").alias("a"), F.col(f"b_{i}").alias("b")) for i, x in enumerate(measures)]
    return sides.select(F.inline(F.array(*rows)))


def model_comparison(predictions: DataFrame, a: str, b: str) -> DataFrame:
    """Precision, recall and F1 of class 1 of two models side by side."""
    fake = classification_report(predictions).where(F.col("entry") == "1")
    return _sides(fake, a, b, {x: F.col(x) for x in ("precision", "recall", "f1")})


def confidence_comparison(predictions: DataFrame, a: str, b: str) -> DataFrame:
    """Sure items and items per confidence band and predicted class (``fake_>90``) of two models side by side."""
    sure = _sides(high_confidence(predictions), a, b, {x: F.col(x) for x in ("sure_fake", "sure_real")})
    bands = {
        f"{side}_{name}": F.when(F.col("band") == name, F.col(f"{side}_predictions"))
        for _, name in BANDS
        for side in ("fake", "real")
    }
    return sure.unionByName(_sides(confidence_bands(predictions), a, b, bands))
