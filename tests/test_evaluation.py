"""Metrics and analysis against numbers worked out by hand, and model choice, fitting and storing."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from ripplegraph.operators import analysis, learning, metrics
from ripplegraph.plans import registry, skew

SMALL = "/root/testdata/sf0.001"


def test_metrics(predictions):
    assert metrics.accuracy(predictions).first().accuracy == pytest.approx(0.8)
    row = metrics.f1_binary(predictions).first()
    assert (row.precision, row.recall, row.f1) == pytest.approx((0.75, 1.0, 0.857143), abs=1e-6)
    cells = {(r.label, r.pred): r.n for r in metrics.confusion_matrix(predictions).collect()}
    assert cells == {(0, 0): 1, (0, 1): 1, (1, 0): 0, (1, 1): 3}
    assert sum(cells.values()) == predictions.count()
    report = {r.entry: r for r in metrics.classification_report(predictions).collect()}
    assert report["0"].precision == 1.0 and report["0"].recall == 0.5 and report["1"].support == 3
    assert report["accuracy"].f1 == pytest.approx(0.8)
    assert report["weighted avg"].precision == pytest.approx(0.85)
    expected = -np.log([0.9, 0.4, 0.6, 0.8, 0.95]).mean()
    assert metrics.log_loss(predictions).first().log_loss == pytest.approx(expected)


@pytest.mark.parametrize("limit", [None, 2])
def test_auc(predictions, monkeypatch, limit):
    if limit:
        monkeypatch.setattr(skew, "HOT_ROWS", limit)
    assert metrics.auc(predictions).first().auc == pytest.approx(0.916667, abs=1e-6)
    assert metrics.auc(predictions.where("label = 1")).first().auc is None


def test_undefined_metrics_are_zero(predictions):
    row = metrics.f1_binary(predictions.where("label = 0").withColumn("pred", F.lit(0))).first()
    assert (row.precision, row.recall, row.f1) == (0.0, 0.0, 0.0)


def test_relative_gain(spark):
    records = spark.createDataFrame(
        [("r", "a", "f1", 0.8), ("r", "b", "f1", 0.9), ("r", "a", "auc", 0.0), ("r", "b", "auc", 0.5)],
        "run string, model string, metric string, value double",
    )
    found = {r.metric: r for r in metrics.relative_gain(records, "a", "b").collect()}
    assert found["f1"].gain == pytest.approx(0.1) and found["f1"].gain_pct == pytest.approx(12.5)
    assert found["auc"].gain_pct is None


@pytest.fixture
def two_models(spark):
    rows = []
    for i in range(40):
        label = i % 2
        rows.append((f"g{i:02}", "a", label, 1 - i / 40, i / 40, int(i / 40 > 0.5), float(i), 7.0))
        rows.append((f"g{i:02}", "b", label, 0.05, 0.95, 1, float(i), 7.0))
    return spark.createDataFrame(
        rows, "news_id string, model string, label int, p_real double, p_fake double, pred int, f double, flat double"
    )


def test_agreement(two_models):
    row = analysis.model_agreement(two_models, "a", "b").first()
    assert (row.cases, row.agree, row.disagree) == (40, 19, 21)
    assert row.agree_pct + row.disagree_pct == pytest.approx(100)
    first = analysis.disagreement_cases(two_models, "a", "b").collect()
    assert [r.news_id for r in first] == [f"g{i:02}" for i in range(5)]
    only = analysis.disagreement_direction(two_models, "a", "b").collect()
    assert [(r.pred_a, r.pred_b, r.cases) for r in only] == [(0, 1, 21)]


def test_confidence(two_models):
    sure = {r.model: (r.sure_fake, r.sure_real) for r in analysis.high_confidence(two_models).collect()}
    assert sure == {"a": (3, 4), "b": (40, 0)}
    bands = {(r.model, r.band): (r.fake_predictions, r.real_predictions) for r in analysis.confidence_bands(two_models).collect()}
    assert bands[("b", ">90")] == (40, 0) and len(bands) == 6
    bins = analysis.confidence_histogram(two_models).where("model = 'b' and label = 1").collect()
    assert sum(r.n for r in bins) == 20 and len(bins) == 20
    assert [r.bin for r in bins if r.n] == [10]  # one value: the middle of a unit-wide range
    spread = analysis.confidence_histogram(two_models).where("model = 'a' and label = 1").orderBy("bin").collect()
    values = [i / 40 for i in range(1, 40, 2)]
    assert [r.n for r in spread] == np.histogram(values, bins=20)[0].tolist()


def test_confidence_side_by_side(two_models):
    """Model a's scores are the fortieths, of which 0.5 is in no band; there is no model c."""
    found = {r.measure: (r.a, r.b) for r in analysis.confidence_comparison(two_models, "a", "b").collect()}
    assert found == {
        "sure_fake": (3, 40), "sure_real": (4, 0), "fake_>90": (3, 40), "real_>90": (4, 0),
        "fake_70-90": (8, 0), "real_70-90": (8, 0), "fake_50-70": (8, 0), "real_50-70": (8, 0),
    }
    without = analysis.confidence_comparison(two_models, "a", "c").collect()
    assert len(without) == 8 and all(r.b is None for r in without)


def test_feature_analysis(two_models):
    ranked = analysis.feature_importance(two_models, ["f", "flat"]).collect()
    by = {(r.model, r.feature): (r.importance, r.rank) for r in ranked}
    assert by[("a", "flat")] == (0.0, 2)
    expected = np.corrcoef(np.arange(40), np.arange(40) / 40 > 0.5)[0, 1]
    assert by[("a", "f")][0] == pytest.approx(expected)
    # A constant prediction: every importance is 0, and the later feature comes first.
    assert by[("b", "flat")] == (0.0, 1) and by[("b", "f")] == (0.0, 2)
    ratios = {(r.model, r.feature): r for r in analysis.feature_ratio(two_models, ["f", "flat"]).collect()}
    assert ratios[("a", "f")].ratio == pytest.approx(38.0 / (1.5 + 0.001))
    assert ratios[("b", "f")].real is None and ratios[("b", "f")].ratio is None
    shares = analysis.relative_proportion(analysis.feature_ratio(two_models, ["f"])).where("model = 'a'").first()
    assert shares.fake_share + shares.real_share == pytest.approx(1)
    shown = analysis.ratio_direction(analysis.feature_ratio(two_models, ["f"])).orderBy("model").collect()
    assert [(r.leans, r.shown) for r in shown] == [("fake", "25.32x"), ("real", "N/A")]
    errors = {(r.model, r.is_error): r.cases for r in analysis.error_vs_correct(two_models, ["f"]).collect()}
    assert errors[("b", True)] == 20 and errors[("b", False)] == 20
    sides = {r.measure: (r.a, r.b) for r in analysis.model_comparison(two_models, "a", "b").collect()}
    assert sides["recall"][1] == 1.0 and sides["precision"][1] == 0.5


def test_split_is_exact_and_repeatable(spark):
    graphs = spark.range(1000).selectExpr("concat('g', id) as news_id", "cast(id % 4 = 0 as int) as label")
    split = learning.stratified_split(graphs)
    sizes = {(r.label, r.split): r.graphs for r in learning.split_sizes(split).collect()}
    assert sizes == {
        (1, "train"): 200, (1, "val"): 25, (1, "test"): 25, (0, "train"): 600, (0, "val"): 75, (0, "test"): 75,
    }
    again = learning.stratified_split(graphs.repartition(7))
    assert split.exceptAll(again).count() == 0
    assert learning.stratified_split(graphs, seed="1").exceptAll(split).count() > 0


def test_early_stopping(spark):
    scores = {
        "stops": [0.5, 9, 0.6, 9, 0.6, 9, 0.5, 9, 0.1, 9, 0.2, 9, 0.3, 9, 0.9],  # odd steps are not checked
        "goes on": [0.1, 0, 0.2, 0, 0.3],
        "never": [0.0, 0, 0.0],
    }
    rows = [(run, i, float(v)) for run, values in scores.items() for i, v in enumerate(values)]
    found = {r.run: tuple(r)[1:] for r in learning.select_by_val_f1(spark.createDataFrame(rows, "run string, step int, val_f1 double")).collect()}
    assert found["stops"] == (2, 0.6, 7, 12)
    assert found["goes on"] == (4, 0.3, 3, None)
    assert found["never"] == (None, None, 2, None)


def test_fit_store_and_score(spark, tmp_path):
    rows = [(f"g{i}", i % 2, float(i % 2) * 4 + (i % 7) / 7, float(i % 5)) for i in range(200)]
    data = spark.createDataFrame(rows, "news_id string, label int, a double, b double")
    split = learning.stratified_split(data.select("news_id", "label"))
    parts = learning.labelled_parts(data.drop("label").join(split, "news_id"))
    model = learning.fit_structure(parts["train"], ["a", "b"], learning.perceptron(2, steps=60, hidden=8))
    scored = learning.predict_graphs(model, parts["test"], "m")
    assert metrics.accuracy(scored).first().accuracy == 1.0
    learning.save_model(model, str(tmp_path / "model"))
    again = learning.predict_graphs(learning.load_model(str(tmp_path / "model")), parts["test"], "m")
    assert scored.select("news_id", "pred").exceptAll(again.select("news_id", "pred")).count() == 0
    found = learning.fit_candidates(parts["train"], parts["val"], ["a", "b"], [learning.logistic(n) for n in (1, 20)])
    assert learning.best_candidate(parts["train"], found).val_f1 == max(c.val_f1 for c in found)
    with pytest.raises(ValueError):
        learning.fit_structure_text(parts["train"], ["a"], "b")
    wide = learning.fit_structure_text(parts["train"], ["a"], "b", width=1)
    assert learning.predict_graphs(wide, parts["test"], "w").count() == parts["test"].count()


# --- fitting in stages, and what a fitted model computes


def _rows(spark, n=200, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] - 0.5 * x[:, 1] + 0.3 * rng.normal(size=n) > 0).astype(int)
    return spark.createDataFrame([(f"g{i}", int(k), *map(float, r)) for i, (k, r) in enumerate(zip(y, x))], "news_id string, label int, a double, b double, c double")


def _scaled(train, rows):
    x = np.array([[r.a, r.b, r.c] for r in train.collect()])
    return (np.array([[r.a, r.b, r.c] for r in rows]) - x.mean(axis=0)) / x.std(axis=0, ddof=1)


def _perceptron_by_hand(model, x):
    """Sigmoid, then softmax; weights are stored per layer, inputs by outputs column by column, then the offsets."""
    layers, w, at = model.getLayers(), model.weights.toArray(), 0
    for k, (i, o) in enumerate(zip(layers, layers[1:])):
        weight = w[at : at + i * o].reshape(i, o).T
        x = x @ weight.T + w[at + i * o : at + i * o + o]
        at += i * o + o
        x = 1 / (1 + np.exp(-x)) if k < len(layers) - 2 else np.exp(x) / np.exp(x).sum(axis=1, keepdims=True)
    return x


def test_staged_fit_keeps_the_best_step_and_stops(spark):
    """F1 as given: five checks in a row without a better one end the fit, a later high is never seen."""
    data = _rows(spark)
    told = iter([0.1, 0.3, 0.2, 0.3, 0.2, 0.1, 0.0, 0.9])
    found = learning.fit_staged(data, data, ["a", "b", "c"], hidden=4, score=lambda _: next(told))
    assert found.best_step == 2 and found.stopped_at == 12
    assert found.history == [(0, 0.1), (2, 0.3), (4, 0.2), (6, 0.3), (8, 0.2), (10, 0.1), (12, 0.0)]


def test_staged_fit_without_any_hit(spark):
    data = _rows(spark).withColumn("label", F.lit(0))
    found = learning.fit_staged(data, data, ["a", "b", "c"], hidden=4)
    assert found.best_step is None and found.stopped_at == 8 and [f1 for _, f1 in found.history] == [0.0] * 5
    records = {r.metric: r.value for r in learning.staged_records(found, "m", "run", spark).collect()}
    assert records == {"kept_step": None, "validation_f1": 0.0, "checks": 5.0}


def test_staged_fit_goes_on_from_its_weights(spark):
    """Each stage begins where the one before ended: with no step to take, nothing changes; with steps, the loss falls."""
    data = _rows(spark).cache()
    found = learning.fit_staged(data, data, ["a", "b", "c"], steps=12, hidden=4, patience=99)
    assert [step for step, _ in found.history] == [0, 2, 4, 6, 8, 10] and found.stopped_at is None
    assert max(f1 for _, f1 in found.history) == dict(found.history)[found.best_step] > 0.85
    started = learning.perceptron(3, 1, 4)
    first = started.fit(learning.PipelineModel(stages=found.model.stages[:2]).transform(data))
    again = learning.perceptron(3, 1, 4).setInitialWeights(first.weights).fit(learning.PipelineModel(stages=found.model.stages[:2]).transform(data))
    losses = [m.summary().objectiveHistory for m in (first, again)]
    assert losses[1][0] == pytest.approx(losses[0][-1])


def test_fitted_perceptron_by_hand(spark):
    data = _rows(spark)
    rows = data.orderBy("news_id").collect()
    model = learning.fit_staged(data, data, ["a", "b", "c"], steps=6, hidden=5).model
    wanted = _perceptron_by_hand(model.stages[-1], _scaled(data, rows))
    found = learning.predict_graphs(model, data, "m").orderBy("news_id").collect()
    assert [r.p_fake for r in found] == pytest.approx(wanted[:, 1].tolist())
    assert [r.log_p_real for r in found] == pytest.approx(np.log(wanted[:, 0]).tolist())
    assert [r.pred for r in found] == [int(p > 0.5) for p in wanted[:, 1]]


def test_fitted_logistic_by_hand(spark, tmp_path):
    """The fit is where the gradient vanishes; scores are the logistic function of its weights, also once loaded."""
    data = _rows(spark)
    rows = data.orderBy("news_id").collect()
    model = learning.fit_structure(data, ["a", "b", "c"], learning.logistic(200))
    x, fitted = _scaled(data, rows), model.stages[-1]
    p = 1 / (1 + np.exp(-(x @ fitted.coefficients.toArray() + fitted.intercept)))
    error = p - np.array([r.label for r in rows])
    assert np.abs(error @ np.column_stack([x, np.ones(len(x))])).max() < 0.02
    learning.save_model(model, str(tmp_path / "model"))
    for used in (model, learning.load_model(str(tmp_path / "model"))):
        found = learning.predict_graphs(used, data, "m").orderBy("news_id").collect()
        assert [r.p_fake for r in found] == pytest.approx(p.tolist())


def test_split_does_not_depend_on_slices(spark, monkeypatch):
    graphs = spark.range(500).selectExpr("concat('g', id) AS news_id", "cast(id % 3 AS int) AS label")
    whole = sorted(map(tuple, learning.stratified_split(graphs).collect()))
    monkeypatch.setattr(learning, "SLICE_ROWS", 7)
    assert sorted(map(tuple, learning.stratified_split(graphs).collect())) == whole


@pytest.mark.skipif(not Path(SMALL).exists(), reason="the test tables are absent")
def test_fitted_comparison_is_whole(spark, monkeypatch):
    """Both models are chosen by validation F1, and bands stand next to the sure cases: every row from the same predictions."""
    fits, seen = [], []
    fit, compare = learning.fit_staged, analysis.model_comparison

    def staged(train, val, names, width=None):
        fits.append((len(names), width, train.count(), val.count(), train.join(val, "news_id").count()))
        return fit(train, val, names, width, steps=4)

    monkeypatch.setattr(learning, "fit_staged", staged)
    monkeypatch.setattr(analysis, "model_comparison", lambda p, a, b: seen.append(p.toPandas()) or compare(p, a, b))
    rows = {r.measure: (r.a, r.b) for r in registry.QUERIES["fitted_comparison"](spark, SMALL).collect()}
    assert [f[:2] for f in fits] == [(16, None), (1, registry.TEXT_WIDTH)]
    assert all(train > val > 0 == both for *_, train, val, both in fits)
    wanted = {}
    for model in (registry.A, registry.B):
        p = seen[0][seen[0].model == model]
        said, hits = p.pred == 1, ((p.pred == 1) & (p.label == 1)).sum()
        sure = p.p_fake.where(said, p.p_real)
        values = {"precision": hits / max(said.sum(), 1), "recall": hits / p.label.sum(), "f1": 2 * hits / (said.sum() + p.label.sum()),
                  "sure_fake": (p.p_fake > 0.9).sum(), "sure_real": (p.p_real > 0.9).sum()}
        for band, low, high in ((">90", 0.9, 1), ("70-90", 0.7, 0.9), ("50-70", 0.5, 0.7)):
            inside = (sure > low) & (sure <= high)
            values |= {f"fake_{band}": (inside & said).sum(), f"real_{band}": (inside & ~said).sum()}
        for measure, value in values.items():
            wanted.setdefault(measure, []).append(float(value))
    assert set(rows) == set(wanted)
    for measure, values in wanted.items():
        assert rows[measure] == pytest.approx(values, abs=1e-6), measure
