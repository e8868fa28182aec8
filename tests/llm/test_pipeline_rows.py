"""The pipeline's stages on rows that share a doc_id or have none, on clashing columns, and on missing ones."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ripplegraph.llm import jaccard, suffixes

SMALL = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
W, V, U = (" ".join(f"{x}{i}" for i in range(80)) for x in "wvu")
CLASHES = ["d", "h", "spans", "kept", "n_bytes", "n_removed", "_own0", "component", "copies", "member", "words", "text_hash", "block", "x0", "a.b", "n"]


def table(spark, rows, extra=()):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs.withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce("text", F.lit(""))) for c in extra})


def texts_of(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_near_duplicates_keep_one_row_of_each_text(spark):
    rows = [(1, W), (5, W), (5, V), (7, V + " " + U), (7, V + " " + U), (None, W), (None, W)]
    kept = texts_of(STAGES["near_duplicates"](spark, table(spark, rows), SMALL))
    assert kept == {(1, W): 1, (5, V): 1, (7, V + " " + U): 1}


@pytest.mark.parametrize(
    "rows, wanted",
    [
        ([(1, W), (1, W)], {(1, W): 1}),
        ([(None, V), (None, V), (9, V)], {(9, V): 1}),
        ([(None, V), (None, V)], {(None, V): 1}),
        ([(3, V + " end"), (3, V), (2, W)], None),
        ([(1, None), (1, None), (2, ""), (2, ""), (None, None), (3, " \n")], {(1, None): 2, (2, ""): 2, (None, None): 1, (3, " \n"): 1}),
        ([(4, "few words"), (5, "few words"), (6, "few other")], {(4, "few words"): 1, (6, "few other"): 1}),
    ],
)
def test_near_duplicates_of_odd_rows(spark, rows, wanted):
    kept = texts_of(STAGES["near_duplicates"](spark, table(spark, rows), SMALL))
    if wanted is None:
        assert sorted(i for i, _ in kept) == [2, 3] and sum(kept.values()) == 2
    else:
        assert kept == wanted


def test_near_duplicates_of_many_rows_without_id(spark, monkeypatch):
    """The rows to drop meet the documents in a shuffle where they are too many to broadcast."""
    monkeypatch.setattr(jaccard, "is_small", lambda df: False)
    rows = [(None, f"{W} {i % 3}") for i in range(40)] + [(i % 4, V) for i in range(40)] + [(8, U)]
    kept = texts_of(STAGES["near_duplicates"](spark, table(spark, rows), SMALL))
    assert sum(kept.values()) == 3 and kept[(0, V)] == 1 and kept[(8, U)] == 1


@pytest.mark.parametrize("name", ["near_duplicates", "repeated_passages", "benchmark_decontamination", "quality_rules"])
def test_stages_keep_all_columns(spark, name):
    docs = table(spark, [(1, W), (2, W + " end"), (2, V), (None, U), (None, None), (3, "")], CLASHES).withColumn("n_chars", F.length("text"))
    docs = docs.select("n_chars", *[f"`{c}`" for c in CLASHES], "text", "doc_id")
    found = STAGES[name](spark, docs, SMALL)
    assert found.columns == docs.columns
    rows = found.collect()
    for r in rows:
        given = r["d"].removeprefix("d:")
        assert all(r[c] == f"{c}:{given}" for c in CLASHES)
        if name != "repeated_passages":
            assert (r["text"] or "") == given
    counts = {"near_duplicates": 5, "repeated_passages": 6, "benchmark_decontamination": 6}
    assert name not in counts or len(rows) == counts[name]


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_without_other_columns(spark, name):
    docs = table(spark, [(1, W), (2, V), (None, U), (None, None), (3, "")])
    found = STAGES[name](spark, docs, SMALL)
    assert name == "best_fit_packing" or found.columns == ["doc_id", "text"]
    assert name == "quality_rules" or found.count() == 5


def test_repeated_passages_of_odd_rows(spark):
    rows = [(1, W), (2, "x " + W), (2, "x " + W), (None, W), (3, None), (4, "é" * 60), (5, "é" * 60)]
    kept = texts_of(STAGES["repeated_passages"](spark, table(spark, rows), SMALL))
    assert kept == {(1, W): 1, (2, "x "): 2, (None, W): 1, (3, ""): 1, (4, "é" * 60): 1, (5, ""): 1}


def test_decontamination_of_odd_rows(spark):
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first()["text"]
    rows = [(1, item), (1, W), (None, item), (None, V), (2, None), (3, ""), (4, W), (4, W)]
    kept = texts_of(STAGES["benchmark_decontamination"](spark, table(spark, rows), SMALL))
    assert kept == {(1, W): 1, (None, V): 1, (2, None): 1, (3, ""): 1, (4, W): 2}


def test_packing_of_odd_rows(spark):
    rows = [(1, W), (1, W), (None, V), (None, V), (2, None), (3, "")]
    found = STAGES["best_fit_packing"](spark, table(spark, rows), SMALL).collect()
    assert Counter(r["doc_id"] for r in found) == {1: 2, None: 2, 2: 1, 3: 1}
    bins = {}
    for r in found:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        own.sort()
        assert [a for a, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]


def test_suffix_columns_with_clashing_names(spark):
    docs = table(spark, [(1, W), (2, W)], ["kept", "spans", "_kept", "n_bytes"])
    found = suffixes.without_repeats(docs, 50, ("kept", "spans", "_kept", "n_bytes"))
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "spans", "kept", "_kept", "_spans", "__kept", "_n_bytes"]
    assert {r["_kept"] for r in found.collect()} == {f"kept:{W}"}
