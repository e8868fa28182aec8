"""Exchanges of hashes between blocks and buckets: directly, and by teams of blocks and spans of buckets."""

import math
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from ripplegraph.llm import common, jaccard, suffixes

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet' ORDER BY doc_id").fetchall()
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("buckets", [1, 3, 7, 1000, 6_000_001])
def test_bounds(buckets):
    hashes = np.sort(np.random.default_rng(buckets).integers(0, 1 << 64, 500, np.uint64))
    bounds = common.bucket_bounds(hashes, buckets)
    assert len(bounds) == buckets + 1 and bounds[0] == 0 and bounds[-1] == 500
    some = {0, buckets // 2, buckets - 1}
    for b in some:
        edge = -(-(b << 32) // buckets) << 32
        assert bounds[b] == sum(int(h) < edge for h in hashes)
    first, number = buckets // 3, max(1, buckets // 5)
    own = hashes[bounds[first] : bounds[first + number]]
    run = common.bucket_bounds(own, buckets, first, number)
    assert (run[:-1] == bounds[first : first + number] - bounds[first]).all() and run[-1] == len(own)


@pytest.mark.parametrize("kind", [np.uint32, np.uint64])
def test_packing_numbers(kind):
    top = np.iinfo(kind).max
    for numbers in ([], [0], [top], [0, 1, 255, 256, 70_000, top - 1, top]):
        array = np.array(numbers, kind)
        assert (common.unpacked(common.packed(array), kind) == array).all()


def test_rows_of_the_exchange_grow_slower_than_the_square():
    def rows(total):
        plan = common.exchange(total, 8 << 20, 16 << 20)
        teams = math.ceil(plan.blocks / plan.per_team) if plan.per_team else plan.blocks
        return plan.blocks * plan.ranges + teams * plan.buckets

    assert common.exchange(1 << 30, 8 << 20, 16 << 20).per_team == 0
    for gb in (100, 1_000, 10_000):
        assert rows(100 * gb << 30) < 1_050 * rows(gb << 30)  # the square would be 10,000 times as many
    assert rows(100 << 40) < 1e11


def _told(spark, texts, plan):
    """The class of every hash as told to each block, and how many blocks hold it in how many documents."""
    sets = {b: common.word_shingles([t.encode() for t in own], 2) for b, own in enumerate(texts)}
    frame = spark.createDataFrame([(b, t) for b, own in enumerate(texts) for t in own], "block int, text string")

    def hashes(table):
        found = common.word_shingles([t.encode() for t in table["text"].to_pylist()], 2)
        return np.unique(np.concatenate(found), return_counts=True)

    replies = {}
    for row in common.hash_classes(frame.repartition(4, "block"), hashes, plan).collect():
        replies.setdefault(row["block"], []).append((row["bucket"], row["classes"]))
    told = {}
    for b, own in sets.items():
        every = np.unique(np.concatenate(own))
        answers = replies.get(b, [])
        table = pa.table({"bucket": pa.array([a for a, _ in answers], pa.int32()), "classes": pa.array([bytes(c) for _, c in answers], pa.binary())})
        told[b] = dict(zip(every.tolist(), common.classes_of(every, table, plan.ranges).tolist()))
    return sets, told, replies


@pytest.mark.parametrize("plan", [common.Exchange(7, 12), common.Exchange(7, 12, 3, 4), common.Exchange(7, 9, 1, 9), common.Exchange(7, 6, 7, 1)])
def test_every_block_is_told_the_class_of_its_hashes(spark, plan):
    rng = np.random.default_rng(5)
    texts = [[" ".join(f"w{k}" for k in rng.zipf(1.3, 40) % 60) for _ in range(6)] for _ in range(6)] + [["", "alone"]]
    sets, told, replies = _told(spark, texts, plan)
    counts = Counter(h for own in sets.values() for one in own for h in one.tolist())
    assert max(counts.values()) > 8
    for block, classes in told.items():
        assert classes == {h: math.ceil(math.log2(counts[h])) for one in sets[block] for h in one.tolist()}
    assert all(len(answers) <= plan.ranges for answers in replies.values())


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_operators_do_not_depend_on_the_exchange(spark, docs, monkeypatch):
    clean = lambda: suffixes.without_repeats(docs).selectExpr("doc_id", "n_bytes", "n_removed", "hex(kept) as kept")
    direct = _rows(clean()), _rows(jaccard.similar_documents(docs))
    assert any(r[2] for r in direct[0]) and any(r[0] != r[2] for r in direct[1])
    for module, block in ((suffixes, 64 << 10), (jaccard, 48 << 10)):
        monkeypatch.setattr(module, "BLOCK_BYTES", block)
        monkeypatch.setattr(module, "BUCKET_BYTES", 2 * block)
    monkeypatch.setattr(common, "DIRECT_ROWS", 0)
    monkeypatch.setattr(common, "MAX_TASKS", 3)
    plan = common.exchange(common.text_bytes(docs), 64 << 10, 128 << 10)
    assert plan.per_team > 1 and plan.per_span > 1 and plan.blocks > 3
    assert (_rows(clean()), _rows(jaccard.similar_documents(docs))) == direct
