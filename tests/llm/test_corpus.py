"""The corpus operators against brute force on the small tables, and on rows with nulls, ties and odd texts."""

import base64
import hashlib
import importlib.util
import re
import struct
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from ripplegraph.llm import common, components, decontam, jaccard, langid, packing, quality, rules, shards, stats, suffixes, urls, warc
from ripplegraph.llm.queries import ORACLE, QUERIES, RULES, vocabulary

ROOT = Path(__file__).resolve().parents[2]
spec = importlib.util.spec_from_file_location("compare", ROOT / "tools" / "compare.py")
compare = importlib.util.module_from_spec(spec)
spec.loader.exec_module(compare)
SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet' ORDER BY doc_id").fetchall())


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, repeated and long texts, repeated and missing ids, columns with clashing names."""
    words = " ".join(f"w{i}" for i in range(60))
    rows = [
        (1, words), (2, words + " end"), (2, words + " end"), (3, None), (None, words), (None, None), (4, ""), (5, "  \n "),
        (6, "é" * 200), (7, "é" * 150 + "x"), (8, "ab " * 40_000), (9, "a"), (10, "Le chat.\nLe chat.\n\nfin"),
    ]
    made = [(i, t, None if i is None else "en", "s", None) for i, t in rows]
    return spark.createDataFrame(made, DOCS).selectExpr("*", "1 AS block", "'x' AS n", "0 AS kept", "'y' AS word")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# ---- 1

def test_warc(spark):
    found = {r["page_id"]: r for r in rows_of(QUERIES["op1_warc"](spark, SMALL))}
    pages = dict(duckdb.sql(f"SELECT page_id, html FROM '{SMALL}/pages.parquet'").fetchall())
    last = {}
    for i, html in sorted(pages.items()):
        last[html or ""] = i
    assert set(found) == set(pages)
    for i, html in pages.items():
        data, keeper = (html or "").encode(), last[html or ""]
        assert found[i]["payload_bytes"] == len(data)
        assert found[i]["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert (found[i]["record_type"], found[i]["refers_to"]) == (("response", None) if keeper == i else ("revisit", keeper))


def test_warc_odd_pages(spark):
    rows = [(1, "http://a/\r\nWARC-Type: x", "<p>same</p>"), (2, None, "<p>same</p>"), (3, "u", None), (4, "u", ""), (None, "u", "<p>same</p>"), (5, "u", "WARC/1.1\r\n\r\n")]
    found = rows_of(warc.archived_pages(spark, spark.createDataFrame(rows, "page_id long, url string, html string")))
    kinds = {(r["id"], r["record_type"], r["refers_to"], r["size"]) for r in found}
    assert kinds == {
        ("1", "revisit", "2", 11), ("2", "response", None, 11), ("3", "revisit", "4", 0), ("4", "response", None, 0),
        (None, "revisit", "2", 11), ("5", "response", None, 12),
    }
    assert {bytes(r["payload"]) for r in found if r["record_type"] == "response"} == {b"<p>same</p>", b"", b"WARC/1.1\r\n\r\n"}
    assert warc.archived_pages(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_reader_finds_damage():
    member = zlib.decompress(warc.record_bytes([("WARC-Type", "response")], b"abc"), 31)
    assert warc.parsed(member) == ({"warc-type": "response", "content-length": "3"}, b"abc")
    with pytest.raises(ValueError):
        warc.parsed(member[:-5])
    with pytest.raises(ValueError):
        warc.parsed(b"HTTP/1.1 200\r\n\r\n")


# ---- 2

def test_packing(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in texts.items()}
    rows = rows_of(QUERIES["op2_best_fit_packing"](spark, SMALL))
    pieces, bins = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        bins.setdefault(r["sequence_id"], []).append(r)
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(own)}I", *own)) and r["length"] == len(own)
    for i, own in pieces.items():
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert [r["length"] for r in own[1:]] == [2048] * (len(own) - 1)
        assert sum(r["length"] for r in own) == len(ids[i])
    assert set(pieces) == set(ids)
    for own in bins.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))]
        assert sum(r["length"] for r in own) <= 2048
    assert len(bins) <= np.ceil(sum(map(len, ids.values())) / 2048) + 1


def test_packing_odd_texts(spark, odd, none):
    whole = rows_of(packing.tokenized(odd, vocabulary()))
    assert {r["length"] for r in whole if r["doc_id"] in (3, 4)} == {1}
    long = [r["length"] for r in sorted((r for r in whole if r["doc_id"] == 8), key=lambda r: r["piece"])]
    assert len(long) > 10 and set(long[1:]) == {2048}
    assert len({(r["doc_id"], bytes(r["ids"])) for r in whole if r["doc_id"] == 2}) == 1
    assert packing.packed_with(packing.tokenized(none, vocabulary())).count() == 0
    with pytest.raises(Exception, match="from 1 to capacity"):
        packing.packed(spark.createDataFrame([(1, 0, 3000)], "doc_id long, piece int, length long")).collect()


def test_packing_places_each_of_many_rows_with_one_id(spark, odd):
    pieces = packing.tokenized(odd, vocabulary()).withColumn("_row0", F.lit("x"))
    found = rows_of(packing.packed_with(pieces))
    kinds = lambda rows: Counter((r["doc_id"], r["piece"], r["length"], bytes(r["ids"]), r["_row0"]) for r in rows)
    assert kinds(found) == kinds(rows_of(pieces)) and max(kinds(found).values()) == 2
    bins = {}
    for r in found:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        own.sort()
        assert [at for at, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048


@given(st.lists(st.text(alphabet=" \n\tab.é'1s\x1c\xa0", max_size=12), max_size=8))
@settings(max_examples=150, deadline=None)
def test_words_give_the_ids_of_the_text(parts):
    words = packing._Words(vocabulary()) if not hasattr(test_words_give_the_ids_of_the_text, "w") else test_words_give_the_ids_of_the_text.w
    test_words_give_the_ids_of_the_text.w = words
    text = " ".join(parts)
    assert words.ids(text) == words.encode([text])[0]


def test_words_keep_added_tokens_as_the_tokenizer_does():
    from tokenizers import Tokenizer

    tokenizer, words = Tokenizer.from_file(vocabulary()), packing._Words(vocabulary())
    for text in ("see <|endoftext|> here", "<|endoftext|>", "a<|endoftext|>b c", "end <|endoftext|>", "<|endoftext| >", "x <|endoftext|><|endoftext|> y"):
        assert np.frombuffer(words.ids(text), np.uint32).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert 50256 in np.frombuffer(words.ids("see <|endoftext|> here"), np.uint32)


def test_packing_rounds_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(packing, "FIRST_ITEMS", 300)
    monkeypatch.setattr(packing, "ROUND_ITEMS", 200)
    pieces = spark.range(3000).selectExpr("id AS doc_id", "0 AS piece", "1 + (id * 7919) % 900 AS length")
    rows = rows_of(packing.packed(pieces, 1000))
    fill = Counter()
    for r in rows:
        fill[r["sequence_id"]] += r["length"]
    assert len(rows) == 3000 and max(fill.values()) <= 1000
    whole = packing.best_fit(np.array([r["length"] for r in rows]), 1000).max() + 1
    assert len(fill) <= 1.03 * whole


# ---- 3

def plain_removal(rows, length=50):
    first, out = {}, {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        cut = bytearray(len(data))
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            if first.setdefault(w, i) < i:
                cut[s : s + length] = b"\1" * length
        out[i] = (len(data), sum(cut), len(re.findall(b"\1+", bytes(cut))), bytes(b for b, c in zip(data, cut) if not c))
    return out


def test_suffix_dedup(spark, texts):
    wanted = plain_removal(texts.items())
    for r in rows_of(QUERIES["op3_suffix_dedup"](spark, SMALL)):
        n, gone, spans, kept = wanted.pop(r["doc_id"])
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (n, gone, spans, hashlib.sha256(kept).hexdigest())
    assert not wanted


def test_suffix_dedup_odd_texts(odd, none):
    found = rows_of(suffixes.without_repeats(odd, keep=("lang", "kept", "block")))
    assert len(found) == 13
    for r in found:
        if r["doc_id"] in (None, 1, 3, 4, 5, 6, 8, 9, 10):
            assert r["n_removed"] == 0
    assert sorted(r["n_removed"] for r in found if r["doc_id"] == 2) == [229, 229]
    assert [r["n_removed"] for r in found if r["doc_id"] == 7] == [300]
    assert suffixes.without_repeats(none).count() == 0


def boilerplate(n):
    line = "Licensed under the terms that are printed at the end of this text by its author, "
    return [(i, f"{i * 7919} start {i * 104729} " + line + f"name {i % 40 * 7} and date {i * 31} " + "ab" * (i % 60)) for i in range(n)]


def test_suffix_dedup_with_hot_hashes(spark, texts, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", 2)
    rows = [*boilerplate(60), *((1000 + i, t) for i, t in list(texts.items())[:60])]
    wanted = plain_removal(rows)
    for r in rows_of(suffixes.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"))):
        n, gone, spans, kept = wanted.pop(r["doc_id"])
        assert (r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) == (n, gone, spans, kept)
    assert not wanted


def test_suffix_dedup_parts_hot_hashes():
    pa, rows = common.pa, boilerplate(4_000)
    block = lambda b: pa.table({"block": pa.array([b] * 2_000, pa.int32()), "doc_id": [r[0] for r in rows[b::2]], "text": [r[1] for r in rows[b::2]]})
    blocks, hot = [block(0), block(1)], (8,) if hasattr(suffixes, "HOT") else ()
    offered = [common.offers(b, *suffixes._Pieces(t, 50).hashes(), 1) for b, t in enumerate(blocks)]
    shared, plan = common.count_classes(pa.concat_tables(offered)), common.Exchange(2, 1)
    most = Counter()
    for b, t in enumerate(blocks):
        sent = suffixes._offer_pieces(50, plan, *hot)(t, shared.filter(common.pa.compute.equal(shared["block"], b)))
        for keys in sent["keys"].to_pylist():
            most.update(np.frombuffer(keys, np.uint32).tolist())
    assert 1 < max(most.values()) <= 1 << 7


@given(st.lists(st.lists(st.integers(1, 3), max_size=9), min_size=1, max_size=4))
@settings(max_examples=300, deadline=None)
def test_suffix_order(pieces):
    text = [s for p in pieces for s in [*p, 0]]
    ends = [i for i, s in enumerate(text) if not s]
    ranked = [len(ends) - ends.index(i) if not s else s + len(ends) for i, s in enumerate(text)]
    assert suffixes.suffix_order(text) == sorted(range(len(text)), key=lambda i: ranked[i:])


# ---- 4

def test_language_id(spark):
    found = QUERIES["op4_language_id"](spark, "/root/testdata/sf0.01").toPandas()
    docs = duckdb.sql("SELECT doc_id, lang FROM '/root/testdata/sf0.01/documents.parquet'").df().set_index("doc_id")["lang"]
    held = found[found.held_out]
    assert len(found) == 1000 and (held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    assert (held.lang_pred == held.doc_id.map(docs)).mean() > 0.95
    assert found.score.between(0, 1).all()


def test_language_id_odd_texts(odd, none):
    model = langid.fit(odd)
    found = rows_of(langid.predict(odd, model))
    assert Counter(r["lang_pred"] for r in found) == {"und": 4, "en": 9}
    assert all(r["score"] == 0.0 for r in found if r["lang_pred"] == "und")
    empty = langid.fit(none)
    assert {r["lang_pred"] for r in rows_of(langid.predict(odd, empty))} == {"und"}
    assert langid.predict(none, model).count() == 0


def test_backing_off():
    unseen = {0: (-8.0, -8.0), 2: (-7.0, -7.0), 1: (-9.0, -9.0)}
    model = langid.LanguageModel(["a", "b"], unseen, {0: {"one": ((0, 7.0), (1, 5.0))}, 2: {"tw": ((0, 5.0), (1, 6.0)), "wo": ((1, 2.0),)}, 1: {"t": ()}})
    assert langid.word_scores(model, "one") == (0, ((0, 7.0), (1, 5.0)))
    assert langid.word_scores(model, "two") == (2, ((0, 2.5), (1, 4.0)))
    assert langid.word_scores(model, "xtx") == (1, ())
    assert langid.word_scores(model, "xyz") == (None, ())


def plain_languages(rows, texts, most_words, most_grams):
    """Predictions by plain counting: rates with half an occurrence added, the commonest entries of each language."""
    from math import exp, log

    counts = {}
    for lang, text in rows:
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            counts.setdefault(0, {}).setdefault(lang, Counter())[w] += 1
            for n in (5, 4, 3, 2, 1):
                for i in range(len(w) + 3 - n):
                    counts.setdefault(n, {}).setdefault(lang, Counter())[f"^{w}$"[i : i + n]] += 1
    langs = sorted({lang for own in counts.values() for lang in own})
    kept, rate = {}, {}
    for kind, own in counts.items():
        most = most_grams if kind else most_words
        kept[kind] = {e for c in own.values() for e, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:most]}
        every = len({e for c in own.values() for e in c})
        for lang in langs:
            c = own.get(lang, Counter())
            rate[kind, lang] = {e: log((c[e] + 0.5) / (sum(c.values()) + 0.5 * every)) for e in kept[kind]}
    out = []
    for text in texts:
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        sums = dict.fromkeys(langs, 0.0)
        for w in words:
            if w in kept[0]:
                for lang in langs:
                    sums[lang] += rate[0, lang][w]
                continue
            for n in (5, 4, 3, 2, 1):
                known = [g for i in range(len(w) + 3 - n) if (g := f"^{w}$"[i : i + n]) in kept[n]]
                if known:
                    for lang in langs:
                        sums[lang] += sum(rate[n, lang][g] for g in known) / len(known)
                    break
        best = min(langs, key=lambda lang: (-sums[lang], lang))
        out.append((best, 1 / sum(exp((sums[lang] - sums[best]) / len(words)) for lang in langs)) if words else ("und", 0.0))
    return out


@pytest.mark.parametrize("most", [(10_000, 5_000), (40, 25)])
def test_language_id_by_plain_counting(spark, monkeypatch, most):
    """The whole fit and every score; with few entries kept, most words are backed off."""
    monkeypatch.setattr(langid, "WORDS", most[0])
    monkeypatch.setattr(langid, "GRAMS", most[1])
    monkeypatch.setattr(langid, "COUNTED", 500)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 120")
    rare = spark.createDataFrame([(1000, "zyx wvu zyx", "rare"), (1001, "x" * 30_000 + " zyxwvu", "rare")], "doc_id long, text string, lang string")
    docs = docs.select("doc_id", "text", "lang").unionByName(rare).repartition(5)
    rows = sorted((r["doc_id"], r["lang"], r["text"]) for r in docs.collect())
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows_of(langid.predict(docs, langid.fit(docs)))}
    wanted = plain_languages([(lang, t) for _, lang, t in rows], [t for *_, t in rows], *most)
    for (i, *_), (lang, score) in zip(rows, wanted):
        assert found[i][0] == lang and abs(found[i][1] - score) < 1e-9
    assert found[1000][0] == "rare"


# ---- 5

def plain_contamination(docs, items, width=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = {}
    for item, text in items:
        w = split(text)
        for p in range(max(len(w) - width + 1, 1) if w else 0):
            windows.setdefault(tuple(w[p : p + width]), set()).add(str(item))
    out = {}
    for i, text in docs:
        w, hit, names = split(text), set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                found = windows.get(tuple(w[p : p + n]))
                if found:
                    hit |= set(range(p, p + n))
                    names |= found
        out[i] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("small", [True, False])
def test_decontamination(spark, texts, monkeypatch, small):
    monkeypatch.setattr(decontam, "is_small", lambda df: small)
    items = duckdb.sql(f"SELECT item_id, text FROM '{SMALL}/benchmark.parquet'").fetchall()
    wanted = plain_contamination(texts.items(), items)
    found = {r["doc_id"]: r for r in rows_of(QUERIES["op5_decontamination"](spark, SMALL))}
    assert {i: tuple(r[c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for i, r in found.items()} == wanted
    assert any(w[4] for w in wanted.values())


@pytest.mark.parametrize("hot", [None, 1])
def test_decontamination_of_short_and_common_items(spark, monkeypatch, hot):
    """Windows of one, two and more words, shingles that many documents repeat, and the same with salted shingles."""
    if hot:
        monkeypatch.setattr(decontam, "is_small", lambda df: False)
        monkeypatch.setattr(decontam, "HOT_ROWS", hot)
    rng = np.random.default_rng(3)
    made = lambda n: " ".join(rng.choice(list("abcd"), n))
    docs = [(i, made(int(rng.integers(0, 60)))) for i in range(150)] + [(150, "a b " * 300), (151, None), (152, "z")]
    items = [(1, "z"), (2, "a c"), (3, "b b b"), (4, made(9)), (5, docs[7][1]), (6, "a b " * 8), (7, made(14)), (8, "d q d"), (9, None)]
    wanted = plain_contamination(docs, items)
    found = decontam.contamination(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    names = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert {r["doc_id"]: tuple(r[c] for c in names) for r in rows_of(found)} == wanted


def test_broadcasts_are_bounded_by_bytes(spark, monkeypatch):
    rows = spark.createDataFrame([("x" * 100,)] * 20, "word string")
    assert decontam.is_small(rows)
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 1_000)
    assert not decontam.is_small(rows)


def test_decontamination_odd_texts(spark, odd, none):
    items = spark.createDataFrame([(1, "W5 w6, W7"), (1, "W5 w6, W7"), (None, "le CHAT"), (2, None), (3, "")], "item_id long, text string")
    found = sorted((r["doc_id"] or 0, r["n_hit"], r["n_items"]) for r in rows_of(decontam.contamination(odd, items)) if r["n_hit"])
    assert found == [(0, 3, 1), (1, 3, 1), (2, 3, 1), (2, 3, 1), (10, 4, 0)]
    assert not any(r["contaminated"] for r in rows_of(decontam.contamination(odd, items.limit(0))))
    assert decontam.contamination(none, items).count() == 0


# ---- 6

def plain_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(zip(w, w[1:], w[2:]))
    hit = {p + k for p in range(len(w) - 2) if grams[tuple(w[p : p + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_rules(spark, texts):
    found = {r["doc_id"]: r for r in rows_of(QUERIES["op6_quality_rules"](spark, SMALL))}
    for i, text in texts.items():
        assert tuple(found[i][c] for c in stats.COUNTS) == plain_counts(text)
        assert found[i]["base_failed"] == (found[i]["n_words"] < 50 or 100 * found[i]["n_repeat_words"] > 50 * found[i]["n_words"])
        assert not (found[i]["kept"] and found[i]["base_failed"])


def test_quality_rules_keep_good_and_find_odd_documents(spark):
    sf = "/root/testdata/sf0.1"
    found = QUERIES["op6_quality_rules"](spark, sf).toPandas().set_index("doc_id")
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").df().set_index("doc_id")["quality"]
    passed = found[~found.base_failed].join(labels, how="inner")
    assert passed[passed.quality == 1].kept.mean() > 0.99
    assert passed[passed.quality == 0].kept.mean() < 0.5


def plain_anomaly(forest, row):
    """The mean path of one row, tree by tree and step by step; what is left in a leaf counts as a mean search."""
    total = 0.0
    for t in range(len(forest.feature)):
        node = steps = 0
        while forest.feature[t, node] >= 0:
            below = row[forest.feature[t, node]] <= forest.split[t, node]
            node, steps = (forest.left if below else forest.right)[t, node], steps + 1
        assert forest.path[t, node] >= steps
        total += forest.path[t, node]
    return 2.0 ** (-total / len(forest.feature) / forest.norm)


def test_quality_rules_match_plain_verdicts(spark):
    """Every verdict from plain walks through the trees and a limit that is tried class by class."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    fitted = rules.fit(stats.with_statistics(docs), labels)
    names = stats.COUNTS + stats.MORE
    counted = {r["doc_id"]: [r[n] for n in names] for r in stats.with_statistics(docs).collect()}
    passed, scores = set(), {}
    for i, values in counted.items():
        c = dict(zip(names, values))
        if c["n_words"] >= 50 and 2 * c["n_repeat_words"] <= c["n_words"]:
            passed.add(i)
            scores[i] = plain_anomaly(fitted.forest, rules.rates({n: np.array([v]) for n, v in c.items()})[0])
    known = [(r["quality"], scores[r["doc_id"]]) for r in labels.where("quality in (0, 1)").collect() if r["doc_id"] in passed]
    allowed = []
    for limit in sorted({int(s * rules.BINS) for _, s in known}):
        gone = [q for q, s in known if int(s * rules.BINS) >= limit]
        if gone.count(1) <= rules.LOSS * len(known):
            allowed.append((limit, gone.count(0) > gone.count(1)))
    assert fitted.limit == min(limit for limit, mostly_bad in allowed if mostly_bad)
    kept = {r["doc_id"]: r["kept"] for r in QUERIES["op6_quality_rules"](spark, sf).collect()}
    assert kept == {i: i in passed and scores[i] < fitted.limit / rules.BINS for i in counted}
    assert 0 < sum(i in passed and not k for i, k in kept.items())


def test_quality_rules_odd_texts(spark, odd, none):
    labels = spark.createDataFrame([(1, None), (2, 1), (None, 0), (6, 0)], "doc_id long, quality int")
    found = rows_of(rules.judged(odd, labels))
    assert len(found) == 13 and sum(r["kept"] for r in found) == 4
    assert rules.judged(none, labels).count() == 0
    assert rules.filtered(odd, labels).columns == odd.columns and rules.filtered(odd, labels).count() == 4


# ---- 7

def plain_components(rows, width=5, percent=80):
    sets, up = {}, {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
        up[i] = i

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: (len(sets[i]), top(i)) for i in ids}


def test_jaccard_join(spark, texts):
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows_of(QUERIES["op7_jaccard_join"](spark, SMALL))}
    assert found == plain_components(texts.items())


def test_jaccard_join_over_many_groups(spark, monkeypatch):
    # chains of near copies, split into groups of very few members, so that links are found by opening groups
    monkeypatch.setattr(jaccard, "GROUP", 2)
    rows = []
    for chain in range(6):
        words = [f"c{chain}w{k}" for k in range(80)]
        for step in range(12):
            rows.append((chain + 6 * step, " ".join(words)))
            words[(step * 13) % 80] = f"c{chain}s{step}"
    found = rows_of(jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == plain_components(rows)


def test_counts_of_a_block_are_not_capped():
    hashes = np.arange(6, dtype=np.uint64) << np.uint64(3)
    counts = np.array([1, 2, 127, 300, 5_000, 90_000])
    found = common.count_classes(common.pa.concat_tables([common.offers(b, hashes, counts, 1) for b in range(3)]))
    assert found["block"].to_pylist() == [0, 1, 2]
    for data in found["classes"].to_pylist():
        exact = np.log2(3 * counts)
        assert ((np.frombuffer(data, np.uint8) >= exact) & (np.frombuffer(data, np.uint8) < exact + 1.2)).all()


def test_jaccard_join_odd_texts(odd, none):
    found = rows_of(jaccard.similar_documents(odd))
    assert sorted((r["doc_id"], r["component_id"]) for r in found if r["doc_id"] is not None) == sorted(
        [(i, i) for i in (1, 3, 4, 5, 6, 7, 8, 9, 10)] + [(2, 1), (2, 1)]
    )
    assert [r["component_id"] for r in found if r["doc_id"] is None] == [None, None]
    assert jaccard.similar_documents(none).count() == 0


def test_components(spark):
    links = [(k, k + 1) for k in range(1, 60)] + [(200, 100), (100, 150), (7, 7), (None, 3), (300, 300)]
    found = {r["node"]: r["component"] for r in rows_of(components.components(spark.createDataFrame(links, "a long, b long")))}
    assert found == {k: 1 for k in range(1, 61)} | {100: 100, 150: 100, 200: 100, 300: 300}


# ---- 8

def plain_verdict(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
    fits = [r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    return host, path, best and best[1] + best[2], best[0] if best else "allow"


def test_url_filters(spark):
    urls_of = dict(duckdb.sql(f"SELECT page_id, url FROM '{SMALL}/pages.parquet'").fetchall())
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows_of(QUERIES["op8_url_filters"](spark, SMALL))}
    assert found == {i: plain_verdict(u) for i, u in urls_of.items()}


def test_url_aliases(spark):
    link = lambda u: f'<head><LINK href="{u}" rel="canonical"></head>'
    rows = [
        (1, "http://a.org/x", link("https://shop.net/fr/1")),  # an alias of a blocked address
        (2, "http://b.org/y#top", '<meta http-equiv="refresh" content="0; url=http://a.org/x">'),  # by way of the first
        (3, "http://c.net/fr/2", link("http://good.com/")),  # its own rule holds
        (4, "http://d.org/z", link("http://c.net/fr/2")),  # its component has an allowed address
        (5, "http://e.org/q", link("/other")),
        (6, None, link("https://shop.net/fr/1")), (7, "no scheme", None), (8, "HTTP://Example.COM/en/?q", None), (8, "x://net/fr/", ""),
        (9, "http://b.org/y", None),
    ]
    found = rows_of(urls.judged(spark.createDataFrame(rows, "page_id long, url string, html string"), RULES))
    assert sorted((r["page_id"], r["verdict"]) for r in found) == [
        (1, "block"), (2, "block"), (3, "block"), (4, "allow"), (5, "allow"), (6, "allow"), (7, "allow"), (8, "block"), (8, "block"), (9, "block"),
    ]
    assert urls.judged(spark.createDataFrame([], "page_id long, url string, html string"), RULES).count() == 0


def test_url_aliases_of_relative_links(spark):
    from urllib.parse import urljoin

    links = [
        "page2.html", "../x", "../../../x", "./", "..", ".", "?id=3", "#top", "a/./b/../c?q=../d", "/p/../q", "/.hidden/..x", "mailto:me", "",
        "//H.net/z", "a&amp;b", "?x=1&amp;y=2&#38;z=3&#x2F;&copy;&lt;&none;&#1114112;&", "&#233;", "&amp;amp;x",
    ]
    plain = {"a&amp;b": "a&b", links[15]: "?x=1&y=2&z=3/\xa9<&none;&#1114112;&", "&#233;": "\xe9", "&amp;amp;x": "&amp;x"}
    address = lambda u: re.sub(r"^\w+://([^/?#]*)([^#]*).*", lambda m: m[1].lower() + m[2], u)
    rows, wanted = [], set()
    for tag in ('<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="0; url={}">'):
        for folder in ("", '<base href="../n/m">'):
            for k, link in enumerate(links):
                url = f"http://h{len(rows)}.net/a/b/c?d#e"
                rows.append((url, folder + tag.format(link)))
                to = urljoin(urljoin(url, "../n/m") if folder else url, plain.get(link, link))
                if link not in ("", "mailto:me") and address(to) != address(url):
                    wanted.add((address(url), address(to)))
    assert {(r["a"], r["b"]) for r in rows_of(urls.alias_links(spark.createDataFrame(rows, "url string, html string")))} == wanted
    pages = [
        (1, "http://a.org/d/x", '<link rel="canonical" href="../fr/1">'), (2, "http://a.org/fr/1", '<link rel="canonical" href="//shop.net/fr/?a=1&amp;b=2">'),
        (3, "http://a.org", '<meta http-equiv="refresh" content="0; url=d/x">'), (4, "http://b.org", '<link rel="canonical" href="">'),
    ]
    found = rows_of(urls.judged(spark.createDataFrame(pages, "page_id long, url string, html string"), RULES))
    assert sorted((r["page_id"], r["verdict"]) for r in found) == [(1, "block"), (2, "block"), (3, "block"), (4, "allow")]


# ---- 9

def test_quality_classifier(spark):
    sf = "/root/testdata/sf0.1"
    found = QUERIES["op9_quality_classifier"](spark, sf).toPandas()
    assert found.score.between(0, 1).all() and (found.predicted == (found.score >= 0.7)).all()
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").df().set_index("doc_id")["quality"]
    held = found[found.held_out].set_index("doc_id").join(labels, how="inner")
    ranks = held.score.rank()
    good = held.quality == 1
    auc = (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.95 and (held.predicted == held.quality).mean() > 0.95


def test_quality_classifier_matches_plain_regression(spark):
    """Ridge weights by least squares over all rows at once, the monotone fit by its max-min formula, and the scores."""
    docs, labels = [spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels")]
    labels = labels.where("quality in (0, 1)").select("doc_id", "quality")
    counted = stats.with_statistics(docs).repartition(7)
    model = quality.fit(counted.join(labels, "doc_id"))
    frame = counted.toPandas().set_index("doc_id").sort_index()
    known = labels.toPandas().set_index("doc_id")["quality"]
    x = quality.inputs({n: frame[n].to_numpy() for n in stats.COUNTS + stats.MORE})
    at = frame.index.get_indexer(known.index)
    y, own = known.to_numpy(float), x[at]
    assert np.allclose(model.mean, own.mean(axis=0)) and np.allclose(model.spread, own.std(axis=0))
    z = np.clip((x - own.mean(axis=0)) / own.std(axis=0), -6, 6)
    waves = [[np.cos(sum(r * w) + s) for w, s in zip(model.waves.T, model.shifts)] for r in z]
    lifted = np.column_stack([np.array(waves) * np.sqrt(2 / quality.FEATURES), z, np.ones(len(z))])
    size = lifted.shape[1]
    ridge = np.sqrt(quality.RIDGE * len(y) / size) * np.eye(size)
    weights = np.linalg.lstsq(np.vstack([lifted[at], ridge]), np.concatenate([y, np.zeros(size)]), rcond=None)[0]
    raw = lifted @ weights
    assert np.abs(raw - quality.raw_scores(x, model)).max() < 1e-6
    classes = np.clip((quality.raw_scores(own, model) + 0.5) / 2 * quality.BINS, 0, quality.BINS - 1).astype(int)
    filled = sorted(set(classes))
    groups = [y[classes == c] for c in filled]
    mean = lambda a, b: np.concatenate(groups[a : b + 1]).mean()
    last = range(len(groups))
    means = np.array([[mean(a, b) if a <= b else np.nan for b in last] for a in last])
    levels = [max(np.nanmin(means[a, i:]) for a in range(i + 1)) for i in last]
    assert np.allclose(model.levels, levels)
    found = {r["doc_id"]: r["score"] for r in quality.scored(docs, labels).collect()}
    wanted = np.interp(raw, (np.array(filled) + 0.5) / quality.BINS * 2 - 0.5, levels)
    assert max(abs(found[i] - s) for i, s in zip(frame.index, wanted)) < 1e-4


def test_quality_classifier_odd_texts(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (9, 0)], "doc_id long, quality int")
    assert all(0 <= r["score"] <= 1 for r in rows_of(quality.scored(odd, labels)))
    assert {r["score"] for r in rows_of(quality.scored(odd, labels.limit(0)))} == {0.5}
    assert quality.scored(none, labels).count() == 0


def test_pooling():
    assert quality.pooled(np.array([1.0, 0.0, 2.0, 2.0, 1.0]), np.ones(5)).tolist() == [0.5, 0.5, 5 / 3, 5 / 3, 5 / 3]


# ---- 10

def test_sharding(spark, texts):
    rows = rows_of(QUERIES["op10_sharding"](spark, SMALL))
    sizes, slots, groups = Counter(), {}, {}
    for r in rows:
        text = texts[r["doc_id"]]
        assert r["size"] == len(text.encode()) + 16 and r["text_crc32"] == zlib.crc32(text.encode())
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        groups.setdefault(text, set()).add(r["shard"])
    assert len(rows) == len(texts) and all(len(g) == 1 for g in groups.values()) and set(sizes) <= set(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    weights = Counter()
    for text in texts.values():
        weights[hashlib.sha256(text.encode()).hexdigest()] += len(text.encode()) + 16
    ordered = np.array([w for _, w in sorted(weights.items())])
    assert max(sizes.values()) == shards.smallest_capacity(ordered, 40) == plain_minimax(ordered.tolist(), 40)


def plain_minimax(sizes, parts):
    """By dynamic programming over the number of parts."""
    ends = np.append(0, np.cumsum(sizes))
    best = ends.astype(float).copy()
    for _ in range(parts - 1):
        best = np.array([0.0] + [min(max(best[j], ends[i] - ends[j]) for j in range(i)) for i in range(1, len(ends))])
    return int(best[-1])


def test_sharding_by_blocks_is_that_of_the_whole_list(spark, monkeypatch):
    monkeypatch.setattr(shards, "FIRST_BLOCKS", 8)
    monkeypatch.setattr(shards, "FAN", 4)
    rows = [(i, "x" * ((i * 7919) % 97) + f"{i % 350}") for i in range(700)] + [(1000 + i, "hot" * 30) for i in range(90)]
    found = rows_of(shards.placed(spark.createDataFrame(rows, "doc_id long, text string"), 7))
    weights, sizes = Counter(), Counter()
    for _, text in rows:
        weights[hashlib.sha256(text.encode()).hexdigest()] += len(text) + 16
    for r in found:
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) == shards.smallest_capacity(np.array([w for _, w in sorted(weights.items())]), 7)


def test_sharding_odd_texts(odd, none):
    found = rows_of(shards.placed(odd))
    assert len(found) == 13 and len({r["shard"] for r in found if r["doc_id"] in (1,) or r["size"] == 16 and r["doc_id"] in (3,)}) <= 2
    assert shards.placed(none).count() == 0


# ---- all

@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    found = QUERIES[name](spark, SMALL).toPandas()
    assert compare.difference(found, compare.connect(SMALL).execute(ORACLE[name]).df()) == ""


def test_pipeline(spark, texts):
    """Each stage against plain code, on what the stage before it left."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    wanted = docs.columns
    kept = [r.asDict() for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = {r["doc_id"]: r["text"] for r in kept}
        docs = spark.createDataFrame([tuple(r[c] for c in wanted) for r in kept], docs.schema)
        docs = stage(spark, docs, SMALL)
        assert docs.columns == wanted
        kept = rows_of(docs)
        after = {r["doc_id"]: r["text"] for r in kept}
        if name == "quality_rules":
            assert set(after) <= {i for i, t in before.items() if not rules.failed(stats.text_statistics([t.encode()]))[0]} and after
        elif name == "near_duplicates":
            assert set(after) == {i for i, (_, top) in plain_components(before.items()).items() if top == i}
        elif name == "repeated_passages":
            assert after == {i: x[3].decode("utf-8", "ignore") for i, x in plain_removal(before.items()).items()}
            assert all(r["n_chars"] == len(r["text"]) for r in kept)
        else:
            items = duckdb.sql(f"SELECT item_id, text FROM '{SMALL}/benchmark.parquet'").fetchall()
            assert set(after) == {i for i, x in plain_contamination(before.items(), items).items() if not x[4]}
    assert {r["doc_id"] for r in rows_of(corpus_pipeline.STAGES[4][1](spark, docs, SMALL))} == set(after)


def test_pipeline_of_no_documents(spark, none):
    docs = none.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() == 0


def test_words_are_encoded_once_each(monkeypatch):
    """A word costs one encoding while it is remembered, with ranks and without, and also where the memory is cleared."""
    words = packing._Words(vocabulary())
    texts = ["one two  three two", " one\ttwo", "", "two one three", "wide \u00e9 \u4e2d words words"]
    seen, inner = [], words.known.encode
    words.known.encode = lambda w: seen.append(w) or inner(w)
    assert [words.ids(t) for t in texts] == words.encode(texts)
    assert len(seen) == len(set(seen)) and not words.batched
    monkeypatch.setattr(packing, "CACHE", 1)
    assert [words.ids(t) for t in texts] == words.encode(texts)
    words.batched, words.known = True, packing._Known(words.single)
    assert [words.ids(t) for t in texts] == words.encode(texts)


def test_only_pieces_that_share_a_window_are_sorted(monkeypatch):
    """Pieces of one group that share a seed but no window stay out of the suffix array."""
    rng = np.random.default_rng(2)
    seed = bytes(rng.integers(97, 123, 25, dtype=np.uint8))
    side = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8))
    left = side(20)
    # the first two share 20 + 25 + 5 bytes, the others only the seed and 20 bytes to its left; the last is of another group
    pieces = [left + seed + b"hello" + side(5), left + seed + b"hello" + side(9), left + seed + side(9), left + seed + b"hello" + side(7)]
    sizes = np.array([len(p) for p in pieces])
    buf = np.frombuffer(b"".join(pieces), np.uint8)
    found = suffixes._sharing(buf, np.cumsum(sizes) - sizes, sizes - 49, np.array([0, 0, 0, 1]), 50)
    assert found.tolist() == [True, True, False, False]
    assert not len(suffixes._sharing(buf, *[np.zeros(0, np.int64)] * 3, 50))
