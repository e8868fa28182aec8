"""Byte-pair encoding, phrases and fill-in-the-middle against the tokenizer, plain counting and plain cutting."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ripplegraph.llm import bpe, common, fim, phrases
from ripplegraph.llm.queries import QUERIES, vocabulary

SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = vocabulary("word_bpe_49k.json")
UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet' ORDER BY doc_id").fetchall())


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, repeated and long texts, repeated and missing ids, columns with clashing names."""
    words = " ".join(f"w{i}" for i in range(60))
    rows = [
        (1, words), (2, words + " end"), (2, words + " end"), (3, None), (None, words), (None, None), (4, ""), (5, "  \n "),
        (6, "é" * 200), (7, "a <S> b <|endoftext|> c"), (8, "ab " * 40_000), (9, "a"), (10, "x" * 300_000), (11, "漢字 Σς İ é"),
    ]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    return made.selectExpr("*", "'en' AS lang", "1 AS n", "'x' AS form", "2 AS h", "3 AS ids", "4 AS w1", "'y' AS word", "5 AS kind", "6 AS salt")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


# ---- 11

@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(WORDS)


def same(tokenizer, encoder, text):
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.ids(text), np.uint32).tolist() == ids
    assert encoder.text(ids) == tokenizer.decode(ids, skip_special_tokens=False)


def test_bpe_query(spark, texts, tokenizer):
    found = {r["doc_id"]: r for r in rows_of(QUERIES["op11_bpe"](spark, SMALL))}
    assert set(found) == set(texts)
    for i, text in texts.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        told = tokenizer.decode(ids, skip_special_tokens=False)
        assert found[i] == {
            "doc_id": i, "n_tokens": len(ids), "ids_sha256": sha(np.array(ids, "<u4").tobytes()), "decoded_sha256": sha(told.encode())
        }


def test_bpe_odd_texts(spark, odd, tokenizer):
    found = rows_of(bpe.decoded(bpe.encoded(odd, WORDS), WORDS))
    plain = rows_of(odd.select("doc_id", "text"))
    wanted = []
    for r in plain:
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        wanted.append((str(r["doc_id"]), len(ids), ids, tokenizer.decode(ids, skip_special_tokens=False)))
    got = [(str(r["doc_id"]), r["n_tokens"], np.frombuffer(r["ids"], np.uint32).tolist(), r["decoded"]) for r in found]
    assert sorted(got) == sorted(wanted)
    assert bpe.decoded(bpe.encoded(odd.limit(0), WORDS), WORDS).count() == 0


def test_bpe_every_simple_character(tokenizer, encoder):
    for c in range(0x300):
        x = chr(c)
        same(tokenizer, encoder, f"a{x}b 1{x}2 {x}{x} 's{x}'S {x}")


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abeinorstABC'123 .,\n\t\x1c\x85\xa0éÉßΣσς漢éİſ<|>") | st.characters(codec="utf-8"), max_size=80))
def test_bpe_any_text(text):
    if "pair" not in _SHARED:
        from tokenizers import Tokenizer

        _SHARED["pair"] = Tokenizer.from_file(WORDS), bpe.Encoder(WORDS)
    same(*_SHARED["pair"], text)
    same(*_SHARED["pair"], text + "<|endoftext|>" + text + "<|startoftext|>")


_SHARED: dict = {}


def plain_encoding(letters, pairs):
    """Merge the first of the best pairs until there is none."""
    ids = list(letters)
    while True:
        known = [(pairs[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in pairs]
        if not known:
            return ids
        made, i = min(known)
        ids[i : i + 2] = [made]


def test_bpe_unreachable_tokens():
    """Merges in an order that training doesn't give: some tokens are never the encoding of their own letters."""
    rng = random.Random(5)
    letters = bpe.byte_letters()
    for _ in range(60):
        base = [letters[b] for b in range(256)] + [letters[b] + "</w>" for b in range(256)]
        vocab, merges = {t: i for i, t in enumerate(base)}, []
        known = ["a", "b", "c", "a</w>", "b</w>"]
        while len(merges) < 14:
            left, right = rng.choice([t for t in known if not t.endswith("</w>")]), rng.choice(known)
            if left + right not in vocab and len(left + right) < 12:
                vocab[left + right] = len(vocab)
                merges.append([left, right])
                known.append(left + right)
        own = bpe.Vocabulary({"vocab": vocab, "merges": merges, "end_of_word_suffix": "</w>"})
        pairs = {(vocab[a], vocab[b]): vocab[a + b] for a, b in merges}
        for _ in range(60):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
            wanted = plain_encoding([vocab[x] for x in word[:-1]] + [vocab[word[-1] + "</w>"]], pairs)
            assert own.encode(word[:-1] + chr(256 + ord(word[-1]))) == wanted


def test_bpe_refuses_other_merges():
    letters = bpe.byte_letters()
    vocab = {t: i for i, t in enumerate([letters[b] for b in range(256)] + [letters[b] + "</w>" for b in range(256)])}
    vocab |= {"abc": 512, "ab": 513}
    with pytest.raises(ValueError, match="order"):
        bpe.Vocabulary({"vocab": vocab, "merges": [["a", "b"], ["ab", "c"]], "end_of_word_suffix": "</w>"})


# ---- 12

def plain_phrases(rows, least=10, share=50, top=2_000):
    """All counts in dictionaries."""
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in (1, 2, 3):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        some = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        covered = {q for p, a in some.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * a >= share * some[q]}
        ranked = []
        for p, a in some.items():
            if p not in covered:
                score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def found_phrases(df, **options):
    return sorted(tuple(r) for r in phrases.collocations(df, **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def some_texts():
    rng = random.Random(3)
    rows = [(" ".join(rng.choice(["a", "b", "C", "dé", "e.", "f,", "g", "h\n", "i!j"]) for _ in range(rng.randint(0, 60))), rng.choice(["x", "y", None]))
            for _ in range(300)]
    rows += [("one two three four five six seven eight nine ten", "x")] * 15 + [("p q " * 30, "y")] * 3 + [("new york city hall", "x")] * 4
    return rows + [("new york", "x")] * 20 + [(None, "x"), ("", None), ("solo", "x"), (" .. ", "z"), ("x y z", "und"), ("x y z", None)]


@pytest.mark.parametrize("options", [{}, {"least": 3}, {"least": 3, "share": 90, "top": 7}, {"least": 1}])
def test_phrases(spark, some_texts, options):
    wanted = plain_phrases(some_texts, **options)
    assert wanted and found_phrases(spark.createDataFrame(some_texts, "text string, lang string"), **options) == wanted


def test_phrases_of_hot_nodes(spark, some_texts, monkeypatch):
    """Nearly every node is hot, its edges dealt out one by one; many buckets, blocks and shares of a ranking."""
    for name, value in {"HOT_EDGES": 1, "BUCKET_BYTES": 500, "BLOCK_BYTES": 4_000, "RANKED": 50}.items():
        monkeypatch.setattr(phrases, name, value)
    docs = spark.createDataFrame(some_texts, "text string, lang string").repartition(5)
    for options in ({}, {"least": 3, "top": 20}):
        assert found_phrases(docs, **options) == plain_phrases(some_texts, **options)


def test_phrases_query(spark):
    rows = duckdb.sql(f"SELECT text, lang FROM '{SMALL}/documents.parquet'").fetchall()
    found = QUERIES["op12_phrases"](spark, SMALL).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, found)) == plain_phrases(rows)


def test_phrases_odd_texts(spark, odd):
    rows = [(r["text"], r["lang"]) for r in rows_of(odd.select("text", "lang"))]
    assert found_phrases(odd, least=2) == plain_phrases(rows, least=2)
    assert found_phrases(odd.limit(0)) == []


def test_phrase_paths_hold_every_edge(spark):
    """Edges of the paths and their weights are the heavy edges; inner nodes are unary."""
    lines = ["a b c d e f"] * 12 + ["z c d e"] * 11 + ["q r s t u v w x y"] * 10 + ["k k k k k k k"] * 10
    docs = spark.createDataFrame([(x, "en") for x in lines], "text string, lang string")
    parts = phrases.counted(docs, 10)
    edges = parts.where("kind = 'edge'").select("w1", "w2", "w3", "n")
    nodes = parts.where("kind = 'node'").select("w1", "w2", "n")
    names = {r["w1"]: r["word"] for r in parts.where("kind = 'word'").collect()}
    found = {("".join(names[w] for w in r["words"]), r["weight"]) for r in phrases.paths(edges, nodes).collect()}
    # c d e is in two pieces; d e ends one and goes on in the other; k k leads to itself
    assert found == {("abcd", 12), ("cde", 23), ("zcd", 11), ("def", 12), ("qrstuvwxy", 10), ("kkk", 50)}


# ---- 13

def plain_middle(doc_id, text):
    h = [int(sha(f"42:{'' if doc_id is None else doc_id}".encode())[8 * i : 8 * i + 8], 16) for i in range(4)]
    text = text or ""
    units = UNITS.findall(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h[3] % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_query(spark, texts):
    found = {r["doc_id"]: r for r in rows_of(QUERIES["op13_fill_in_middle"](spark, SMALL))}
    assert set(found) == set(texts)
    kinds = Counter()
    for i, text in texts.items():
        n, form, prefix, middle, output = plain_middle(i, text)
        kinds[form] += 1
        assert found[i] == {
            "doc_id": i, "n": n, "form": form, "prefix_chars": prefix, "middle_chars": middle,
            "output_sha256": sha(output.encode()), "restored_sha256": sha((text or "").encode()),
        }
    assert set(kinds) == {"plain", "spm", "psm"}


def test_fill_in_middle_odd_texts(spark, odd):
    many = odd.select("*").unionByName(odd.withColumn("doc_id", F.col("doc_id") + 100)).unionByName(odd.withColumn("doc_id", F.col("doc_id") + 200))
    found = rows_of(fim.transformed(many).withColumn("again", fim.restored()))
    plain = rows_of(many.select("doc_id", "text"))
    key = repr
    assert sorted((tuple(r[c] for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")) for r in found), key=key) == sorted(
        ((r["doc_id"], *plain_middle(r["doc_id"], r["text"])) for r in plain), key=key)
    assert Counter(r["again"] for r in found) == Counter(r["text"] or "" for r in plain)
    assert {r["form"] for r in found} == {"plain", "spm", "psm"}
    assert fim.transformed(odd.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab é漢\n\t\x85\x1c "), max_size=40))
def test_token_ends(text):
    assert fim.token_ends(text.encode()).tolist() == [len(text[: m.end()].encode()) for m in UNITS.finditer(text)]


@pytest.mark.parametrize("density", [0.0005, 0.05, 0.3, 0.99, 1.0])
def test_boundary_set(density):
    rng = np.random.default_rng(1)
    offsets = np.flatnonzero(rng.random(300_000) < density)
    found = fim.BoundarySet(offsets)
    kind = {0.0005: fim.ArrayContainer, 0.05: fim.ArrayContainer, 0.3: fim.BitmapContainer, 0.99: fim.RunContainer, 1.0: fim.RunContainer}
    assert {type(c) for c in found.containers} == {kind[density]} and len(found) == len(offsets)
    for k in [0, len(offsets) - 1, *rng.integers(0, len(offsets), 300).tolist()]:
        assert found.select(int(k)) == offsets[k]
    assert len(fim.BoundarySet(np.zeros(0, np.int64))) == 0 and found.cut(0) == 0


def test_block_of_phrases_is_light():
    """Counting a block takes less than 34 times its text beside it, short words and hardly any repeated, and leaves in small batches."""
    import tracemalloc

    rng = np.random.default_rng(0)
    texts = [" ".join(map("w{}".format, rng.integers(0, 5_000, 2_000))).encode() for _ in range(200)]
    size, salts = sum(map(len, texts)), np.zeros(len(texts), np.uint64)
    common._powers(1 << 20)  # kept by a worker
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        sent = sum(len(row[2]) for row in phrases._block(texts, ["en"] * len(texts), salts, 16))
        most = tracemalloc.get_traced_memory()[1] - before
    finally:
        tracemalloc.stop()
    assert sent and most < 34 * size
    assert phrases.SENT_BYTES < phrases.BLOCK_BYTES <= 4 << 20
