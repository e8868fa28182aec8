"""Phrases of two and three words that belong together, from a weighted de Bruijn graph of the corpus.

Nodes are pairs of neighbouring words, edges are runs of three words that lead from the node of the first two to that of
the last two; an edge's weight is its number of occurrences. Only edges are counted. A pair occurs as often as its node
passes flow on, plus the pieces that end in it; a word as often as the nodes that begin with it do, plus the pieces that
end in it.

Blocks of texts count their edges and deal them out by node. Each bucket adds up its nodes, and gives the heavy edges and
nodes and each word's flow. The heavy edges are then compacted: a node that has one way in and one way out, and no end or
start of a piece, belongs to a path whose edges and inner nodes all have one weight. Its pair needs no count and is no
candidate, as each longer phrase on the path occurs equally often.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplegraph.llm import common
from ripplegraph.plans.skew import hot_key_sets, salted_join
from ripplegraph.session import materialise

# Bytes of text that a task counts at once, and that a bucket stands for.
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 16 << 20
# Bytes of rows that leave a worker in one batch.
SENT_BYTES = 2 << 20
# Different edges of one node in a block above which they are dealt out one by one.
HOT_EDGES = 20_000
# Rows of a language that are ranked in one task before the best meet.
RANKED = 200_000
BREAKS = np.zeros(256, bool)
BREAKS[list(b".,;:!?\n\x0b\x0c\r")] = True
BLANKS = np.zeros(256, bool)
BLANKS[list(b" \t")] = True
SHIFT = np.uint64(31)


def _node_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return common.mix(common.mix(a) + (b ^ (b >> SHIFT)))


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Where rows that are sorted by the columns differ from the row before."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    fresh = np.zeros(len(columns[0]), bool)
    fresh[0] = True
    for c in columns:
        fresh[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(fresh)


def _summed(a: np.ndarray, b: np.ndarray, c: np.ndarray, n: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """Sorted distinct rows (a, b, c) with the sum of their counts (1 each without ``n``)."""
    order = np.lexsort((c, b, a))
    a, b, c = a[order], b[order], c[order]
    at = _firsts(a, b, c)
    total = np.diff(np.append(at, len(a))) if n is None else (np.add.reduceat(n[order], at) if len(at) else n)
    return a[at], b[at], c[at], total.astype(np.int64)


def _planes(values: np.ndarray) -> bytes:
    """Small numbers byte by byte: the high bytes, mostly 0, compress well."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(data: memoryview, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * n).reshape(4, n).T).view("<u4").ravel()


def _packed(a: np.ndarray, b: np.ndarray, c: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted edges, with each first word and each node written once."""
    words, nodes = _firsts(a), _firsts(a, b)
    head = np.array([len(words), len(nodes), len(a)], np.int64).tobytes()
    per_word = np.diff(np.append(np.searchsorted(nodes, words), len(nodes)))
    per_node = np.diff(np.append(nodes, len(a)))
    return b"".join((head, a[words].tobytes(), b[nodes].tobytes(), c.tobytes(), _planes(per_word), _planes(per_node), _planes(n)))


def _unpacked(data: bytes) -> tuple[np.ndarray, ...]:
    view = memoryview(data)
    words, nodes, edges = (int(x) for x in np.frombuffer(view, np.int64, 3))
    at, out = 24, []
    for k in (words, nodes, edges):
        out.append(np.frombuffer(view, np.uint64, k, at))
        at += 8 * k
    for k in (words, nodes, edges):
        out.append(_numbers(view[at:], k))
        at += 4 * k
    a, b, c, per_word, per_node, n = out
    return np.repeat(np.repeat(a, per_word), per_node), np.repeat(b, per_node), c, n.astype(np.int64)


_DEALT = [("bucket", pa.int32()), ("kind", pa.int8()), ("data", pa.binary())]
# What a row of the exchange holds: edges of a bucket's nodes; single edges of hot nodes; such nodes; words.
EDGES, SINGLE, HOT, WORDS = range(4)


def _block(texts: list[bytes], langs: list[str], salts: np.ndarray, buckets: int) -> Iterator[tuple]:
    """The edges and words of a block of texts, by bucket."""
    buf, starts = common.joined([t.translate(common.LOWER) for t in texts])
    cut = BREAKS[buf]
    first, last, doc = common.spans(cut | BLANKS[buf], starts)
    if not len(first):
        return
    words = common.span_hashes(buf, first, last)
    words = common.mix(words + salts[doc]) | np.uint64(1)  # 0 is kept for the end of a piece
    ends = np.cumsum(cut, dtype=np.int32)[first]
    final = np.append(ends[1:] != ends[:-1], True)  # every text ends in a break
    del cut, ends

    # distinct words: place of the first, and pieces that end in them
    order = np.argsort(words, kind="stable")
    at = _firsts(words[order])
    yield from _word_rows(words[order][at], first[order[at]], last[order[at]], [langs[d] for d in doc[order[at]].tolist()],
                          np.add.reduceat(final[order].astype(np.int64), at), buf, buckets)
    # what the words took is given back before the edges are sorted
    del buf, first, last, doc, order, at

    inner = np.flatnonzero(~final)
    third = np.append(words[2:], np.zeros(2, np.uint64))[: len(words)]
    third[:-1][final[1:]] = 0
    edges = words[inner], words[inner + 1], third[inner]
    del words, third, inner, final
    a, b, c, n = _summed(*edges, None)
    del edges
    if not len(a):
        return
    nodes = _firsts(a, b)
    sizes = np.diff(np.append(nodes, len(a)))
    home = _bucket(_node_hash(a, b), buckets)
    if not (sizes > HOT_EDGES).any():
        yield from _edge_rows(EDGES, home, a, b, c, n)
    else:
        hot = np.repeat(sizes > HOT_EDGES, sizes)
        yield from _edge_rows(EDGES, home[~hot], a[~hot], b[~hot], c[~hot], n[~hot])
        a, b, c, n = (x[hot] for x in (a, b, c, n))
        yield from _edge_rows(SINGLE, _bucket(_node_hash(common.mix(a) ^ b, c), buckets), a, b, c, n)
        at = _firsts(a, b)
        none = np.zeros(len(at), np.uint64)
        yield from _edge_rows(HOT, home[hot][at], a[at], b[at], none, none.astype(np.int64))


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def _edge_rows(kind: int, bucket: np.ndarray, a, b, c, n) -> Iterator[tuple]:
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    at = _firsts(bucket)
    for lo, hi in zip(at, np.append(at[1:], len(bucket))):
        own = order[lo:hi]
        yield int(bucket[lo]), kind, _packed(a[own], b[own], c[own], n[own])


def _word_rows(words, first, last, langs: list[str], ends, buf, buckets: int) -> Iterator[tuple]:
    data = buf.tobytes()
    spelled = [data[i:j].decode() for i, j in zip(first.tolist(), last.tolist())]
    bucket = _bucket(common.mix(words), buckets)
    order = np.argsort(bucket, kind="stable")
    at = _firsts(bucket[order])
    for lo, hi in zip(at, np.append(at[1:], len(order))):
        own = order[lo:hi]
        table = pa.table({"w": words[own].view(np.int64), "n": ends[own], "lang": [langs[i] for i in own], "word": [spelled[i] for i in own]})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        yield int(bucket[order[lo]]), WORDS, sink.getvalue().to_pybytes()


_PARTS = "kind string, w1 long, w2 long, w3 long, n long, lang string, word string"


def _bucket_parts(least: int):
    """What a bucket tells of its nodes and words.

    ``edge`` and ``node`` rows are those of ``least`` occurrences or more, or a part of the count of an edge or node that is
    hot in some block; ``flow`` rows are a first word's flow out of this bucket's nodes; ``word`` rows are a word, spelled,
    with the pieces that end in it.
    """

    def rows(kind: str, n: np.ndarray, *words: np.ndarray, lang=None, word=None) -> pa.Table:
        size = len(n)
        keys = [pa.array(w.view(np.int64)) for w in words] + [pa.nulls(size, pa.int64())] * (3 - len(words))
        texts = [pa.nulls(size, pa.string()) if x is None else x for x in (lang, word)]
        return pa.table([pa.array([kind] * size, pa.string()), *keys, pa.array(n, pa.int64()), *texts],
                        names=["kind", "w1", "w2", "w3", "n", "lang", "word"])

    def edges_of(data: list[bytes]) -> tuple[np.ndarray, ...]:
        # what has been joined is given back: a bucket's edges are there once, and once more while they are sorted
        parts = []
        while data:
            parts.append(list(_unpacked(data.pop())))
        return _summed(*[np.concatenate([p.pop(0) for p in parts]) for _ in range(4)])

    def parts(table: pa.Table) -> pa.Table:
        held: dict[int, list[bytes]] = {k: [] for k in range(4)}
        for kind, data in zip(table["kind"].to_pylist(), table["data"].to_pylist()):
            held[kind].append(data)
        out = [rows("edge", np.zeros(0, np.int64))]
        for kind in (EDGES, SINGLE):
            if not held[kind]:
                continue
            a, b, c, n = edges_of(held[kind])
            nodes = _firsts(a, b)
            flow = np.add.reduceat(n, nodes)
            all_of = np.full(len(nodes), kind == SINGLE)
            if kind == EDGES and held[HOT]:
                x, y, *_ = edges_of(held[HOT])
                marked = set(zip(x.tolist(), y.tolist()))
                all_of = np.fromiter(((p, q) in marked for p, q in zip(a[nodes].tolist(), b[nodes].tolist())), bool, len(nodes))
            sizes = np.diff(np.append(nodes, len(a)))
            kept = ((n >= least) | np.repeat(all_of, sizes)) & (c != 0)
            out.append(rows("edge", n[kept], a[kept], b[kept], c[kept]))
            kept = (flow >= least) | all_of
            out.append(rows("node", flow[kept], a[nodes][kept], b[nodes][kept]))
            at = _firsts(a[nodes])
            out.append(rows("flow", np.add.reduceat(flow, at), a[nodes][at]))
        if held[WORDS]:
            spelled = pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in held[WORDS]])
            words = spelled.group_by(["w", "lang", "word"]).aggregate([("n", "sum")])
            w = words["w"].to_numpy()
            if len(np.unique(w)) < len(w):
                raise ValueError("two words have one 64-bit hash")
            out.append(rows("word", words["n_sum"].to_numpy(), w, lang=words["lang"], word=words["word"]))
        return pa.concat_tables(out).select(["kind", "w1", "w2", "w3", "n", "lang", "word"])

    return parts


def counted(docs: DataFrame, least: int) -> DataFrame:
    """The corpus graph, as the stored rows of :func:`_bucket_parts`."""
    total = common.text_bytes(docs)
    buckets = common.parts_for(total, BUCKET_BYTES)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, langs, salts, held = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if texts:
                rows, size = [], 0
                for row in _block(texts, langs, np.array(salts, np.int64).view(np.uint64), buckets):
                    rows.append(row)
                    size += len(row[2])
                    if size > SENT_BYTES:
                        yield common.arrow_batch(rows, _DEALT)
                        rows, size = [], 0
                yield common.arrow_batch(rows, _DEALT)

        for batch in batches:
            for text, lang, salt in zip(common.as_bytes(batch["text"]), *[batch[c].to_pylist() for c in ("lang", "salt")]):
                if held + len(text) > BLOCK_BYTES:
                    yield from flush()
                    texts, langs, salts, held = [], [], [], 0
                texts.append(text)
                langs.append(lang)
                salts.append(salt)
                held += len(text)
        yield from flush()

    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    rows = docs.select("text", lang.alias("lang"), F.xxhash64(lang).alias("salt"))
    dealt = rows.mapInArrow(deal, "bucket int, kind byte, data binary")
    return materialise(dealt.groupBy("bucket").applyInArrow(_bucket_parts(least), _PARTS), "graph")


# ---- the heavy part of the graph


def _node(*names: str) -> Column:
    return F.struct(*[F.col(n).alias(k) for n, k in zip(names, ("a", "b"))])


def paths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges as compact paths: words (three or more) and the one weight of all edges on the path.

    A node is inside a path if an edge into it and an edge out of it each carry all its flow: then there are no others, and
    no piece begins or ends there. Each such node points at the node before it, and pointers double until all nodes of a path
    know its first: as many rounds as the longest path has doublings. Paths end with pieces, and every path has a
    first edge, as the pieces that enter it begin outside.
    """
    weighed = nodes.select("w1", "w2", "n")
    into = edges.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "n", F.col("w1").alias("before"))
    out_of = edges.select("w1", "w2", "n", F.col("w3").alias("after"))
    inside = into.join(weighed, ["w1", "w2", "n"]).join(out_of, ["w1", "w2", "n"])
    inside = materialise(inside.select(_node("w1", "w2").alias("node"), _node("before", "w1").alias("up"), "before", "after", "n"), "inside")

    own = inside.select("node").withColumn("inner", F.lit(True))
    begun = inside.join(own.withColumnRenamed("node", "up"), "up", "left")
    step = begun.select(
        "node", F.when(F.col("inner"), F.col("up")).otherwise(F.col("node")).alias("head"),
        F.when(F.col("inner"), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")).alias("place"),
    )
    step = materialise(step, "step")
    while True:
        ahead = step.where("place > 0").select("node", F.col("head").alias("at"), F.col("place").alias("gone"))
        known = step.select(F.col("node").alias("at"), F.col("head").alias("further"), F.col("place").alias("more"))
        moved = ahead.join(known, "at").select("node", F.col("further").alias("head"), (F.col("gone") + F.col("more")).alias("place"), "more")
        moved = materialise(moved, "step")
        if moved.where("more > 0").isEmpty():
            step = step.where("place = 0").unionByName(moved.drop("more"))
            break
        step = step.where("place = 0").unionByName(moved.drop("more"))
    ordered = F.array_sort(F.collect_list(F.struct("place", F.col("node.a").alias("a"), F.col("node.b").alias("b"), "before", "after")))
    chains = inside.join(step, "node").groupBy("head").agg(ordered.alias("c"), F.first("n").alias("weight"))
    steps = F.transform("c", lambda x: x["b"])
    long = chains.select(
        F.concat(F.array(F.col("c")[0]["before"], F.col("c")[0]["a"]), steps, F.array(F.element_at("c", -1)["after"])).alias("words"), "weight"
    )
    met = edges.join(own.select(F.col("node.a").alias("w1"), F.col("node.b").alias("w2")), ["w1", "w2"], "left_anti").join(
        own.select(F.col("node.a").alias("w2"), F.col("node.b").alias("w3")), ["w2", "w3"], "left_anti"
    )
    return long.unionByName(met.select(F.array("w1", "w2", "w3").alias("words"), F.col("n").alias("weight")))


def _candidates(paths: DataFrame, nodes: DataFrame, share: int) -> DataFrame:
    """Phrases (w1, w2, w3 or null) with their count ``a``, and for three words the counts of the first and the last two.

    Inside a path these counts are its weight. Of pairs, those at the ends of paths are left that no phrase of three words
    makes superfluous.
    """
    size = F.size("words")
    spread = paths.select("words", "weight", F.explode(F.sequence(F.lit(0), size - 3)).alias("i"))
    three = spread.select(
        *[F.col("words")[F.col("i") + k].alias(f"w{k + 1}") for k in range(3)], F.col("weight").alias("a"),
        (F.col("i") == 0).alias("begins"), (F.col("i") == size - 3).alias("ends"),
    )
    first = nodes.select("w1", "w2", F.col("n").alias("first_two"))
    last = nodes.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("n").alias("last_two"))
    rest = three.where(~F.col("begins")).withColumn("first_two", F.col("a"))
    heads = three.where("begins").join(first, ["w1", "w2"]).select(*rest.columns)
    three_with = heads.unionByName(rest)
    rest = three_with.where(~F.col("ends")).withColumn("last_two", F.col("a"))
    tails = three_with.where("ends").join(last, ["w2", "w3"]).select(*rest.columns)
    three_with = tails.unionByName(rest).drop("begins", "ends")

    # pairs inside paths are superfluous; the others are weighed against the heaviest edge beside them
    sides = three.where("begins").select("w1", "w2", "a").unionByName(
        three.where("ends").select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a")
    )
    inner = three.where(~F.col("begins")).select("w1", "w2", "a")
    beside = sides.unionByName(inner).groupBy("w1", "w2").agg(F.max("a").alias("most"))
    two = nodes.join(beside, ["w1", "w2"], "left").where(F.coalesce("most", F.lit(0)) * 100 < F.col("n") * share)
    none = F.lit(None).cast("long")
    return three_with.unionByName(
        two.select("w1", "w2", none.alias("w3"), F.col("n").alias("a"), none.alias("first_two"), none.alias("last_two"))
    )


def _product(*names: str) -> Column:
    out = F.lit(1).cast("decimal(1,0)")
    for n in names:
        out = out * F.col(n).cast("decimal(18,0)")
    return out


def collocations(docs: DataFrame, least: int = 10, share: int = 50, top: int = 2_000) -> DataFrame:
    """The phrases of two and three words with the best score of each language: lang, rank, phrase, a, l, r, n, score.

    ``docs`` has text and lang; other columns are ignored. A-Z are lower-cased; words lie between blanks and tabs, phrases
    between marks and line breaks. ``a`` is the phrase's count (at least ``least``), ``l`` and ``r`` those of its parts at its worst
    cut, ``n`` all words of the language, ``score`` the millionths of a * a / (l * r). Phrases inside a longer candidate with
    at least ``share`` percent of their count are left out. Ties go by count, then by phrase. A null lang is ``und``; null and
    empty texts have no words; a repeated row counts again; no documents, no rows. Words are told apart by 64 bits; should two
    words share them, the job fails instead of adding their counts.
    """
    common.prepare(docs.sparkSession)
    parts = counted(docs, least)

    def summed(kind: str, *keys: str) -> DataFrame:
        return parts.where(F.col("kind") == kind).groupBy(*keys).agg(F.sum("n").alias("n"))

    edges = materialise(summed("edge", "w1", "w2", "w3").where(F.col("n") >= least), "edges")
    nodes = materialise(summed("node", "w1", "w2").where(F.col("n") >= least), "nodes")
    spelled = parts.where("kind = 'word'").select("w1", "lang", "word", "n")
    words = spelled.join(summed("flow", "w1").withColumnRenamed("n", "flow"), "w1", "left")
    words = materialise(words.select("w1", "lang", "word", (F.col("n") + F.coalesce("flow", F.lit(0))).alias("f")), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    heavy = words.where(F.col("f") >= least)

    compact = materialise(paths(edges, nodes), "paths")
    found = materialise(_candidates(compact, nodes, share), "candidates")
    hot = hot_key_sets(found, [["w1"], ["w2"], ["w3"]])
    for k, keys in enumerate(hot, 1):
        side = heavy.select(F.col("w1").alias(f"w{k}"), F.col("f").alias(f"f{k}"), F.col("word").alias(f"word{k}"), *(["lang"] if k == 1 else []))
        found = salted_join(found, side, [f"w{k}"], keys, ["a", "w1", "w2"], "left" if k == 3 else "inner")

    pair = F.col("w3").isNull()
    ways = found.select(
        "lang", F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), "a",
        F.col("f1").alias("l1"), F.when(pair, F.col("f2")).otherwise(F.col("last_two")).alias("r1"),
        F.when(~pair, F.col("first_two")).alias("l2"), F.when(~pair, F.col("f3")).alias("r2"),
    )
    square = F.lit(1_000_000).cast("decimal(7,0)") * _product("a", "a")
    ways = ways.withColumn("square", square.cast("decimal(38,0)"))
    for k in (1, 2):
        ways = ways.withColumn(f"under{k}", _product(f"l{k}", f"r{k}").cast("decimal(38,0)")).withColumn(f"s{k}", F.expr(f"square div under{k}"))
    second = F.col("s2").isNotNull() & (F.col("s2") < F.col("s1"))
    scored = ways.select(
        "lang", "phrase", "a", *[F.when(second, F.col(f"{c}2")).otherwise(F.col(f"{c}1")).alias(o) for c, o in (("l", "l"), ("r", "r"), ("s", "score"))]
    )
    best = _best(materialise(scored, "scored"), top)
    ranked = best.join(totals, "lang")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _best(scored: DataFrame, top: int) -> DataFrame:
    """The first rows of each language: first among shares of its rows by hash, then among the best of these, until the
    rest fits one task or no longer shrinks by half, having many languages."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    each, left = max(RANKED, 4 * top), scored.count()
    while left > each:
        share = F.pmod(F.xxhash64("phrase", F.lit(left)), F.lit(common.parts_for(left, each)))
        within = F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))
        scored = scored.withColumn("share", share).withColumn("place", within).where(F.col("place") <= top)
        scored = materialise(scored.drop("place", "share"), "best")
        before, left = left, scored.count()
        if 2 * left > before:
            break
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
