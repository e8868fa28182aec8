"""Benchmark decontamination by a prefix-filtered set join, with DataFrame functions only.

A benchmark item is the set of its windows of words, and a window the list of its shingles, ``SHINGLE`` consecutive words
each. A window occurs in a document only if all its shingles do, so its necessary prefix is one shingle: the rarest in the
corpus, counted over all documents. Documents are joined with the windows on that shingle. Its place bounds where the
window would start: not before the first word, nor so late that fewer words are left than the window has. What
passes is verified word by word. Shingles travel as 64-bit hashes; a chance agreement adds candidates and never a hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.plans import skew
from ripplegraph.plans.skew import HotKeys, salted_join
from ripplegraph.session import materialise

# Words of a shingle; a window of fewer words is one shingle.
SHINGLE = 3
# Documents' rows of one shingle that a single task may own where windows are too many to broadcast.
HOT_ROWS = 500_000
# Bytes up to which a table of few enough rows is broadcast.
BROADCAST_BYTES = 64 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_of(text: str | Column) -> Column:
    """The words of a text: runs of digits, letters and characters beyond ASCII, A-Z lower-cased. Null has none."""
    found = F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), _BETWEEN), "")
    return F.coalesce(found, F.array().cast("array<string>"))


def windows_of(benchmark: DataFrame, width: int) -> DataFrame:
    """item_id and each window: ``width`` consecutive words, or all words of an item that has fewer, but some."""
    words = benchmark.select("item_id", words_of("text").alias("words")).where(F.size("words") > 0)
    last = F.greatest(F.size("words") - width + 1, F.lit(1))
    return words.select("item_id", "words", F.explode(F.sequence(F.lit(1), last)).alias("at")).select(
        "item_id", F.slice("words", F.col("at"), width).alias("win")
    ).distinct()


def is_small(df: DataFrame) -> bool:
    """Whether a table may be broadcast: by a bounded count of its rows, then by their bytes, as words have any length."""
    if not skew.is_small(df):
        return False
    total = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0]
    return (total or 0) <= BROADCAST_BYTES


def _shingle(words: str, at: Column, length: Column, lengths: list[int]) -> Column:
    """Hash of the ``length`` words from ``at``; null where fewer are left. ``length`` is one of ``lengths``."""
    return F.coalesce(
        *[
            F.when((length == n) & (at + n <= F.size(words)), F.xxhash64(F.lit(n), *[F.get(words, at + k) for k in range(n)]))
            for n in lengths
        ]
    )


def _terms(windows: DataFrame) -> DataFrame:
    """win, length, offset, shingle: every shingle of each window with its place (from 0)."""
    placed = windows.select("win", F.least(F.size("win"), F.lit(SHINGLE)).alias("length"))
    placed = placed.select("*", F.explode(F.sequence(F.lit(0), F.size("win") - F.col("length"))).alias("offset"))
    return placed.select("*", _shingle("win", F.col("offset"), F.col("length"), list(range(1, SHINGLE + 1))).alias("shingle"))


def _spread(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """doc_id, text_hash, words, pos, shingle: the shingles of each text, and a row without shingle behind the last word."""
    words = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of("text").alias("words"))
    placed = words.select("*", F.explode(F.sequence(F.lit(0), F.size("words"))).alias("pos"))
    if len(lengths) > 1:
        placed = placed.select("*", F.explode(F.array(*[F.lit(n) for n in lengths])).alias("length"))
    else:
        placed = placed.withColumn("length", F.lit(lengths[0]))
    end = (F.col("pos") == F.size("words")) & (F.col("length") == lengths[0])
    shingle = _shingle("words", F.col("pos"), F.col("length"), lengths)
    return placed.select("doc_id", "text_hash", "words", "pos", shingle.alias("shingle"), end.alias("end")).where(
        F.col("shingle").isNotNull() | F.col("end")
    )


def _hot(keys: DataFrame) -> HotKeys:
    """Shingles with more than HOT_ROWS rows, by the counts that chose them. Rows of the corpus over HOT_ROWS bound their number."""
    table = keys.groupBy("shingle").agg(F.max("n").alias("hot_rows")).where(F.col("hot_rows") > HOT_ROWS)
    return HotKeys(("shingle",), HOT_ROWS, None if table.isEmpty() else table)


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated, and ``hits``, the words hit (from 1).

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; other columns are ignored. A word is hit if it lies in
    an occurrence of a window of any item. Null and empty texts have no words. Items without words, and repeated
    items, change nothing; a null item_id hits words but isn't listed. Equal rows of documents get equal results, rows
    with one doc_id and different texts are judged apart. Without benchmark rows nothing is contaminated.

    Texts are split twice: to count the shingles of windows, and to meet the rarest of each. Where the windows are too many to
    broadcast, only places of their rarest shingles travel, each with the words around it; hot shingles are salted.
    """
    pairs = materialise(windows_of(benchmark, width), "windows")
    terms = materialise(_terms(pairs.select("win").distinct()), "terms")
    lengths = sorted(r[0] for r in terms.select("length").distinct().collect()) or [SHINGLE]  # at most SHINGLE rows
    # Broadcasts happen after a bounded count only.
    hint = lambda df, small: F.broadcast(df) if small else df
    vocabulary = terms.select("shingle").distinct()
    spread = _spread(docs, lengths)
    rarity = (
        spread.select("shingle").join(hint(vocabulary, is_small(vocabulary)), "shingle", "left_semi")
        .groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    )
    rarest = F.min(F.struct("n", "shingle", "offset")).alias("key")
    keys = materialise(
        terms.join(rarity, "shingle").groupBy("win", "length").agg(rarest, F.count(F.lit(1)).alias("known"))
        .where(F.col("known") == F.size("win") - F.col("length") + 1)  # else a shingle is in no document, nor is the window
        .select("key.shingle", "key.offset", "key.n", "win"),
        "keys",
    )
    few = is_small(keys)
    start = F.col("pos") - F.col("offset")  # from 0
    row = ["doc_id", "text_hash"]
    met = [*row, start.cast("long").alias("start"), "win"]
    if few:
        joined = spread.join(F.broadcast(keys.drop("n")), "shingle", "left")
        bounded = (start >= 0) & (start + F.size("win") <= F.size("words"))
        same = bounded & (F.slice("words", F.greatest(start, F.lit(0)) + 1, F.size("win")) == F.col("win"))
        found = joined.where(F.col("end") | same).select(*met, F.when(F.col("end"), F.size("words")).alias("n_words"))
    else:
        hashes = keys.select("shingle").distinct()
        low = F.greatest(F.col("pos") - width + 1, F.lit(0))
        near = spread.join(hint(hashes, is_small(hashes)), "shingle", "left_semi").select(
            *row, "shingle", "pos", low.alias("low"), F.slice("words", low + 1, 2 * width - 1).alias("near")
        )
        joined = salted_join(near, keys.drop("n"), ["shingle"], _hot(keys), [*row, "pos"]).where(start >= F.col("low"))
        same = F.slice("near", start - F.col("low") + 1, F.size("win")) == F.col("win")
        ends = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(words_of("text")).alias("n_words"))
        found = joined.where(same).select(*met).unionByName(ends, allowMissingColumns=True)
    stored = materialise(found, "hits")
    hits = stored.where(F.col("win").isNotNull())
    key = ["doc_id", "text_hash"]
    places = (
        hits.select(*key, F.explode(F.sequence(F.col("start") + 1, F.col("start") + F.size("win"))).alias("at"))
        .distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("n_hit"), F.sort_array(F.collect_list("at")).alias("hits"))
    )
    met_items = hits.select(*key, "win").distinct().join(hint(pairs, few and is_small(pairs)), "win").select(*key, "item_id").distinct()
    names = F.sort_array(F.collect_list(F.col("item_id").cast("string")))
    items = met_items.groupBy(*key).agg(F.count("item_id").alias("n_items"), F.concat_ws(",", names).alias("names"))
    named = items.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "n_items", "names")
    met_rows = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))
    found = places.join(named, met_rows).select("d", "h", "n_hit", "hits", "n_items", "names")
    every = stored.where(F.col("win").isNull()).select(*row, F.col("n_words").cast("long").alias("n_words"))
    joined = every.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.sha2(F.coalesce("names", F.lit("")), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"), "hits", "text_hash",
    )
