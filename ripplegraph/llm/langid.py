"""Language identification by words first, backing off to shorter and shorter character n-grams.

The model holds, per language, the log frequency of its commonest words, and of character n-grams of each length
(with marks for word start and end). A known word scores by itself. Of an unseen word the longest n-grams known
score, as a mean over those known; where none of a length is known, the next shorter length is tried.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplegraph.llm import common
from ripplegraph.plans.skew import is_small, lookup_join
from ripplegraph.session import materialise

# Entries that the model keeps of each language, of words and of n-grams of each length, and the sample it is fitted on.
WORDS, GRAMS, LENGTHS = 10_000, 5_000, (5, 4, 3, 2, 1)
SAMPLE_DOCS = 4_000
# Different entries that a task counts before it hands them on.
COUNTED = 400_000
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class LanguageModel:
    """Log frequencies of entries by kind: 0 for words, else the length of an n-gram.

    A language that never has an entry gives it the kind's rate in ``unseen``; ``entries`` lists by how much the others
    exceed theirs, as (number of the language, excess).
    """

    languages: list[str]
    unseen: dict[int, tuple[float, ...]]
    entries: dict[int, dict[str, tuple[tuple[int, float], ...]]]


def words_of(text: str) -> Counter:
    return Counter(_WORD.findall(text.lower()))


def grams_of(word: str, n: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


_COUNTS = [("lang", pa.string()), ("kind", pa.int32()), ("entry", pa.string()), ("n", pa.int64())]


def _counting(make):
    """A task that adds up what ``make`` gives for a batch, (lang, kind) and a Counter, and hands it on in pieces."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], Counter] = {}

        def rows() -> pa.RecordBatch:
            out = common.arrow_batch([(lang, kind, w, n) for (lang, kind), c in seen.items() for w, n in c.items()], _COUNTS)
            seen.clear()
            return out

        for batch in batches:
            for key, more in make(batch):
                seen.setdefault(key, Counter()).update(more)
                if len(seen[key]) > COUNTED:
                    yield rows()
        yield rows()

    return count


def _words(batch: pa.RecordBatch):
    for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
        yield (lang, 0), words_of(text)


def _grams(batch: pa.RecordBatch):
    for lang, word, k in zip(*[batch[c].to_pylist() for c in ("lang", "entry", "n")]):
        for n in LENGTHS:
            found: Counter = Counter()
            for g in grams_of(word, n):
                found[g] += k
            yield (lang, n), found


def fit(docs: DataFrame, sample: int = SAMPLE_DOCS) -> LanguageModel:
    """A model from the rows of ``docs`` (doc_id, text, lang) with a language and a text.

    Of each language, whatever their number, about ``sample`` documents are taken (all, if it has no more): those whose
    doc_id hashes below a share, so repeated rows are taken or left together. That is all that is sampled: their texts count
    as a whole. Entries are counted on the executors; the model takes the WORDS commonest words of every language and the
    GRAMS commonest n-grams of each length, so its size is in proportion to the number of languages.
    """
    common.prepare(docs.sparkSession)
    known = docs.where("lang is not null and text is not null").select("lang", F.xxhash64(F.lit(3), "doc_id").alias("draw"), "text")
    share = materialise(known.groupBy("lang").agg(F.count(F.lit(1)).alias("docs")), "languages")
    part = lookup_join(known, share, ["lang"], ["draw"], is_small(share))
    drawn = part.where(F.pmod("draw", F.lit(1 << 30)) * F.col("docs") < F.lit(float(sample)) * (1 << 30))
    schema, key = "lang string, kind int, entry string, n long", ["lang", "kind", "entry"]
    total = F.sum("n").alias("n")
    words = materialise(drawn.select("lang", "text").mapInArrow(_counting(_words), schema).groupBy(*key).agg(total), "words")
    grams = words.select("lang", "entry", "n").mapInArrow(_counting(_grams), schema).groupBy(*key).agg(total)
    counted = words.unionByName(materialise(grams, "grams"))

    place = F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "entry"))
    common_ones = counted.withColumn("place", place).where(F.col("place") <= F.when(F.col("kind") == 0, WORDS).otherwise(GRAMS))
    kept = counted.join(common_ones.select("kind", "entry").distinct(), ["kind", "entry"])
    different = dict(counted.groupBy("kind").agg(F.count_distinct("entry")).collect())
    sums = {(r["lang"], r["kind"]): r["n"] for r in counted.groupBy("lang", "kind").agg(total).collect()}
    languages = sorted({lang for lang, _ in sums})
    number = {lang: k for k, lang in enumerate(languages)}
    # half an occurrence is added to every entry of every language
    unseen = {kind: tuple(log(0.5 / (sums.get((lang, kind), 0) + 0.5 * d)) for lang in languages) for kind, d in different.items()}
    entries: dict[int, dict[str, tuple[tuple[int, float], ...]]] = {kind: {} for kind in different}
    for r in kept.toLocalIterator():
        own = entries[r["kind"]]
        own[r["entry"]] = (*own.get(r["entry"], ()), (number[r["lang"]], log(2 * r["n"] + 1)))
    return LanguageModel(languages, unseen, entries)


def word_scores(model: LanguageModel, word: str) -> tuple[int | None, tuple[tuple[int, float], ...]]:
    """The kind of entry that a word is scored by, and the excess of languages over the rate of unseen entries.

    That is the word itself if known, else the longest n-grams known, as a mean; None if nothing is known.
    """
    known = model.entries.get(0, {}).get(word)
    if known is not None:
        return 0, known
    for n in LENGTHS:
        grams = model.entries.get(n, {})
        found = [s for g in grams_of(word, n) if (s := grams.get(g)) is not None]
        if found:
            sums: dict[int, float] = {}
            for listed in found:
                for k, s in listed:
                    sums[k] = sums.get(k, 0.0) + s
            return n, tuple((k, s / len(found)) for k, s in sums.items())
    return None, ()


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred and score of every row of ``docs``, from the whole text alone.

    The score is the probability of the language among those known, from the mean word score. A null text, or one without
    letters, is ``und`` with score 0; so is any text if the model knows no language. Of equal scores the first
    language by name counts. Rows are judged one by one, so equal rows and null doc_ids need no care.
    """
    common.prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by WORDS and GRAMS for each language

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, cache = shared.value, {}
        for batch in batches:
            langs, scores = [], []
            for text in batch["text"].to_pylist():
                counts = words_of(text) if text and known.languages else None
                if not counts:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                sums, total, kinds = [0.0] * len(known.languages), 0, Counter()
                for word, n in counts.items():
                    found = cache.get(word)
                    if found is None:
                        if len(cache) > 200_000:
                            cache.clear()
                        found = cache[word] = word_scores(known, word)
                    total += n
                    kinds[found[0]] += n
                    for k, s in found[1]:
                        sums[k] += n * s
                for kind, n in kinds.items():
                    if kind is not None:
                        sums = [s + n * u for s, u in zip(sums, known.unseen[kind])]
                best = max(range(len(sums)), key=lambda k: (sums[k], -k))
                odds = [exp(max(-700.0, (s - sums[best]) / total)) for s in sums]
                langs.append(known.languages[best])
                scores.append(1.0 / sum(odds))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].cast(pa.int64()), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"]
            )

    return docs.select("doc_id", "text").mapInArrow(judge, "doc_id long, lang_pred string, score double")
