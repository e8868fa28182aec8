"""Statistics of whole texts, by byte-level kernels: counts of words, symbols, repeated lines and repeated word windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ripplegraph.llm import common

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_STARTS = np.array([(b & 0xC0) != 0x80 for b in range(256)])
_CLASS = {"upper": range(65, 91), "digit": range(48, 58), "punct": [b for b in range(33, 127) if not chr(b).isalnum()]}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_bytes", "n_chars", "n_lines", "n_upper", "n_digit", "n_punct", "n_distinct_words"]


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(values, dtype=np.int64))
    return total[edges[1:]] - total[edges[:-1]]


def _equal_to_another(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is there twice or more, and whether it is not the first of its kind."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice, later


def text_statistics(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The figures named in COUNTS and MORE for each text. Words lie between ASCII white space.

    Words, lines and windows of words are compared within a text by 64-bit hashes.
    """
    out = {n: np.zeros(len(texts), np.int64) for n in COUNTS + MORE}
    for a, b in common.slices(texts, 1 << 20):
        buf, starts = common.joined(texts[a:b])
        n = b - a
        edges = np.append(starts, len(buf))
        space = common.SPACES[buf]
        first, last, doc = common.spans(space, starts)
        of = lambda name, values: out[name].__setitem__(slice(a, b), values)
        words = common.span_hashes(buf, first, last)
        of("n_words", np.bincount(doc, minlength=n))
        of("word_chars", _sums(_STARTS[buf] & ~space, edges))
        of("n_symbols", _sums(_SYMBOLS[buf], edges))
        of("n_bytes", np.diff(edges) - 1)
        of("n_chars", _sums(_STARTS[buf], edges) - 1)
        for kind, members in _CLASS.items():
            table = np.zeros(256, bool)
            table[list(members)] = True
            of(f"n_{kind}", _sums(table[buf], edges))
        salt = common.mix(np.arange(n, dtype=np.uint64))
        _, later = _equal_to_another(words + salt[doc])
        of("n_distinct_words", np.bincount(doc[~later], minlength=n))
        # lines with a word; the line break added after each text ends its last line
        l_first, l_last, l_doc = common.spans(buf == 10, starts)
        filled = np.searchsorted(first, l_first) < np.searchsorted(first, l_last)
        l_first, l_last, l_doc = l_first[filled], l_last[filled], l_doc[filled]
        _, later = _equal_to_another(common.span_hashes(buf, l_first, l_last) + salt[l_doc])
        of("n_lines", np.bincount(l_doc, minlength=n))
        of("n_dup_lines", np.bincount(l_doc[later], minlength=n))
        if len(words) >= 3:
            grams = common.mix(common.mix(words[:-2] + np.uint64(1)) + words[1:-1]) + words[2:]
            inside = np.flatnonzero(doc[:-2] == doc[2:])
            twice, _ = _equal_to_another(common.mix(grams[inside]) + salt[doc[inside]])
            steps = np.zeros(len(words) + 1, np.int32)
            np.add.at(steps, inside[twice], 1)
            np.add.at(steps, inside[twice] + 3, -1)
            of("n_repeat_words", np.bincount(doc[np.cumsum(steps[:-1]) > 0], minlength=n))
    return out


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every row of ``docs``; a null text has none of anything."""
    common.prepare(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = text_statistics(common.as_bytes(batch["text"]))
            names = COUNTS + MORE
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), *(pa.array(found[n]) for n in names)], ["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, " + ", ".join(f"{n} long" for n in COUNTS + MORE))
