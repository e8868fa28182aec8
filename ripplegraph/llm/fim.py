"""Fill-in-the-middle: a text cut at two of its token ends, with the middle put last.

The ends of a text's tokens form a set of byte offsets, kept in containers of 65,536 offsets each: a sorted array where
ends are few, a bitmap where they are many, runs where they follow one another. With the cumulative sizes of the
containers the k-th end is found by a search for its container and a selection inside it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.llm import common

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CHUNK = 1 << 16
# Values up to which a container stays an array: beyond, a bitmap of 8 KB is smaller.
ARRAY = 4_096


@dataclass(frozen=True)
class ArrayContainer:
    values: np.ndarray  # uint16, ascending

    def select(self, k: int) -> int:
        return int(self.values[k])


@dataclass(frozen=True)
class RunContainer:
    first: np.ndarray  # uint16, first value of each run
    before: np.ndarray  # values in the runs before it

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.first[run]) + k - int(self.before[run])


@dataclass(frozen=True)
class BitmapContainer:
    words: np.ndarray  # uint64, 1,024 of them
    before: np.ndarray  # bits set in the words before

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, "right")) - 1
        word = int(self.words[at])
        for _ in range(k - int(self.before[at])):
            word &= word - 1
        return 64 * at + (word & -word).bit_length() - 1


def container(values: np.ndarray) -> ArrayContainer | RunContainer | BitmapContainer:
    """The smallest form of ascending 16-bit values: 4 bytes a run, 2 a value, or 8 KB."""
    starts = np.flatnonzero(np.append(True, np.diff(values.astype(np.int32)) != 1))
    if 4 * len(starts) < min(2 * len(values), CHUNK // 8):
        return RunContainer(values[starts], starts)
    if len(values) <= ARRAY:
        return ArrayContainer(values)
    bits = np.zeros(CHUNK, np.uint8)
    bits[values] = 1
    words = np.packbits(bits, bitorder="little").view("<u8")
    return BitmapContainer(words, np.append(0, np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]))


class BoundarySet:
    """A set of offsets in ascending order, selected by rank."""

    def __init__(self, offsets: np.ndarray):
        chunk = offsets >> 16
        cuts = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1])) if len(offsets) else np.zeros(0, np.int64)
        low = (offsets & (CHUNK - 1)).astype(np.uint16)
        self.keys = chunk[cuts]
        self.containers = [container(x) for x in np.split(low, cuts[1:])] if len(offsets) else []
        self.before = np.append(cuts, len(offsets))

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        """The offset of rank ``k``, from 0."""
        at = int(np.searchsorted(self.before, k, "right")) - 1
        return (int(self.keys[at]) << 16) + self.containers[at].select(k - int(self.before[at]))

    def cut(self, units: int) -> int:
        """Where the first ``units`` units end."""
        return self.select(units - 1) if units else 0


def token_ends(data: bytes) -> np.ndarray:
    """Byte offsets where the tokens of a UTF-8 text end: at the last byte of each run of other characters, and of white
    space at the end of the text."""
    if not data:
        return np.zeros(0, np.int64)
    space = common.SPACES[np.frombuffer(data, np.uint8)]
    ends = ~space
    ends[:-1] &= space[1:]
    ends[-1] = True
    return np.flatnonzero(ends) + 1


def _draws(seed: int) -> Column:
    """Four unsigned 32-bit numbers from the seed and the document's id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def transformed(docs: DataFrame, seed: int = 42, share: int = 50, spm_share: int = 80) -> DataFrame:
    """Every document: doc_id, n (its tokens), form, prefix_chars, middle_chars and output.

    ``docs`` has doc_id and text; other columns are ignored. ``share`` percent of the texts are cut, of these
    ``spm_share`` percent with the suffix first (``spm``), the others with the prefix first (``psm``). The rest are
    ``plain``, as are empty texts and those that hold a marker: output is the text, the two lengths are null. A null text
    counts as empty. Draws depend on seed and doc_id alone: repeated rows come out alike, and a null doc_id draws like
    an empty one.
    """
    common.prepare(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    held = (text == "") | F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    drawn = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), _draws(seed).alias("h"))
    form = F.when(held | (F.col("h")[2] % 100 >= share), "plain").when(F.col("h")[3] % 100 < spm_share, "spm").otherwise("psm")

    kinds = [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.binary())]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            texts = common.as_bytes(batch["text"])
            for doc_id, data, form, a, b in zip(batch["doc_id"].to_pylist(), texts, *[batch[c].to_pylist() for c in ("form", "h1", "h2")]):
                ends = token_ends(data)
                if form == "plain":
                    rows.append((doc_id, len(ends), form, None, None, data))
                    continue
                bounds = BoundarySet(ends)
                low, high = sorted((a % (len(bounds) + 1), b % (len(bounds) + 1)))
                at, to = bounds.cut(low), bounds.cut(high)
                prefix, middle, suffix = data[:at], data[at:to], data[to:]
                parts = (b"<S>", suffix, b"<P>", prefix) if form == "spm" else (b"<P>", prefix, b"<S>", suffix)
                rows.append((doc_id, len(bounds), form, len(prefix.decode()), len(middle.decode()), b"".join((*parts, b"<M>", middle))))
            yield common.arrow_batch(rows, kinds)

    sent = drawn.select("doc_id", "text", form.alias("form"), F.col("h")[0].alias("h1"), F.col("h")[1].alias("h2"))
    found = sent.mapInArrow(cut, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return found.withColumn("output", F.col("output").cast("string"))


def restored() -> Column:
    """The text that ``output`` was made from, by its ``form``: no piece holds a marker, so the markers split it."""
    parts = F.split("output", f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return (
        F.when(F.col("form") == "psm", F.concat(parts[1], parts[3], parts[2]))
        .when(F.col("form") == "spm", F.concat(parts[2], parts[3], parts[1]))
        .otherwise(F.col("output"))
    )
