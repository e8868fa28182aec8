"""Packing token sequences into as few bins as possible, by hierarchical residual packing.

Texts are tokenized and cut into pieces. Each partition packs its pieces best-fit, largest first. Bins that are
nearly full are final. The others become items themselves and meet those of other partitions in a tree of
rounds, again best-fit, with fewer tasks each round. A bin travels with its list of pieces, at most ``capacity`` many.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from itertools import count as numbers
from math import ceil
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.llm import common
from ripplegraph.session import materialise

# Underfull bins that one task packs in a round, and pieces in the first round.
ROUND_ITEMS, FIRST_ITEMS = 50_000, 100_000
# Distinct words whose ids a worker remembers.
CACHE = 300_000


def _from_ranks(path: Path):
    """An encoder of single words from a file of ranks."""
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, path.open("rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda word: array("I", own.encode_ordinary(word)).tobytes()


class _Known(dict):
    """Ids by word. A word that isn't there yet is encoded with the space before it."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self.encode(" " + word)
        return ids


class _Words:
    """Ids of texts, with the ids of words remembered.

    A byte-level tokenizer splits before each single space, so the ids of a text are those of its words, each
    with the space before it. Texts where white space is followed by a space at an end or in a run are encoded whole, as are
    those that hold one of the tokenizer's added tokens, which it takes out before it splits.
    Where the vocabulary lies beside the tokenizer as ranks too, single words are encoded from these, which is faster
    and gives the same ids.
    """

    def __init__(self, path: str):
        import re

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.runs = re.compile(r"\s (?:\s|$)|[\x1c-\x1f\x85]")
        ranks = Path(path).with_suffix(".tiktoken")
        self.batched = not ranks.exists()
        self.known = _Known(self.single if self.batched else _from_ranks(ranks))

    def single(self, text: str) -> bytes:
        return self.encode([text])[0]

    def encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.uint32).tobytes() for e in found]

    def ids(self, text: str) -> bytes:
        if self.runs.search(text) or any(t in text for t in self.added):
            return self.single(text)
        words = text.split(" ")
        known = self.known
        first = words[0]
        words[0] = ""
        if len(known) > CACHE:
            known.clear()
        if self.batched:
            missing = list(set(words) - known.keys())
            known.update(zip(missing, self.encode([" " + w for w in missing])))
        out = list(map(known.__getitem__, words))
        out[0] = self.single(first) if first else b""
        return b"".join(out)


_WORDS: dict[str, _Words] = {}


def tokenized(docs: DataFrame, path: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every document: doc_id, piece, start, length, ids (unsigned 32-bit, little-endian).

    A document's ids are those of its whole text and then ``end``; a null text counts as empty. Only a document that is
    longer than ``capacity`` is cut, into pieces of that length, of which the first takes what is left over.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _WORDS:
            _WORDS[path] = _Words(path)
        words = _WORDS[path]
        last = np.array([end], np.uint32).tobytes()
        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                ids = words.ids(text or "") + last
                n = len(ids) // 4
                cut = 0 if n <= capacity else n % capacity
                starts = [0, *range(cut, n, capacity)] if cut else list(range(0, n, capacity))
                for piece, (a, b) in enumerate(zip(starts, [*starts[1:], n])):
                    rows.append((doc_id, piece, a, b - a, ids[4 * a : 4 * b]))
                    held += b - a
                if held > 1 << 20:
                    yield _pieces(rows)
                    rows, held = [], 0
            if rows:
                yield _pieces(rows)

    common.prepare(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, piece int, start long, length long, ids binary")


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())]
    return common.arrow_table(rows, kinds).combine_chunks().to_batches()[0]


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of each item by best fit, largest first. Open bins are kept by the room left, as a bit set."""
    bins = np.empty(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, used = 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            found = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, found = capacity, used
            used += 1
        bins[i] = found
        left = room - size
        if left:
            by_room[left].append(found)
            rooms |= 1 << left
    return bins


_KINDS = {"doc_id": ("long", pa.int64()), "piece": ("int", pa.int32()), "id": ("long", pa.int64()), "length": ("long", pa.int64())}


def _packer(capacity: int, names: list[str]):
    kind = pa.list_(pa.struct([(n, _KINDS[n][1]) for n in names]))

    def pack(table: pa.Table) -> pa.Table:
        sizes, items = table["fill"].to_numpy(), table["items"].combine_chunks()
        bins = best_fit(sizes, capacity)
        order = np.argsort(bins, kind="stable")
        edges = np.flatnonzero(np.append(True, bins[order][1:] != bins[order][:-1]))
        moved = items.take(pa.array(order))
        ends = np.append(0, np.cumsum(pa.compute.list_value_length(moved).to_numpy()))
        offsets = np.append(ends[edges], ends[-1]).astype(np.int32)
        fill = np.add.reduceat(sizes[order], edges)
        return pa.table({"fill": pa.array(fill, pa.int64()), "items": pa.ListArray.from_arrays(offsets, moved.flatten()).cast(kind)})

    return pack


def packed(pieces: DataFrame, capacity: int = 2048, full: float = 0.99) -> DataFrame:
    """Place of every piece: doc_id, piece, length, sequence_id and offset.

    ``pieces`` has doc_id, piece and length (from 1 to ``capacity``; a longer one is an error, since it fits nowhere);
    other columns are ignored. Bins filled to the share ``full`` are final after each round. Rounds
    end when one task holds what is left, or when a round saves no bin.
    A piece that is there twice is packed twice; a null doc_id is packed like any other; no pieces give no rows.
    """
    return _placed(pieces, ["doc_id", "piece"], capacity, full)


def _placed(pieces: DataFrame, names: list[str], capacity: int, full: float = 0.99) -> DataFrame:
    """As ``packed``, with the columns ``names`` to tell the pieces by."""
    common.prepare(pieces.sparkSession)
    names = [*names, "length"]
    length = F.when(F.col("length").between(1, capacity), F.col("length")).otherwise(
        F.raise_error(F.lit("a piece must have from 1 to capacity tokens")).cast("long")
    )
    item = F.struct(*[(length if n == "length" else F.col(n)).cast(_KINDS[n][0]).alias(n) for n in names])
    items = f"array<struct<{', '.join(f'{n}: {_KINDS[n][0]}' for n in names)}>>"
    rest = pieces.select(length.alias("fill"), F.array(item).alias("items"))
    whole = materialise(rest.where(F.col("fill") == capacity), "whole")
    rest = materialise(rest.where(F.col("fill") < capacity), "items")
    done, count, each = [whole], rest.count(), FIRST_ITEMS
    while count:
        tasks = ceil(count / each)
        dealt = rest.repartition(tasks, F.xxhash64("items")).withColumn("task", F.spark_partition_id())
        bins = materialise(dealt.groupBy("task").applyInArrow(_packer(capacity, names), f"fill long, items {items}"), "bins")
        final = F.lit(True) if tasks == 1 else F.col("fill") >= int(full * capacity)
        done.append(bins.where(final))
        rest = bins.where(~final)
        before, count, each = count, (0 if tasks == 1 else rest.count()), ROUND_ITEMS
        if count >= before:
            done.append(rest)
            break
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    every = materialise(every.select(F.monotonically_increasing_id().alias("sequence_id"), "items"), "sequences")
    sums = F.aggregate(
        F.transform("items", lambda x: x["length"]),
        F.array(F.lit(0).cast("long")),
        lambda seen, n: F.concat(seen, F.array(F.element_at(seen, -1) + n)),
    )
    rows = every.select("sequence_id", F.explode(F.arrays_zip(F.col("items"), F.slice(sums, 1, F.size("items")).alias("offset"))).alias("x"))
    return rows.select(*[f"x.items.{n}" for n in names], "sequence_id", F.col("x.offset").alias("offset"))


def packed_with(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Pieces with all their columns, stored once, and the sequence and offset of each.

    Each stored row has a number of its own, by which it meets its place: rows may share doc_id and piece, or have none.
    """
    own = next(n for n in map("_row{}".format, numbers()) if n not in pieces.columns)
    stored = materialise(pieces.withColumn(own, F.monotonically_increasing_id()), "pieces")
    places = _placed(stored.select(F.col(own).alias("id"), "length"), ["id"], capacity)
    return stored.join(places.select(F.col("id").alias(own), "sequence_id", "offset"), own).drop(own)
