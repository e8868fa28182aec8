"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

The encoding of a prefix of a word ends in one token only, whatever follows. So the last token of every prefix is found from
left to right: of the tokens that end there, the one that is compatible with the last token of the prefix before it, that
is, where encoding the two tokens' characters together gives just these two. Back-pointers then lead from the end of the
word to its start. Tokens that end at a place come from an automaton with suffix links over the vocabulary, in time
proportional to the word and its matches, so a word of a megabyte is no worse than its letters.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import count
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ripplegraph.llm import common

# Distinct words whose ids a worker remembers, and the longest that it remembers.
CACHE, CACHED_LENGTH = 300_000, 64
# Pairs of tokens whose compatibility a worker remembers.
PAIRS = 1_000_000
# Ids that leave a worker in one batch.
HELD = 1 << 20
# Code points below this one are split by rules stated here; texts with others go through the tokenizer's own splitter.
SIMPLE = 0x180


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself where it prints, else the next one from 256 on."""
    printed = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = count(256)
    return {b: chr(b if b in printed else next(other)) for b in range(256)}


class Vocabulary:
    """Tokens, merges and the matching automaton of a tokenizer file with word-end marks.

    A word's letters are its bytes, the last one marked: ``chr(b)`` within the word and ``chr(256 + b)`` at its end.
    """

    def __init__(self, model: dict):
        ids, end = model["vocab"], model["end_of_word_suffix"] or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        size = max(ids.values()) + 1
        self.text = [""] * size
        for token, i in ids.items():
            self.text[i] = token
        # the symbols that no merge makes, one per byte within a word and one per byte at its end
        symbols: list[str | None] = [None] * size
        for byte, letter in byte_letters().items():
            symbols[ids[letter]] = chr(byte)
            symbols[ids[letter + end]] = chr(256 + byte)
        self.halves = [(i, i) for i in range(size)]
        self.pairs: dict[tuple[int, int], int] = {}
        before = -1
        for left, right in merges:
            a, b, made = ids[left], ids[right], ids[left + right]
            if made <= before or symbols[a] is None or symbols[b] is None:
                raise ValueError("merges must make tokens in the order of their ids")
            self.halves[made], self.pairs[a, b], symbols[made], before = (a, b), made, symbols[a] + symbols[b], made
        self.size = size
        self.tested: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        # Tokens that their own characters are encoded as: their halves are such tokens, and meet. Others never occur.
        whole = [True] * size
        for i, symbol in enumerate(symbols):
            left, right = self.halves[i]
            whole[i] = symbol is not None and (left == i or (whole[left] and whole[right] and self._compatible(left, right, i)))
            if whole[i]:
                self.automaton.add_word(symbol, (len(symbol), i))
        self.automaton.make_automaton()

    def _compatible(self, left: int, right: int, limit: int | None = None) -> bool:
        """Whether no merge across the border of two tokens comes before the merges that make them.

        Both tokens are taken apart again, the later merge first. A merge across the border that stands before the one
        undone last would have been made. ``limit`` is the first merge that no longer matters.
        """
        halves, pairs = self.halves, self.pairs
        limit = len(halves) if limit is None else limit
        while True:
            made = pairs.get((left, right))
            if made is not None and made < limit:
                return False
            if left > right and halves[left][0] != left:
                limit, left = left, halves[left][1]
            elif halves[right][0] != right:
                # of two equal merges that overlap, the left one is made
                limit, right = right + 1, halves[right][0]
            elif halves[left][0] != left:
                limit, left = left, halves[left][1]
            else:
                return True

    def encode(self, word: str) -> list[int]:
        """Ids of a word given as letters."""
        size, tested = self.size, self.tested
        if len(tested) > PAIRS:
            tested.clear()
        # the last token of each prefix, and its length; the empty prefix comes last, at -1
        last, length = [-1] * (len(word) + 1), [0] * (len(word) + 1)
        for at, (n, token) in self.automaton.iter(word):
            if last[at] >= 0:
                continue
            before = at - n
            if before >= 0:
                left = last[before]
                if left < 0:
                    continue
                pair = left * size + token
                fits = tested.get(pair)
                if fits is None:
                    fits = tested[pair] = self._compatible(left, token)
                if not fits:
                    continue
            last[at], length[at] = token, n
        ids, at = [], len(word) - 1
        while at >= 0:
            ids.append(last[at])
            at -= length[at]
        ids.reverse()
        return ids


def _class(kinds: str) -> str:
    """A character class of the simple code points of a general category."""
    found = [chr(c) for c in range(SIMPLE) if unicodedata.category(chr(c)).startswith(kinds)]
    return "".join(map(re.escape, found))


class Encoder:
    """Ids of whole texts as a tokenizer file gives them, without its special tokens added around the text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        setup = json.loads(Path(path).read_text(encoding="utf-8"))
        kinds = [n["type"] for n in (setup["normalizer"] or {}).get("normalizers", [])]
        if kinds != ["NFC", "Replace", "Lowercase"] or setup["model"].get("dropout") or setup["model"].get("ignore_merges"):
            raise ValueError("the file must hold a lower-casing byte-pair tokenizer of whole words")
        self.vocabulary = Vocabulary(setup["model"])
        self.tokenizer = Tokenizer.from_file(path)
        self.added = {t["content"]: t["id"] for t in setup["added_tokens"]}
        tokens = sorted(self.added, key=len, reverse=True)
        self.outside = re.compile(f"({'|'.join(map(re.escape, tokens))})") if tokens else None
        # white space of the simple code points, as the tokenizer's pattern has it
        blank = r"\t-\r \x85\xa0"
        letter, number = _class("L"), _class("N")
        self.words = re.compile(f"[{letter}]+|'(?:[stmd]|re|ve|ll)|[{number}]|[^{blank}{letter}{number}]+")
        # U+0130 becomes two code points in lower case, one of them not simple
        self.odd = re.compile(f"[^\\x00-\\u012f\\u0131-{chr(SIMPLE - 1)}]")
        self.letters = {letter: b for b, letter in byte_letters().items()}
        self.known: dict[str, bytes] = {}
        self.strange: dict[str, bytes] = {}

    def _ids(self, data: bytes) -> bytes:
        word = data[:-1].decode("latin-1") + chr(256 + data[-1])
        return array("I", self.vocabulary.encode(word)).tobytes()

    def _looked_up(self, words: list[str], known: dict[str, bytes], data) -> list[bytes]:
        out = [known.get(w) for w in words]
        if None in out:
            fresh = {w: self._ids(data(w)) for w in {w for w, x in zip(words, out) if x is None}}
            out = [x if x is not None else fresh[w] for w, x in zip(words, out)]
            if len(known) + len(fresh) > CACHE:
                known.clear()
            known.update((w, x) for w, x in list(fresh.items())[:CACHE] if len(w) <= CACHED_LENGTH)
        return out

    def _segment(self, text: str) -> list[bytes]:
        """Ids of a text without added tokens, word by word."""
        if self.odd.search(text) is None:
            return self._looked_up(self.words.findall(text.lower()), self.known, str.encode)
        clean = self.tokenizer.normalizer.normalize_str(text)
        words = [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(clean)]
        return self._looked_up(words, self.strange, lambda w: bytes(map(self.letters.__getitem__, w)))

    def ids(self, text: str) -> bytes:
        """The ids of a text as unsigned 32-bit numbers. Added tokens in it stand for themselves."""
        if self.outside is None or not any(t in text for t in self.added):
            return b"".join(self._segment(text))
        out = []
        for part in self.outside.split(text):
            out += [array("I", [self.added[part]]).tobytes()] if part in self.added else self._segment(part)
        return b"".join(out)

    def text(self, ids: list[int]) -> str:
        """Tokens of the ids with a blank between them, as a tokenizer without decoder gives them; unknown ids are left out."""
        names = self.names()
        return " ".join([names[i] for i in ids if i in names])

    def names(self) -> dict[int, str]:
        if not hasattr(self, "_names"):
            self._names = {i: t for i, t in enumerate(self.vocabulary.text) if t} | {i: t for t, i in self.added.items()}
        return self._names


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a file, built once per worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """Every document's doc_id, n_tokens and ids (unsigned 32-bit, little-endian) by a tokenizer file.

    ``docs`` has doc_id and text; other columns are ignored. A null text counts as empty, and an empty text has no ids.
    Repeated rows and rows without a doc_id come out as they are, each on its own.
    """
    kinds = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                ids = words.ids(text or "")
                rows.append((doc_id, len(ids) // 4, ids))
                held += len(ids) // 4
                if held > HELD:
                    yield common.arrow_batch(rows, kinds)
                    rows, held = [], 0
            yield common.arrow_batch(rows, kinds)

    common.prepare(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(encode, "doc_id long, n_tokens long, ids binary")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` of :func:`encoded` with the text of their ids in the column ``decoded``; null ids count as none."""
    kinds = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        for batch in batches:
            out, held = [], 0
            for doc_id, n, ids in zip(*[batch[c].to_pylist() for c in ("doc_id", "n_tokens", "ids")]):
                out.append((doc_id, n, ids, words.text(np.frombuffer(ids or b"", np.uint32).tolist())))
                held += n or 0
                if held > HELD:
                    yield common.arrow_batch(out, kinds)
                    out, held = [], 0
            yield common.arrow_batch(out, kinds)

    return rows.select("doc_id", "n_tokens", "ids").mapInArrow(decode, "doc_id long, n_tokens long, ids binary, decoded string")
