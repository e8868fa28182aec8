"""Exact substring removal with suffix arrays built by grouping Lyndon prefixes.

Every 50-byte window of every text is sent to a bucket by a hash that only its own bytes decide: the smallest hash of
its 25-byte strings. Neighbouring windows with the same smallest hash travel as one piece of at most 75 bytes.

1. Blocks of documents and buckets of hashes exchange which hashes occur in several documents; other windows can't repeat.
2. Blocks send the different pieces that have such a hash, each with the smallest document holding it. In a bucket, pieces
   with one hash are concatenated, their suffixes are sorted by ``suffix_order``, and runs of suffixes that agree in 50
   bytes give, per window, the smallest document it starts in.
   Pieces of a hash with more than 2^HOT different ones are sent as single windows instead, each by the hash of its own 50
   bytes: equal windows still meet, but a string that many documents have in differing surroundings meets in no one task.
3. Blocks learn by a bit per window whether a smaller document has it, and remove the bytes covered.

The exchange of texts into blocks is made once and read by each of the three passes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ripplegraph.llm import common

BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 16 << 20
# Bytes of pieces whose suffixes are sorted at once; more only for pieces with one hash.
SORT_BYTES = 1 << 20
# Doubling class of the number of pieces with one hash from which they are parted into windows.
HOT = 14
_CHUNK = 1 << 16


def suffix_order(text: list[int]) -> list[int]:
    """The order of all suffixes of ``text``, by linear grouping.

    ``text`` consists of pieces that each end in a 0; other symbols are greater. A 0 counts as greater than
    any later 0, so no comparison reaches beyond a piece's end.

    First, suffixes are grouped by their longest Lyndon prefix. Groups start as one per first symbol and are taken in
    descending order. The previous smaller suffix of each member is its parent, found along pointers over
    suffixes already taken. A parent's prefix grows by the member's prefix, so parents leave their group for new ones
    just above it, one per number of members they have; a group of which all members would go to one new group stays. Then suffixes are emitted in ascending order: after a suffix
    come into place, each at the next free place of its group, all those whose Lyndon prefix ends where it starts.
    """
    n = len(text)
    symbols = sorted(set(text) - {0})
    # groups: members as they joined, and the next lower and higher group
    members: list[list[int]] = [[] for _ in symbols]
    number = {s: g for g, s in enumerate(symbols)}
    group = [-1] * n
    for i, s in enumerate(text):
        if s:
            g = group[i] = number[s]
            members[g].append(i)
    lower = [g - 1 for g in range(len(symbols))]
    higher = [g + 1 for g in range(len(symbols))]
    top = len(symbols) - 1
    if top >= 0:
        higher[top] = -1
    sizes = [len(m) for m in members]
    parent, taken = [-1] * n, [False] * n
    current, ascending = top, []
    while current >= 0:
        if sizes[current]:
            own = members[current]
            if len(own) > sizes[current]:
                own = [i for i in own if group[i] == current]
            if len(own) > 1:
                own.sort()
            ascending.append(current)
            for i in own:
                taken[i] = True
            many: dict[int, int] = {}
            for i in own:
                p = i - 1
                while p >= 0 and taken[p]:
                    p = parent[p]
                if p >= 0 and not text[p]:
                    p = -1
                parent[i] = p
                if p >= 0:
                    many[p] = many.get(p, 0) + 1
            fresh: dict[tuple[int, int], list[int]] = {}
            for p, k in many.items():
                old = group[p]
                if sizes[old] > 1:  # a suffix alone in its group needs no other
                    fresh.setdefault((k, old), []).append(p)
            above: dict[int, int] = {}
            for k, old in sorted(fresh) if len(fresh) > 1 else fresh:
                moved = fresh[k, old]
                if len(moved) == sizes[old] and old not in above:  # all of the group moves on alike
                    continue
                below = above.get(old, old)
                new = above[old] = len(members)
                members.append(moved)
                sizes.append(len(moved))
                sizes[old] -= len(moved)
                for p in moved:
                    group[p] = new
                up = higher[below]
                lower.append(below)
                higher.append(up)
                higher[below] = new
                if up >= 0:
                    lower[up] = new
        current = lower[current]
    ascending.reverse()

    ends = [i for i, s in enumerate(text) if not s]
    places: list[list[int]] = [[] for _ in members]
    for end in reversed(ends):
        j = end - 1
        while j >= 0 and text[j]:
            places[group[j]].append(j)
            j = parent[j]
    order = ends[::-1]
    for g in ascending:
        for s in places[g]:
            order.append(s)
            j, stop = s - 1, parent[s]
            while j >= 0 and j != stop and text[j]:
                places[group[j]].append(j)
                j = parent[j]
    return order


def _rolling_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :])


class _Pieces:
    """The pieces of the texts of a block: hash, place, windows, and number of the text."""

    def __init__(self, table: pa.Table, length: int):
        seed, width = length // 2, length - length // 2 + 1
        table = common.ordered(table)
        self.texts, self.length = common.as_bytes(table["text"]), length
        self.ids = table["doc_id"].to_pylist()
        # 0xFF ends a text: it doesn't occur in UTF-8
        self.buf = np.frombuffer(b"".join(t + b"\xff" for t in self.texts), np.uint8)
        sizes = np.fromiter(map(len, self.texts), np.int64, len(self.texts))
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        steps = np.zeros(len(self.buf) + 1, np.int8)
        whole = np.array([d is not None for d in self.ids], bool) & (sizes >= length)
        steps[self.starts[whole]] += 1
        steps[self.starts[whole] + sizes[whole] - length + 1] -= 1
        valid = np.cumsum(steps[:-1], dtype=np.int8) > 0
        keys, places, windows = [], [], []
        up, down = common._powers(_CHUNK + 2 * length)
        for at in range(0, len(self.buf) - length + 1, _CHUNK):
            some = self.buf[at : at + _CHUNK + length - 1]
            sums = np.zeros(len(some) + 1, np.uint64)
            np.cumsum(some * up[: len(some)], out=sums[1:])
            hashes = common.mix((sums[seed:] - sums[:-seed]) * down[: len(some) - seed + 1])
            least = _rolling_min(hashes, width)
            ok = valid[at : at + len(least)]
            change = np.append(True, (least[1:] != least[:-1]) | (ok[1:] != ok[:-1]))
            first = np.flatnonzero(change)
            count = np.diff(np.append(first, len(least)))
            key, first, count = least[first][ok[first]], first[ok[first]], count[ok[first]]
            parts = -(-count // width)
            if len(parts) and parts.max() > 1:  # long runs come from texts with a short period
                inside = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                key, first, count = (np.repeat(x, parts) for x in (key, first, count))
                first, count = first + inside * width, np.minimum(count - inside * width, width)
            keys.append(key)
            places.append(first + at)
            windows.append(count)
        none = np.zeros(0, np.int64)
        self.key = common.mix(np.concatenate([np.zeros(0, np.uint64), *keys]))
        self.place, self.windows = np.concatenate([none, *places]), np.concatenate([none, *windows])
        counts = np.diff(np.append(np.searchsorted(self.place, self.starts), len(self.place)))
        self.doc = np.repeat(np.arange(len(self.texts)), counts)

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct hashes, and the number of different pieces (at least 2) for those in several documents, else 1."""
        order = np.argsort(self.key, kind="stable")
        key, doc = self.key[order], self.doc[order]
        if not len(key):
            return key, np.zeros(0, np.int64)
        fresh = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        last = np.append(fresh[1:], len(key)) - 1
        several = doc[fresh] != doc[last]
        counts = np.where(several, 2, 1)
        many = several & (last - fresh > 1)
        number = np.repeat(np.arange(len(fresh)), last - fresh + 1)
        which = np.flatnonzero(many[number])
        some, number = order[which], number[which]
        by_place = np.argsort(some)
        some, number = some[by_place], number[by_place]
        content = _overlapping_hashes(self.buf, self.place[some], self.place[some] + self.length - 1 + self.windows[some])
        ranked = np.lexsort((content, number))
        number, content = number[ranked], content[ranked]
        other = np.append(True, (number[1:] != number[:-1]) | (content[1:] != content[:-1]))[: len(number)]
        return key[fresh], np.maximum(counts, np.bincount(number[other], minlength=len(fresh)))

    def _part(self, hot: np.ndarray) -> None:
        """Each window of the pieces marked becomes a piece of its own, with the hash of its bytes."""
        parts = np.where(hot, self.windows, 1)
        inside = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        single = np.repeat(hot, parts)
        self.place, self.doc, self.key = np.repeat(self.place, parts) + inside, np.repeat(self.doc, parts), np.repeat(self.key, parts)
        self.windows = np.where(single, 1, np.repeat(self.windows, parts))
        place = self.place[single]
        self.key[single] = common.mix(_overlapping_hashes(self.buf, place, place + self.length))

    def repeated(self, replies: pa.Table, ranges: int, hot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The different pieces that may repeat (as an example of each), the smallest text of each, and each piece's number.

        Pieces whose hash has the class ``hot`` or a higher one are parted first.
        """
        keys = np.unique(self.key)
        classes = common.classes_of(keys, replies, ranges)
        own = classes[np.searchsorted(keys, self.key)] if len(keys) else np.zeros(0, np.uint8)
        if (own >= hot).any():
            windows = self.windows
            self._part(own >= hot)
            own = np.repeat(own, np.where(own >= hot, windows, 1))
        some = np.flatnonzero(own > 0)
        ends = self.place[some] + self.length - 1 + self.windows[some]
        content = _overlapping_hashes(self.buf, self.place[some], ends)
        order = np.lexsort((self.doc[some], content, self.key[some]))
        some, content = some[order], content[order]
        key = self.key[some]
        fresh = np.append(True, (key[1:] != key[:-1]) | (content[1:] != content[:-1]))[: len(some)]
        return some[fresh], some, np.cumsum(fresh) - 1


def _overlapping_hashes(buf: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """As ``common.span_hashes``, for short spans that may overlap."""
    out = np.empty(len(first), np.uint64)
    up, down = common._powers(2 * _CHUNK)
    for at in range(0, len(buf), _CHUNK):
        a, b = np.searchsorted(first, [at, at + _CHUNK])
        if b > a:
            some = buf[at : at + 2 * _CHUNK]
            sums = np.zeros(len(some) + 1, np.uint64)
            np.cumsum(some * up[: len(some)], out=sums[1:])
            f, e = first[a:b] - at, last[a:b] - at
            out[a:b] = (sums[e] - sums[f]) * down[f] + (e - f).astype(np.uint64)
    return common.mix(out)


_PIECES = "bucket int, block int, keys binary, sizes binary, content binary, docs binary"


def _offer_pieces(length: int, plan: common.Exchange, hot: int):
    def offer(docs: pa.Table, replies: pa.Table) -> pa.Table:
        rows = []
        if docs.num_rows:
            pieces = _Pieces(docs, length)
            different, _, _ = pieces.repeated(replies, plan.ranges, hot)
            bounds = common.bucket_bounds(pieces.key[different], plan.buckets)
            ids = np.array([0 if d is None else d for d in pieces.ids], np.int64)
            block = docs["block"][0].as_py()
            for b in common.filled(bounds):
                own = different[bounds[b] : bounds[b + 1]]
                sizes = pieces.windows[own] + length - 1
                inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                content = pieces.buf[np.repeat(pieces.place[own], sizes) + inside]
                keys = (pieces.key[own] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                rows.append((b, block, keys.tobytes(), sizes.astype(np.uint8).tobytes(), content.tobytes(), ids[pieces.doc[own]].tobytes()))
        kinds = [("bucket", pa.int32()), ("block", pa.int32())] + [(n, pa.binary()) for n in ("keys", "sizes", "content", "docs")]
        return common.arrow_table(rows, kinds)

    return offer


def _seeds(buf: np.ndarray, place: np.ndarray, windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Where in each piece the string with the smallest hash starts, and whether it is there only once."""
    seed = length // 2
    up, down = common._powers(_CHUNK + 2 * length)
    at, once = np.empty(len(place), np.int64), np.empty(len(place), bool)
    for i in range(0, len(place), 1 << 14):
        some = slice(i, i + (1 << 14))
        n = windows[some] + length - 1
        inside = np.minimum(np.arange(int(n.max())), n[:, None] - 1)
        rows = buf[place[some][:, None] + inside]
        sums = np.zeros((len(rows), rows.shape[1] + 1), np.uint64)
        np.cumsum(rows * up[: rows.shape[1]], axis=1, out=sums[:, 1:])
        hashes = common.mix((sums[:, seed:] - sums[:, :-seed]) * down[: rows.shape[1] - seed + 1])
        hashes[np.arange(hashes.shape[1]) > n[:, None] - seed] = np.uint64(2**64 - 1)
        at[some] = hashes.argmin(axis=1)
        once[some] = (hashes == hashes.min(axis=1)[:, None]).sum(axis=1) == 1
    return at, once


def _first_docs(
    buf: np.ndarray, place: np.ndarray, windows: np.ndarray, docs: np.ndarray, seeds: np.ndarray, groups: np.ndarray, length: int
) -> np.ndarray:
    """For pieces of one or more hashes, the smallest document of each window, by the suffix array of their concatenation.

    A seed (where known: not -1) is one symbol there, since all pieces with one hash (of one group) have the same; each
    group has a symbol of its own, or windows of another group could come between equal ones. The result has
    the windows piece by piece.
    """
    seed = length // 2
    sizes = windows + length - 1
    folded = np.where(seeds >= 0, sizes - seed + 1, sizes) + 1
    begin = np.cumsum(folded) - folded
    piece = np.repeat(np.arange(len(place)), folded)
    inside = np.arange(len(piece)) - begin[piece]
    own = seeds[piece]
    after = (own >= 0) & (inside > own)
    offset = np.where(after, inside + seed - 1, inside)
    symbols = buf[np.minimum(place[piece] + offset, len(buf) - 1)].astype(np.int64) + 1
    folds = (own >= 0) & (inside == own)
    symbols[folds] = 257 + groups[piece[folds]] - groups.min()
    symbols[begin + folded - 1] = 0
    order = np.array(suffix_order(symbols.tolist()), np.int64)
    order = order[inside[order] < windows[piece[order]]]  # those that start a window: a seed is in all windows
    at = place[piece] + offset
    same = np.zeros(len(order), bool)
    for i in range(1, len(order), 1 << 14):
        left, right = at[order[i : i + (1 << 14)]], at[order[i - 1 : i - 1 + (1 << 14)]][: len(order) - i]
        same[i : i + len(left)] = (buf[left[:, None] + np.arange(length)] == buf[right[:, None] + np.arange(length)]).all(axis=1)
    heads = np.flatnonzero(~same)
    least = np.repeat(np.minimum.reduceat(docs[piece[order]], heads), np.diff(np.append(heads, len(order))))
    out = np.empty(len(piece), np.int64)
    out[order] = least
    first = np.cumsum(windows) - windows
    return out[np.repeat(begin - first, windows) + np.arange(windows.sum())]


def _repeated(values: np.ndarray) -> np.ndarray:
    """Whether a neighbour in a sorted array is equal."""
    same = values[1:] == values[:-1]
    return np.append(False, same) | np.append(same, False) if len(values) else np.zeros(0, bool)


def _short_hashes(buf: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of short spans of one length, in any order."""
    out = np.zeros(len(first), np.uint64)
    for k in range(int((last - first).max()) if len(first) else 0):
        out = out * common.GOLD + buf[first + k]
    return common.mix(out)


def _sharing(buf: np.ndarray, place: np.ndarray, windows: np.ndarray, groups: np.ndarray, length: int) -> np.ndarray:
    """Whether a piece has a window that may occur in another piece of its group, by hashes of all windows."""
    up, down = common._powers(_CHUNK + 2 * length)
    found, pieces = [], []
    for i in range(0, len(place), 1 << 13):
        some = slice(i, i + (1 << 13))
        n = windows[some] + length - 1
        inside = np.minimum(np.arange(int(n.max())), n[:, None] - 1)
        sums = np.zeros((len(n), inside.shape[1] + 1), np.uint64)
        np.cumsum(buf[place[some][:, None] + inside] * up[: inside.shape[1]], axis=1, out=sums[:, 1:])
        hashes = (sums[:, length:] - sums[:, :-length]) * down[: inside.shape[1] - length + 1] + groups[some][:, None].astype(np.uint64) * common.GOLD
        piece, at = np.nonzero(np.arange(hashes.shape[1]) < windows[some][:, None])
        found.append(common.mix(hashes[piece, at]))
        pieces.append((piece + i).astype(np.int32))
    out = np.zeros(len(place), bool)
    if found:
        hashes, piece = np.concatenate(found), np.concatenate(pieces)
        order = np.argsort(hashes)
        out[piece[order[_repeated(hashes[order])]]] = True
    return out


def _answers(length: int):
    """In a bucket: for each piece of each block, a bit per window that a smaller document has."""

    def answer(table: pa.Table) -> pa.Table:
        blocks = table["block"].to_pylist()
        load = lambda n, kind: [np.frombuffer(x, kind) for x in table[n].to_pylist()]
        keys, sizes, docs = load("keys", np.uint32), load("sizes", np.uint8), load("docs", np.int64)
        counts = [len(k) for k in keys]
        keys, docs, sizes = np.concatenate(keys), np.concatenate(docs), np.concatenate(sizes).astype(np.int64)
        buf = np.frombuffer(b"".join(table["content"].to_pylist()), np.uint8)
        place = np.cumsum(sizes) - sizes
        # equal pieces of several blocks: sorted by hash, and told apart by their bytes
        content = common.span_hashes(buf, place, place + sizes)
        order = np.lexsort((docs, content, sizes, keys))
        key = keys[order]
        fresh = np.append(True, (key[1:] != key[:-1]) | (content[order][1:] != content[order][:-1]) | (sizes[order][1:] != sizes[order][:-1]))
        again = np.flatnonzero(~fresh)
        for at in range(0, len(again), 1 << 15):  # pieces with equal hashes must have equal bytes, else they stay apart
            some = again[at : at + (1 << 15)]
            a, b, n = place[order[some]], place[order[some - 1]], sizes[order[some]]
            inside = np.minimum(np.arange(int(n.max())), n[:, None] - 1)
            fresh[some] = (buf[a[:, None] + inside] != buf[b[:, None] + inside]).any(axis=1)
        head = order[fresh]
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(fresh) - 1
        windows, least_doc = sizes[head] - length + 1, docs[head]
        begin = np.cumsum(windows) - windows
        first = np.repeat(least_doc, windows)
        # pieces that share their hash with a different piece: their suffixes are sorted
        key = keys[head]
        open_ = np.flatnonzero(_repeated(key))
        if len(open_):
            seeds, once = _seeds(buf, place[head[open_]], windows[open_], length)
            group = np.cumsum(np.append(True, key[open_][1:] != key[open_][:-1])) - 1
            plain = np.bincount(group, ~once)[group] > 0
            # a shared window has the seed and more than a quarter of the length to its left or its right
            more, near = (length - length // 2) // 2, np.zeros(len(open_), bool)
            for left, right in ((more, 0), (0, length - length // 2 - more)):
                a = place[head[open_]] + seeds - left
                b = a + left + length // 2 + right
                fits = (seeds >= left) & (seeds + length // 2 + right <= sizes[head[open_]])
                some = np.flatnonzero(fits)
                ext = _short_hashes(buf, a[some], b[some]) + group[some].astype(np.uint64) * common.GOLD
                order_ = np.argsort(ext)
                near[some[order_[_repeated(ext[order_])]]] = True
            keep = near | plain
            open_, seeds, group = open_[keep], np.where(plain, -1, seeds)[keep], group[keep]
            # no other window needs a place in the order
            keep = _sharing(buf, place[head[open_]], windows[open_], group, length)
            open_, seeds, group = open_[keep], seeds[keep], group[keep]
        at = 0
        total = np.cumsum(sizes[head[open_]] + 1)
        while at < len(open_):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SORT_BYTES, "right")))
            while to < len(open_) and group[to] == group[to - 1]:
                to += 1
            some = open_[at:to]
            found = _first_docs(buf, place[head[some]], windows[some], least_doc[some], seeds[at:to], group[at:to], length)
            w = windows[some]
            first[np.repeat(begin[some] - np.cumsum(w) + w, w) + np.arange(w.sum())] = found
            at = to
        # bits, for each piece as it was sent
        own = windows[number]
        inside = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        less = first[np.repeat(begin[number], own) + inside] < np.repeat(docs, own)
        bits = np.add.reduceat(less.astype(np.uint64) << inside.astype(np.uint64), np.cumsum(own) - own)
        rows = list(zip([table["bucket"][0].as_py()] * len(blocks), blocks, (x.tobytes() for x in np.split(bits, np.cumsum(counts)[:-1]))))
        return common.arrow_table(rows, [("bucket", pa.int32()), ("block", pa.int32()), ("bits", pa.binary())])

    return answer


def _cleaned(length: int, plan: common.Exchange, hot: int, extra: int, as_text: bool):
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", span)]
    kinds.append(("kept", pa.string() if as_text else pa.binary()))

    def clean(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return common.arrow_table([], kinds + [(f"x{k}", pa.null()) for k in range(extra)])
        docs = common.ordered(docs)
        pieces = _Pieces(docs, length)
        known = replies.filter(pc.is_valid(replies["classes"]))
        different, some, number = pieces.repeated(known, plan.ranges, hot)
        bounds, bits = common.bucket_bounds(pieces.key[different], plan.buckets), np.zeros(len(different), np.uint64)
        for b, data in zip(replies["bucket"].to_pylist(), replies["bits"].to_pylist()):
            if data is not None:
                bits[bounds[b] : bounds[b + 1]] = np.frombuffer(data, np.uint64)
        # a piece in a greater document than the smallest of the block repeats as a whole
        ids = np.array([0 if d is None else d for d in pieces.ids], np.int64)[pieces.doc]
        smallest = ids[some] == ids[different][number]
        n = pieces.windows[some]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        gone = (np.repeat(bits[number], n) >> inside.astype(np.uint64)) & np.uint64(1) > 0
        gone |= np.repeat(~smallest, n)
        at = (np.repeat(pieces.place[some], n) + inside)[gone]
        count = np.bincount(at, minlength=len(pieces.buf) + length + 1).astype(np.int32)
        count[length:] -= np.bincount(at, minlength=len(pieces.buf) + 1)[: len(count) - length].astype(np.int32)
        cut = np.cumsum(count[: len(pieces.buf)]) > 0
        rows = []
        for doc_id, text, start in zip(pieces.ids, pieces.texts, pieces.starts):
            own = cut[start : start + len(text)]
            kept, spans = text, []
            if own.any():
                edges = np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0]))))
                spans = [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])]
                kept = np.frombuffer(text, np.uint8)[~own].tobytes()
            rows.append((doc_id, len(text), int(own.sum()), spans, kept.decode("utf-8", "ignore") if as_text else kept))
        out = common.arrow_table(rows, kinds)
        for k in range(extra):
            out = out.append_column(f"x{k}", docs[f"x{k}"])
        return out

    return clean


def without_repeats(docs: DataFrame, length: int = 50, keep: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """Documents without the bytes of ``length``-byte strings that also start in a document with a smaller doc_id.

    ``docs`` has doc_id and text. Returns doc_id, n_bytes, n_removed, spans (the removed runs, as byte offsets), kept (the
    remaining bytes; ``as_text``: as a string, without characters that lost some of their bytes) and the columns
    named in ``keep``, with underscores before names that the result has already; other columns are ignored. Strings are judged on the texts as given and never cross documents;
    overlapping strings all count. A null text is empty; texts shorter than ``length`` stay whole; repeats
    within one document, or between rows with the same doc_id, stay; rows without a doc_id stay whole and make no
    other text shorter; an empty table gives no rows.
    """
    if not 2 <= length <= 100:
        raise ValueError("length must be from 2 to 100")
    common.prepare(docs.sparkSession)
    plan = common.exchange(common.text_bytes(docs), BLOCK_BYTES, BUCKET_BYTES)
    slim = docs.select("doc_id", "text", *[F.col(common.quoted(c)).alias(f"x{k}") for k, c in enumerate(keep)])
    dealt = common.in_blocks(slim, plan.blocks, *slim.columns[2:])
    shared = common.hash_classes(dealt, lambda table: _Pieces(table, length).hashes(), plan)
    pieces = dealt.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_offer_pieces(length, plan, HOT), _PIECES)
    bits = pieces.groupBy("bucket").applyInArrow(_answers(length), "bucket int, block int, bits binary")
    none = F.lit(None).cast("binary")
    told = shared.withColumn("bits", none).unionByName(bits.select("bucket", "block", none.alias("classes"), "bits"))
    schema = StructType.fromDDL(
        f"doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept {'string' if as_text else 'binary'}"
    )
    for field in slim.schema[2:]:
        schema = schema.add(field.name, field.dataType)
    found = dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_cleaned(length, plan, HOT, len(keep), as_text), schema)
    names = found.columns[: len(found.columns) - len(keep)]
    for c in keep:
        while c in names:
            c = f"_{c}"
        names.append(c)
    return found.toDF(*names)
