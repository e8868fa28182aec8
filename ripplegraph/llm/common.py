"""Reading tables, batch limits and byte-level kernels shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import count, islice
from math import ceil, sqrt
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows and bytes of text that a Python task sees at once.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20
GOLD = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _ship(application: str) -> None:
    """Send this package to the executors, where it need not be installed."""
    root = Path(__file__).resolve().parents[2]
    target = Path(tempfile.mkdtemp(prefix="package-")) / f"{__package__.split('.')[0]}.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted((root / target.stem).rglob("*.py")):
            archive.write(path, path.relative_to(root))
    SparkSession.active().sparkContext.addPyFile(str(target))


def prepare(spark: SparkSession) -> None:
    """Python code on the executors, and small Arrow batches, since one row may hold a long text."""
    _ship(spark.sparkContext.applicationId)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def quoted(name: str) -> str:
    """A column name as an expression, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def free_names(df: DataFrame, n: int) -> list[str]:
    """Column names that the table does not have."""
    taken = {c.lower() for c in df.columns}
    return list(islice((name for name in map("_own{}".format, count()) if name not in taken), n))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts, for choosing numbers of partitions."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def parts_for(total: int, each: int, least: int = 1) -> int:
    return max(least, ceil(total / each))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x + GOLD
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0xD1342543DE82EF95)
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The texts of an Arrow column in UTF-8, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    out = []
    for base in (_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64))):
        row = np.full(n, base)
        row[0] = 1
        out.append(np.cumprod(row, dtype=np.uint64))
    return out[0], out[1]


def spans(sep: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of the runs between separators. Each text must end in a separator."""
    ends = np.flatnonzero(sep)
    first = np.append(0, ends[:-1] + 1)
    some = ends > first
    first, last = first[some], ends[some]
    counts = np.diff(np.append(np.searchsorted(first, starts), len(first)))
    return first, last, np.repeat(np.arange(len(starts)), counts)


def span_hashes(buf: np.ndarray, first: np.ndarray, last: np.ndarray, run: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, by sums over runs of spans of about ``run`` bytes; ends ascend."""
    out = np.empty(len(first), np.uint64)
    at = 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(last, first[at] + run, "right")))
        lo, hi = int(first[at]), int(last[to - 1])
        size = run if hi - lo <= run else 1 << (hi - lo).bit_length()
        up, down = _powers(size)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(buf[lo:hi] * up[: hi - lo], out=sums[1:])
        f, e = first[at:to] - lo, last[at:to] - lo
        out[at:to] = (sums[e] - sums[f]) * down[f] + (e - f).astype(np.uint64)
        at = to
    return mix(out)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer of all texts, each followed by a line break, and where each starts."""
    data = b"\n".join(texts) + b"\n"
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return np.frombuffer(data, np.uint8), np.cumsum(sizes) - sizes


def slices(texts: list[bytes], most: int = 2 << 20):
    """Runs of neighbouring texts of about ``most`` bytes, as (from, to); a longer text is alone."""
    at, total = 0, 0
    for i, t in enumerate(texts):
        if i > at and total + len(t) > most:
            yield at, i
            at, total = i, 0
        total += len(t)
    if at < len(texts):
        yield at, len(texts)


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in order, by sorting."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def word_shingles(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of the word n-grams of each text; fewer words count as one n-gram.

    Words lie between ASCII white space, A-Z lower-cased. Hashes have 64 bits, over the whole text.
    """
    out: list[np.ndarray] = []
    for a, b in slices(texts):
        buf, starts = joined([t.translate(LOWER) for t in texts[a:b]])
        first, last, doc = spans(SPACES[buf], starts)
        words = span_hashes(buf, first, last)
        bounds = np.searchsorted(doc, np.arange(b - a + 1))
        grams = words[: max(0, len(words) - width + 1)].copy()
        for k in range(1, width):
            grams = mix(grams + np.uint64(k)) + words[k : k + len(grams)]
        grams = mix(grams)
        for i in range(b - a):
            lo, hi = bounds[i], bounds[i + 1]
            if hi - lo >= width:
                out.append(distinct(grams[lo : hi - width + 1]))
            elif hi > lo:
                whole = np.uint64(hi - lo)
                with np.errstate(over="ignore"):
                    for w in words[lo:hi]:
                        whole = mix(np.array([whole * GOLD]))[0] + w
                    out.append(mix(np.array([whole ^ GOLD])))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


# ---- exchanging sets of hashes between blocks of texts and buckets of hashes

# Rows that blocks and buckets exchange directly; beyond, teams of blocks and spans of buckets meet in between.
DIRECT_ROWS = 1 << 20
# Partitions that blocks are dealt to; beyond, a task has several blocks.
MAX_TASKS = 1 << 16


@dataclass(frozen=True)
class Exchange:
    """How many blocks and buckets there are, and in which teams and spans they meet: 0 where they meet directly."""

    blocks: int
    buckets: int
    per_team: int = 0
    per_span: int = 0

    @property
    def ranges(self) -> int:
        """The equal ranges of hashes that a block gets its answers by."""
        return self.buckets // self.per_span if self.per_span else self.buckets


def exchange(total: int, block_bytes: int, bucket_bytes: int) -> Exchange:
    """Blocks and buckets for so many bytes of text.

    Directly, each block sends a row to each bucket: the square of the input. Above ``DIRECT_ROWS`` of them, each block sends a row
    to each span of about as many buckets as there are spans, and each team of blocks one to each bucket: the input to the power 1.5.
    """
    blocks, buckets = parts_for(total, block_bytes, 4), parts_for(total, bucket_bytes, 4)
    if blocks * buckets <= DIRECT_ROWS:
        return Exchange(blocks, buckets)
    per_span = ceil(sqrt(buckets))
    return Exchange(blocks, ceil(buckets / per_span) * per_span, ceil(sqrt(blocks)), per_span)


def packed(ids: np.ndarray) -> bytes:
    """Sorted unsigned numbers as differences, byte by byte, so that compression removes the high bytes."""
    steps = np.diff(ids, prepend=ids.dtype.type(0))
    return steps.view(np.uint8).reshape(-1, ids.itemsize).T.tobytes()


def unpacked(data: bytes, kind: type = np.uint32) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T
    return np.cumsum(np.ascontiguousarray(planes).view(kind).ravel(), dtype=kind)


def bucket_bounds(hashes: np.ndarray, buckets: int, first: int = 0, number: int | None = None) -> np.ndarray:
    """Where each bucket, or each of a run of them, begins in sorted 64-bit hashes: buckets are equal ranges of the upper 32 bits."""
    run = np.arange(first, first + (buckets if number is None else number), dtype=np.uint64)
    edges = ((run << np.uint64(32)) + np.uint64(buckets - 1)) // np.uint64(buckets) << np.uint64(32)
    return np.append(np.searchsorted(hashes, edges), len(hashes))


def within(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower 32 bits of a bucket's hashes, sorted, and the order that sorts them."""
    low = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    order = np.argsort(low, kind="stable")
    return low[order], order


def in_blocks(docs: DataFrame, blocks: int, *columns: str) -> DataFrame:
    """Whole documents dealt out to blocks by their id; the exchange is read by each pass over the texts."""
    block = F.pmod(F.xxhash64(F.lit(17), "doc_id", F.octet_length("text")), F.lit(blocks)).cast("int")
    return docs.select(block.alias("block"), "doc_id", "text", *columns).repartition(min(blocks, MAX_TASKS), "block")


def ordered(table: pa.Table) -> pa.Table:
    """The rows of a block in an order that every pass finds again."""
    return table.sort_by([(n, "ascending") for n in table.column_names if n != "block"])


OFFERS, REPLIES = "bucket int, block int, ids binary, counts binary", "bucket int, block int, classes binary"
SPAN_OFFERS = "span int, team int, block int, ids binary, counts binary"
_OFFER_KINDS = [("bucket", pa.int32()), ("block", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary())]
_REPLY_KINDS = [("bucket", pa.int32()), ("block", pa.int32()), ("classes", pa.binary())]


# Counts in a byte: as they are up to 127, then in eighths of doublings, rounded up.
_COUNTS = np.append(np.arange(128), np.ceil(127 * 2 ** (np.arange(1, 129) / 8))).astype(np.int64)


def _in_byte(counts: np.ndarray) -> bytes:
    return np.searchsorted(_COUNTS[:-1], counts).astype(np.uint8).tobytes()


def _from_bytes(column: pa.ChunkedArray) -> np.ndarray:
    return _COUNTS[np.concatenate([np.frombuffer(x, np.uint8) for x in column.to_pylist()])]


def filled(bounds: np.ndarray) -> list[int]:
    """The ranges that hold something."""
    return np.flatnonzero(np.diff(bounds)).tolist()


def offers(block: int, hashes: np.ndarray, counts: np.ndarray, buckets: int, first: int = 0, number: int | None = None) -> pa.Table:
    """A block's sorted distinct hashes and in how many of its documents each is (nearly, as a byte of ``_COUNTS``), by bucket.

    The hashes may be those of a run of buckets only.
    """
    bounds, rows = bucket_bounds(hashes, buckets, first, number), []
    for b in filled(bounds):
        low, order = within(hashes[bounds[b] : bounds[b + 1]])
        rows.append((first + b, block, packed(low), _in_byte(counts[bounds[b] : bounds[b + 1]][order])))
    return arrow_table(rows, _OFFER_KINDS)


def classes_of(hashes: np.ndarray, replies: pa.Table, buckets: int, first: int = 0, number: int | None = None) -> np.ndarray:
    """What the buckets answered about a block's sorted distinct hashes.

    Buckets know hashes by 32 bits, about one in a thousand shares them with another: a count may then be too high, never
    too low.
    """
    bounds, classes = bucket_bounds(hashes, buckets, first, number), np.zeros(len(hashes), np.uint8)
    for b, data in zip(replies["bucket"].to_pylist(), replies["classes"].to_pylist()):
        lo, hi = bounds[b - first], bounds[b - first + 1]
        classes[lo + within(hashes[lo:hi])[1]] = np.frombuffer(data, np.uint8)
    return classes


def _to_spans(block: int, hashes: np.ndarray, counts: np.ndarray, plan: Exchange) -> pa.Table:
    bounds, rows = bucket_bounds(hashes, plan.ranges), []
    for s in filled(bounds):
        own = slice(bounds[s], bounds[s + 1])
        rows.append((s, block // plan.per_team, block, packed(hashes[own]), _in_byte(counts[own])))
    return arrow_table(rows, [("span", pa.int32()), ("team", pa.int32()), *_OFFER_KINDS[1:]])


def _of_team(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The hashes of each block, and all of them with the sum of their counts."""
    own = [unpacked(x, np.uint64) for x in table["ids"].to_pylist()]
    every, place = np.unique(np.concatenate(own), return_inverse=True)
    return own, every, np.bincount(place, _from_bytes(table["counts"]), len(every)).astype(np.int64)


def hash_classes(dealt: DataFrame, hashes, plan: Exchange) -> DataFrame:
    """For each hash of each block the doubling class of the number of documents that hold it, 0 for one: ``REPLIES``.

    ``hashes`` gives a block's sorted distinct hashes and in how many of its documents each is. Answers come by ``plan.ranges``
    and are read by :func:`classes_of`. A hash has one class, whichever block asks.
    """
    if not plan.per_team:
        def offer(table: pa.Table) -> pa.Table:
            return offers(table["block"][0].as_py(), *hashes(table), plan.buckets)

        return dealt.groupBy("block").applyInArrow(offer, OFFERS).groupBy("bucket").applyInArrow(count_classes, REPLIES)

    def offer_spans(table: pa.Table) -> pa.Table:
        return _to_spans(table["block"][0].as_py(), *hashes(table), plan)

    def of_team(table: pa.Table) -> pa.Table:
        _, every, counts = _of_team(table)
        return offers(table["team"][0].as_py(), every, counts, plan.buckets, table["span"][0].as_py() * plan.per_span, plan.per_span)

    def to_blocks(table: pa.Table, replies: pa.Table) -> pa.Table:
        rows = []
        if table.num_rows:
            span = table["span"][0].as_py()
            own, every, _ = _of_team(table)
            classes = classes_of(every, replies, plan.buckets, span * plan.per_span, plan.per_span)
            for block, ids in zip(table["block"].to_pylist(), own):
                rows.append((span, block, classes[np.searchsorted(every, ids)][within(ids)[1]].tobytes()))
        return arrow_table(rows, _REPLY_KINDS)

    offered = dealt.groupBy("block").applyInArrow(offer_spans, SPAN_OFFERS)
    told = offered.groupBy("team", "span").applyInArrow(of_team, OFFERS).groupBy("bucket").applyInArrow(count_classes, REPLIES)
    span = F.floor(F.col("bucket") / plan.per_span).cast("int").alias("span")
    told = told.select(F.col("block").alias("team"), span, "bucket", "classes")
    return offered.groupBy("team", "span").cogroup(told.groupBy("team", "span")).applyInArrow(to_blocks, REPLIES)


def arrow_table(rows: list[tuple], fields: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.table({n: pa.array(list(c), t) for (n, t), c in zip(fields, columns)})


def arrow_batch(rows: list[tuple], fields: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for (_, t), c in zip(fields, columns)], names=[n for n, _ in fields])


def count_classes(table: pa.Table) -> pa.Table:
    """For each hash offered to a bucket, the doubling class of the number of documents that hold it: 0 for one."""
    blocks, ids = table["block"].to_pylist(), [unpacked(x) for x in table["ids"].to_pylist()]
    counts = _from_bytes(table["counts"])
    sizes = [len(x) for x in ids]
    ids = np.concatenate(ids)
    order = np.argsort(ids, kind="stable")
    sorted_ids = ids[order]
    fresh = np.flatnonzero(np.append(True, sorted_ids[1:] != sorted_ids[:-1]))
    total = np.add.reduceat(counts[order], fresh)
    classes = np.ceil(np.log2(total)).astype(np.uint8)
    out = np.empty(len(ids), np.uint8)
    out[order] = np.repeat(classes, np.diff(np.append(fresh, len(ids))))
    cuts = np.cumsum(sizes)[:-1]
    rows = [(k, b, c.tobytes()) for k, b, c in zip([table["bucket"][0].as_py()] * len(blocks), blocks, np.split(out, cuts))]
    return arrow_table(rows, _REPLY_KINDS)


def partition_sums(rows: DataFrame, make) -> np.ndarray | None:
    """The sum over all rows of what ``make`` gives for a batch (a fixed-size array), added within partitions first."""
    groups = max(1, ceil(sqrt(rows.rdd.getNumPartitions())))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = make(batch)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"grp": pa.array([TaskContext.get().partitionId() % groups], pa.int32()), "data": [total.tobytes()]})

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x) for x in table["data"].to_pylist())
        return pa.table({"data": [total.tobytes()]})

    added = rows.mapInArrow(local, "grp int, data binary").groupBy("grp").applyInArrow(add, "data binary")
    found = [np.frombuffer(r["data"]) for r in added.toLocalIterator()]
    return sum(found) if found else None
