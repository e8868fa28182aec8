"""Reading CSV files with line breaks inside quotes, in splits.

A split can't know whether it begins inside a quoted field. So a first pass tells of every split how it would end if it
began outside quotes, and if it began inside; put together in the order of the splits, that says how each begins. The
second pass then cuts the lines into records. The parts of a record that crosses splits meet by the split it began in.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.session import ship_package

# Quotes within a field are doubled. A row that doesn't fit the header raises instead of being dropped.
OPTIONS = {"quote": '"', "escape": '"', "mode": "FAILFAST"}
# The rest of a quoted field up to its closing quote.
_CLOSED = re.compile(r'[^"]*(?:""[^"]*)*"(?!")')
# Lines handed on at once.
RECORDS = 10_000


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted field is open at the end of a line. Only a quote at the start of a field opens one."""
    if '"' not in line:
        return inside
    at = 0
    while True:
        if inside:
            closed = _CLOSED.match(line, at)
            if closed is None:
                return True
            at = closed.end()
        elif at == 0 and line[0] == '"':
            at, inside = 1, True
            continue
        opening = line.find(',"', at)
        if opening < 0:
            return False
        at, inside = opening + 2, True


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, str]]:
    for batch in batches:
        yield from zip(*[batch[c].to_pylist() for c in ("file", "start", "value")])


_ENDS = "file string, start long, from_outside boolean, from_inside boolean, closes boolean"


def _split_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split, whether it ends inside a quoted field if it begins outside or inside one, and whether it closes the latter."""
    rows = []
    for (file, start), lines in groupby(_lines(batches), lambda x: x[:2]):
        outside, inside, closes = False, True, False
        for *_, line in lines:
            agreed = inside == outside
            outside = ends_inside(line, outside)
            inside = outside if agreed else ends_inside(line, inside)
            closes |= not inside
        rows.append({"file": file, "start": start, "from_outside": outside, "from_inside": inside, "closes": closes})
    kinds = [("file", pa.string()), ("start", pa.int64()), *[(n, pa.bool_()) for n in ("from_outside", "from_inside", "closes")]]
    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))


def _opened(ends) -> dict[tuple[str, int], int | None]:
    """For each split the start of the split in which the record that is open at its beginning began, or null."""
    found = {}
    for _, splits in groupby(sorted(ends, key=lambda r: (r["file"], r["start"])), lambda r: r["file"]):
        opened = None
        for r in splits:
            found[r["file"], r["start"]] = opened
            if opened is None:
                opened = r["start"] if r["from_outside"] else None
            elif r["closes"]:
                opened = r["start"] if r["from_inside"] else None
    return found


_RECORDS = "file string, opened long, part long, header boolean, record string"
_RECORD_KINDS = pa.schema(
    [("file", pa.string()), ("opened", pa.int64()), ("part", pa.int64()), ("header", pa.bool_()), ("record", pa.string())]
)


def _cut(opened: dict[tuple[str, int], int | None]):
    """Whole records (``opened`` null) and the parts of records that cross splits."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for (file, start), lines in groupby(_lines(batches), lambda x: x[:2]):
            if (file, start) not in opened:
                raise RuntimeError("the files were split otherwise than in the first pass; read them again")
            begun = opened[file, start]
            inside, held, header = begun is not None, [], start == 0
            for *_, line in lines:
                held.append(line)
                inside = ends_inside(line, inside)
                if inside:
                    continue
                record = "\n".join(held)
                record = record[:-1] if record.endswith("\r") else record
                if record or begun is not None:
                    rows.append((file, begun, None if begun is None else start, header, record))
                    header = False
                begun, held = None, []
                if len(rows) >= RECORDS:
                    yield _batch(rows)
                    rows = []
            if held:
                rows.append((file, start if begun is None else begun, start, header, "\n".join(held)))
        yield _batch(rows)

    return cut


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(_RECORD_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _RECORD_KINDS)], schema=_RECORD_KINDS)


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of CSV files with a header, as strings; blank lines between records are left out.

    What the driver holds is a row per split. A record that crosses splits is put together from its parts.
    """
    ship_package(spark)
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value"
    )
    opened = _opened(lines.mapInArrow(_split_ends, _ENDS).collect())
    cut = lines.mapInArrow(_cut(opened), _RECORDS)
    if not any(v is not None for v in opened.values()):
        return cut.where(~F.col("header")).select("record")
    parts = F.array_sort(F.collect_list(F.struct("part", "record")))
    crossing = cut.where(F.col("opened").isNotNull()).groupBy("file", "opened").agg(F.max("header").alias("header"), parts.alias("parts"))
    joined = crossing.select("header", F.concat_ws("\n", F.transform("parts", lambda p: p["record"])).alias("record"))
    whole = cut.where(F.col("opened").isNull()).select("header", "record")
    return whole.unionByName(joined).where(~F.col("header")).select("record")


def quoted_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV files with a header and the given columns, whose quoted fields may hold line breaks, read by many tasks."""
    parsed = F.from_csv("record", schema, OPTIONS | {"multiLine": "true"})
    return quoted_records(spark, path).select(parsed.alias("row")).select("row.*")
