"""Writing pages as WARC archives and reading archives record by record.

An archive is a series of gzip members, one per record. The reader takes bytes as they come, inflates one member after the
other with an incremental decompressor, cuts the record by its Content-Length and compares the digest. Memory is bound
by one record.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.llm import common
from ripplegraph.session import materialise, scratch_path

FILE_BYTES = 256 << 20
READ_BYTES = 1 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEAD, _BREAK = b"WARC/1.1\r\n", b"\r\n\r\n"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(fields: list[tuple[str, str]], payload: bytes) -> bytes:
    """One record as a gzip member. Line breaks in a field's value become spaces."""
    clean = [f"{name}: {' '.join(value.split())}\r\n" for name, value in fields]
    head = _HEAD + "".join(clean).encode() + b"Content-Length: %d\r\n\r\n" % len(payload)
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(head) + deflate.compress(payload) + deflate.compress(_BREAK) + deflate.flush()


def members(source) -> Iterator[bytes]:
    """The inflated gzip members of a stream, one at a time."""
    inflate, parts, data = zlib.decompressobj(31), [], b""
    while True:
        data = data or source.read(READ_BYTES)
        if not data:
            break
        parts.append(inflate.decompress(data))
        data = b""
        if inflate.eof:
            yield b"".join(parts)
            data, inflate, parts = inflate.unused_data, zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the archive ends within a record")


def parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    """Fields (names in lower case) and payload of a record; raises where the frame is broken."""
    head, found, body = member.partition(_BREAK)
    if not found or not head.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower().decode()] = value.strip().decode()
    size = int(fields["content-length"])
    if body[size:] != _BREAK:
        raise ValueError("the record is not as long as its Content-Length says")
    return fields, body[:size]


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write records (id, url, kind, refers_to, digest, size, payload) as archives; returns path and records of each file.

    Each task writes files of its own under a name that no other attempt uses. Only files of tasks that ended are in the
    returned list, so what a lost executor has left is never read.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        sink, path, count, written, done = None, "", 0, 0, []
        for batch in batches:
            for row in batch.to_pylist():
                if sink is None:
                    path, count, written = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    sink = system.open_output_stream(path, compression=None)
                fields = [
                    ("WARC-Type", row["kind"]),
                    ("WARC-Record-ID", f"<urn:page:{'' if row['id'] is None else row['id']}>"),
                    ("WARC-Date", "1970-01-01T00:00:00Z"),
                    ("WARC-Payload-Digest", "sha1:" + row["digest"]),
                    ("X-Payload-Length", str(row["size"])),
                ]
                if row["url"] is not None:
                    fields.append(("WARC-Target-URI", row["url"]))
                if row["kind"] == "revisit":
                    fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<urn:page:{row['refers_to']}>")]
                data = record_bytes(fields, row["payload"] or b"")
                sink.write(data)
                count, written = count + 1, written + len(data)
                if written >= FILE_BYTES:
                    sink.close()
                    done.append((path, count))
                    sink = None
        if sink is not None:
            sink.close()
            done.append((path, count))
        if done:
            yield common.arrow_table(done, [("path", pa.string()), ("records", pa.int64())]).to_batches()[0]

    return materialise(records.mapInArrow(write, "path string, records long"), "archives")


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """The records of archives, one row each: record_type, id, refers_to, url, digest, size and payload.

    ``files`` names the files by path and may say how many records each has. A record whose payload doesn't have
    its digest, a broken frame, a cut-off file and a wrong number of records are errors. A revisit has no payload; its
    size is that of the payload it refers to.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(folder)
        kinds = [(n, pa.string()) for n in ("record_type", "id", "refers_to", "url", "digest")]
        kinds += [("size", pa.int64()), ("payload", pa.binary())]
        page = lambda x: (x or "").removeprefix("<urn:page:").removesuffix(">") or None
        for batch in batches:
            for file in batch.to_pylist():
                rows, held, count = [], 0, 0
                with system.open_input_stream(file["path"], compression=None) as source:
                    for member in members(source):
                        fields, payload = parsed(member)
                        kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:")
                        if kind != "revisit" and digest and payload_digest(payload) != digest:
                            raise ValueError(f"wrong digest in {file['path']}")
                        size = int(fields.get("x-payload-length", len(payload)))
                        row = (kind, page(fields.get("warc-record-id")), page(fields.get("warc-refers-to")))
                        rows.append((*row, fields.get("warc-target-uri"), digest, size, payload))
                        held, count = held + len(payload), count + 1
                        if held > 4 << 20 or len(rows) >= common.BATCH_ROWS:
                            yield common.arrow_table(rows, kinds).to_batches()[0]
                            rows, held = [], 0
                if file.get("records") is not None and count != file["records"]:
                    raise ValueError(f"{file['path']} has {count} records, not {file['records']}")
                if rows:
                    yield common.arrow_table(rows, kinds).to_batches()[0]

    # one file to a task as far as possible: the files are few against the rows
    spread = files.select("path", "records").repartition(max(1, files.count()), "path")
    schema = "record_type string, id string, refers_to string, url string, digest string, size long, payload binary"
    return spread.mapInArrow(read, schema)


def page_records(pages: DataFrame, least: int = 0) -> DataFrame:
    """Records of pages: of equal payloads of at least ``least`` bytes the one with the largest page_id is kept, others revisit it.

    ``pages`` has page_id, url and html. The payload is the html in UTF-8, a null one is empty. Equal rows and rows without
    a page_id: a null page_id counts as smaller than any other; of several rows with the largest page_id all are responses.
    """
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    slim = pages.select("page_id", F.sha1(payload).alias("hex"), F.length(payload).cast("long").alias("size"))
    # Only digests and ids are exchanged to find the copies; a digest of very many pages is combined before the exchange,
    # and only digests that occur twice are joined.
    copies = slim.where(F.col("size") >= least).groupBy("hex").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1")
    record = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("hex")).withColumn("size", F.length("payload").cast("long"))
    joined = record.join(copies.drop("n"), "hex", "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return joined.select(
        F.col("page_id").alias("id"), "url", F.when(revisit, "revisit").otherwise("response").alias("kind"),
        F.when(revisit, F.col("keeper")).alias("refers_to"), "hex", "size", F.when(~revisit, F.col("payload")).alias("payload"),
    )


def archived_pages(spark: SparkSession, pages: DataFrame, least: int = 0) -> DataFrame:
    """Write all pages as archives in the shared scratch folder and read the archives back, record by record."""
    common.prepare(spark)
    folder = scratch_path(spark, "warc")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    records = page_records(pages, least)

    def base32(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [base64.b32encode(bytes.fromhex(x)).decode() for x in batch["hex"].to_pylist()]
            yield batch.drop_columns(["hex"]).append_column("digest", pa.array(digests, pa.string()))

    schema = "id long, url string, kind string, refers_to long, size long, payload binary, digest string"
    return read_archives(write_archives(records.mapInArrow(base32, schema), folder), folder)
