"""WARC archives: write, index, and read back by coalesced byte ranges (operator 2).

Writing. A page becomes one WARC/1.1 record in a gzip member of its own. Pages whose
payload another page with a smaller id has as well become revisit records that name it.
Spark's text writer puts the members into files, so its commit protocol covers lost
executors: every member is made to end in a zero byte, and that byte is the line separator.
Reading. The index holds offset, length, URL and digest of each record. Selected records are
sorted by file and offset, ranges with small gaps between them are joined, and each joined
range is one read.

Nulls: a null html is an empty payload, a null url leaves its header out, a page without an
id is always a response. Repeated rows of one page_id are all responses or revisits alike. A
very long payload is one record, in the memory of one task.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from palaver.llm.shared import Scratch, arrow_rows, fresh_path, lean, remove_at_exit

#: Fixed so that equal input gives equal archives.
DATE = "2024-01-01T00:00:00Z"
ID_PREFIX = "urn:page:"
PART_ROWS = 20_000
MIN_REVISIT_BYTES = 0
GAP_BYTES, RANGE_BYTES = 64 << 10, 4 << 20
#: Archive bytes that one task reads back, about.
TASK_BYTES = 16 << 20
#: Schemes of Hadoop under the names that pyarrow has for them.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(block: bytes) -> bytes:
    """One gzip member without its last byte, which is zero: the writer's separator restores it."""
    def one(b):
        z = zlib.compressobj(3, zlib.DEFLATED, 31)
        return z.compress(b) + z.flush()

    out = one(block)
    return (out if out[-1] == 0 else out + one(b""))[:-1]


def header_value(v: str) -> str:
    """Line ends would end the header."""
    return v.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in v or "\n" in v else v


def record(page_id, url, payload: bytes, payload_digest: str, refers_to) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{ID_PREFIX}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {header_value(url)}")
    lines += [f"WARC-Payload-Digest: sha1:{payload_digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{ID_PREFIX}{refers_to}>"]
        payload = b""
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def write_warc(scratch: Scratch, pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Writes pages (page_id, url, html) as .warc.gz members under path."""

    def digests(batches):
        for b in batches:
            raw = [(x.as_py() or "").encode() for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([digest(x) for x in raw]), pa.array([len(x) for x in raw], pa.int64())], ["page_id", "payload_digest", "payload_bytes"])

    def records(batches):
        for b in batches:
            made = []
            for page_id, url, html, firsts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                payload = (html or "").encode()
                d = digest(payload)
                made.append(member(record(page_id, url, payload, d, dict(firsts or ()).get(d))))
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["value"])

    arrow_rows(pages.sparkSession, 500)
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    found = pages.select("page_id", "html").mapInArrow(lean(digests), "page_id long, payload_digest string, payload_bytes long")
    # Only pages with an equal, earlier payload need a word from elsewhere; the pairs stay small.
    found = scratch.put(found.where(F.col("page_id").isNotNull()), "digests")
    firsts = found.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
    firsts = scratch.put(firsts.where("first < last").drop("last"), "firsts")
    copies = found.join(firsts, ["payload_digest", "payload_bytes"]).where("first < page_id")
    copies = copies.groupBy("page_id").agg(F.map_from_entries(F.collect_set(F.struct("payload_digest", "first"))).alias("firsts"))
    made = pages.join(copies, "page_id", "left").select("page_id", "url", "html", "firsts").mapInArrow(lean(records), "value binary")
    lines = made.select(F.col("value").cast("string"))
    lines.write.option("lineSep", "\u0000").option("maxRecordsPerFile", PART_ROWS).text(path)


def open_store(uri: str):
    """(pyarrow file system, path in it) of a Hadoop URI."""
    from pyarrow import fs

    scheme, colon, rest = uri.partition(":")
    try:
        return fs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + colon + rest)
    except pa.ArrowInvalid as e:
        raise ValueError(f"byte ranges of {scheme}: cannot be read here; set spark.checkpoint.dir to a file, hdfs, s3a, gs or abfs path") from e


def parse(block: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one decompressed record."""
    head, _, rest = block.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


def members(stream, size: int = 1 << 20):
    """(offset, length, block) of each non-empty gzip member of a stream of bytes."""
    at, rest = 0, b""
    while True:
        rest = rest or stream.read(size)
        if not rest:
            return
        z, out, start = zlib.decompressobj(31), [], at
        while not z.eof:
            if not rest:
                rest = stream.read(size)
                if not rest:
                    raise ValueError(f"the member at byte {start} is cut off")
            out.append(z.decompress(rest))
            at += len(rest) - len(z.unused_data)
            rest = z.unused_data
        block = b"".join(out)
        if block:
            yield start, at - start, block


def bare_id(value: str | None):
    n = (value or "").strip("<>").removeprefix(ID_PREFIX)
    return int(n) if n else None


INDEX = "file string, offset long, length long, record_id long, url string, payload_digest string, record_type string"


def build_index(spark, path: str) -> DataFrame:
    """One row per record of the archives under path, from one sequential read of each file."""

    def run(batches):
        for b in batches:
            for name in b.column(0).to_pylist():
                store, inner = open_store(name)
                rows = []
                with store.open_input_stream(inner) as f:
                    for offset, length, block in members(f):
                        h, _ = parse(block)
                        rows.append((name, offset, length, bare_id(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"]))
                cols = list(zip(*rows, strict=True)) or [()] * 7
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["file", "offset", "length", "record_id", "url", "payload_digest", "record_type"])

    files = spark.read.format("binaryFile").load(path).select("path")
    return files.mapInArrow(lean(run), INDEX)


RECORD = "record_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def read_records(selected: DataFrame, with_payload: bool = True, gap: int = GAP_BYTES, most: int = RANGE_BYTES) -> DataFrame:
    """Reads the records that rows of the index name; a digest that differs from the payload raises.

    Ranges of a file are read in order; neighbours less than gap bytes apart are one read of
    at most `most` bytes (a longer record is a read of its own). Tasks get stretches of the
    files of about TASK_BYTES: what counts is the archive behind an index row, not the row.
    """

    def run(batches):
        name, f = None, None
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
            i = 0
            while i < len(rows):
                j, (file, begin, _) = i + 1, rows[i]
                end = begin + rows[i][2]
                while j < len(rows) and rows[j][0] == file and rows[j][1] - end <= gap and rows[j][1] + rows[j][2] - begin <= most:
                    end, j = max(end, rows[j][1] + rows[j][2]), j + 1
                if file != name:
                    store, inner = open_store(file)
                    name, f = file, store.open_input_file(inner)
                data = f.read_at(end - begin, begin)
                out = []
                for _, offset, length in rows[i:j]:
                    h, payload = parse(zlib.decompress(data[offset - begin : offset - begin + length], 31))
                    own, kind = h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"]
                    if kind == "response" and digest(payload) != own:
                        raise ValueError(f"{file} at {offset}: the payload's digest differs")
                    out.append((bare_id(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), kind, own, int(h["X-Payload-Length"]), bare_id(h.get("WARC-Refers-To")), payload if with_payload else None))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["record_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"])
                i = j

    ranges = selected.select("file", "offset", "length")
    total = ranges.agg(F.sum("length")).first()[0] or 0
    stretch = F.floor(F.col("offset") / TASK_BYTES)
    return ranges.repartition(total // TASK_BYTES + 1, "file", stretch).sortWithinPartitions("file", "offset").mapInArrow(lean(run), RECORD)


def op2_warc(spark, sf_dir: str) -> DataFrame:
    """Writes every page, indexes the archives, and reads every record back through the index."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    scratch, path = Scratch(spark), fresh_path(spark, "warc")
    write_warc(scratch, pages, path)
    remove_at_exit(spark, path)
    scratch.drop("digests", "firsts")
    index = scratch.put(build_index(spark, path), "index")
    got = read_records(index, with_payload=False)
    return got.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
