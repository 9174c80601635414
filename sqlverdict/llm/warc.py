"""WARC archives (operator 8): index first, then sorted and coalesced byte-range reads.

``write`` puts one record per page into archives of the shared folder, one archive per task,
every record a gzip member of its own, and gives an index row per record: archive, offset,
length, URL and payload digest. Payloads of ``least`` bytes or more that are equal are stored
once: the record of the smallest page id is a response, the others revisit it.

``read`` takes index rows, whichever were selected. The rows of one stretch of an archive
go to one task, which sorts them by offset, merges ranges that lie close together, reads each
merged range once, and parses its records. A revisit gets the payload's size from the record it
refers to.

Archives are written below the folder of ``spark.checkpoint.dir`` through ``pyarrow.fs``,
which knows local, HDFS and object-store paths. A repeated task writes an archive under a new
name, and only archives in the index are read, so lost executors leave no wrong records.

Null html is an empty payload; null URLs are written as ``urn:page:<id>``. Rows without a page id
go; of rows that repeat an id, the one with the smallest html stays (``common.named``). An empty
table gives an empty index and no rows. Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlverdict.llm.common import named, stored
from sqlverdict.session import scratch_path

#: Shortest payload that is stored once.
LEAST = 100
#: Bytes of an archive that are planned together, gaps up to which ranges are read together, and bytes that a task reads.
STRETCH, GAP, TASK = 8 << 20, 64 << 10, 64 << 20
INDEX = "archive string, offset long, length long, page_id long, url string, digest string, record_type string, refers_to long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload binary"


def _record(page_id: int, url: str, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC record, compressed as a gzip member."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>",
            "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {url}", f"X-Page-ID: {page_id}",
            f"WARC-Payload-Digest: sha256:{digest}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>", f"X-Refers-To-Page: {refers_to}",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def _parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one compressed record."""
    data = gzip.decompress(member)
    head, rest = data.split(b"\r\n\r\n", 1)
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines)
    block = rest[:int(headers["Content-Length"])]
    return headers, block.split(b"\r\n\r\n", 1)[1]


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        name, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for batch in batches:
                offsets, lengths = [], []
                for row in zip(*(batch.column(k) for k in range(6))):
                    page_id, url, html, digest, kind, refers_to = (x.as_py() for x in row)
                    out = out or system.open_output_stream(f"{root}/{name}", compression=None)
                    member = _record(page_id, url, html, digest, kind, refers_to)
                    out.write(member)
                    offsets.append(at)
                    lengths.append(len(member))
                    at += len(member)
                yield pa.RecordBatch.from_arrays([
                    pa.array([f"{folder}/{name}"] * len(offsets), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()),
                    *(batch.column(k) for k in (0, 1, 3, 4, 5))],
                    names=["archive", "offset", "length", "page_id", "url", "digest", "record_type", "refers_to"])
        finally:
            if out:
                out.close()
    return run


def write(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """Write a record per page below ``folder``; the stored index of the records."""
    pages = named(pages.select("page_id", "url", "html"), "page_id", "html")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    url = F.coalesce(F.regexp_replace("url", r"[\r\n]", " "), F.concat(F.lit("urn:page:"), F.col("page_id")))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    firsts = pages.where(F.length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    # Stored, so that both sides of the join shuffle alone and a payload of many pages can be split.
    firsts = stored(firsts.where("n > 1").select("digest", "first"), "payloads")
    later = F.col("first").isNotNull() & (F.col("first") < F.col("page_id"))
    typed = pages.join(firsts, "digest", "left").select(
        "page_id", "url", F.when(~later, F.col("payload")).otherwise(F.lit(b"")).alias("payload"), "digest",
        F.when(later, "revisit").otherwise("response").alias("record_type"), F.when(later, F.col("first")).alias("refers_to"))
    return stored(typed.mapInArrow(_write(folder), INDEX), "warc-index")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for archive, listed in zip(batch.column(0), batch.column(1)):
            system, path = fs.FileSystem.from_uri(archive.as_py())
            ranges = sorted((r["offset"], r["length"]) for r in listed.as_py())
            with system.open_input_file(path) as file:
                at = 0
                while at < len(ranges):
                    start, end, to = ranges[at][0], sum(ranges[at]), at + 1
                    while to < len(ranges) and ranges[to][0] - end <= GAP and sum(ranges[to]) - start <= STRETCH:
                        end, to = max(end, sum(ranges[to])), to + 1
                    data = file.read_at(end - start, start)
                    out = []
                    for offset, length in ranges[at:to]:
                        headers, payload = _parse(data[offset - start:offset - start + length])
                        out.append((int(headers["X-Page-ID"]), headers["WARC-Target-URI"], headers["WARC-Type"],
                                    int(headers["X-Refers-To-Page"]) if "X-Refers-To-Page" in headers else None,
                                    headers["WARC-Payload-Digest"].removeprefix("sha256:"), payload))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(column, kind) for column, kind in
                        zip(zip(*out), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()))],
                        names=["page_id", "url", "record_type", "refers_to", "payload_digest", "payload"])
                    at = to


def read(selected: DataFrame) -> DataFrame:
    """Records of the selected index rows; a revisit's payload is empty, its digest that of the payload it refers to."""
    # Rows of the index say little about the bytes behind them, so the number of tasks follows those bytes.
    size = selected.agg(F.sum("length")).first()[0] or 0
    tasks = max(-(-size // TASK), min(-(-size // STRETCH), selected.sparkSession.sparkContext.defaultParallelism), 1)
    placed = selected.select("archive", F.floor(F.col("offset") / STRETCH).alias("stretch"), "offset", "length")
    stretches = placed.repartition(tasks, "archive", "stretch").groupBy("archive", "stretch").agg(
        F.collect_list(F.struct("offset", "length")).alias("ranges"))
    return stretches.select("archive", "ranges").mapInArrow(_read, RECORD)


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Archive all pages, read all records back, and describe each page's record.

    Digests of responses are taken again from the payloads that were read; a payload that does not
    match the digest in its record's header is an error.
    """
    index = write(pages, scratch_path(pages.sparkSession, "warc"), least)
    digest = F.sha2("payload", 256)
    checked = F.when((F.col("record_type") == "revisit") | (digest == F.col("payload_digest")), F.col("payload_digest")).otherwise(
        F.raise_error(F.concat(F.lit("payload differs from its digest on page "), F.col("page_id"))))
    records = stored(read(index).select("page_id", F.length("payload").cast("long").alias("payload_bytes"), checked.alias("payload_digest"),
                                        "record_type", "refers_to"), "records")
    referred = records.where("refers_to IS NOT NULL").select("page_id", "payload_digest", "record_type", "refers_to")
    originals = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_bytes")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return records.where("refers_to IS NULL").select(*columns).union(referred.join(originals, "refers_to").select(*columns))
