"""WARC archives: written with an index, read back by coalesced byte ranges.

Each task writes one archive of gzip-compressed records (one member per record) to
the shared folder and returns an index row per record: file, offset, length, URL and
digest. The index is a Parquet table of committed tasks only; an attempt that is lost
leaves a file that no index row names. Reading takes any selection of index rows,
sorts them by file and offset, merges ranges that lie close together into one read of
bounded size, and parses the records.

Records with equal payloads of at least ``revisit_bytes`` are one response (the one
with the largest page_id) and revisits of it. The response is found by a maximum per
digest, combined before its shuffle, and joined back; a digest that a third of all
pages share is a skewed join key, which adaptive execution splits.

Nulls: a null payload is empty; a null url becomes urn:page:<page_id>; a page without
page_id is written, ranks lowest and comes back with a null page_id. Rows with equal
payloads and page_id: both are responses when theirs is the largest page_id. Extra
columns are ignored. No rows give empty tables.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, shared_folder, store, written, written_stage

INDEX = "file string, offset long, length long, url string, digest string, page_id long"
RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
DATE = "2024-01-01T00:00:00Z"


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id}')}>"


def _record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One record. The page's number and the full payload's length are header fields
    of this project's own; readers that don't know them skip them."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_urn(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 2, mtime=0)


def _number(x):
    return None if x is None or x is pd.NA or x != x else int(x)


def _writer(folder: str):
    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = store(folder)
        fs.create_dir(root, recursive=True)
        name, at, out = f"{uuid.uuid4().hex}.warc.gz", 0, None
        for frame in batches:
            rows = []
            for page_id, url, html, refers_to in zip(frame["page_id"], frame["url"], frame["html"], frame["refers_to"]):
                page_id, payload = _number(page_id), (html or "").encode("utf-8", "surrogatepass")
                url = quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else f"urn:page:{page_id}"
                digest = _digest(payload)
                record = _record(page_id, url, payload, digest, _number(refers_to))
                out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
                out.write(record)
                rows.append((f"{folder}/{name}", at, len(record), url, digest, page_id))
                at += len(record)
            yield pd.DataFrame(rows, columns=["file", "offset", "length", "url", "digest", "page_id"]).astype({"page_id": "Int64"})
        if out:
            out.close()

    return f


def write(pages: DataFrame, folder: str | None = None, revisit_bytes: int = 0) -> DataFrame:
    """Writes pages (page_id, url, html) and returns the index."""
    folder = folder or shared_folder(pages.sparkSession, "warc")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html")).withColumn("sha", F.sha1(F.col("html").cast("binary")))
    keys = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("sha"))
    first = keys.groupBy("sha").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("k")).where("k > 1").select("sha", "top")
    refers = F.when((F.octet_length("html") >= revisit_bytes) & (F.col("page_id").isNull() | (F.col("page_id") < F.col("top"))), F.col("top"))
    rows = p.join(first, "sha", "left").select("page_id", "url", "html", refers.alias("refers_to"))
    return written(rows.mapInPandas(_writer(folder), INDEX), "warc-index")


def parse(record: bytes) -> tuple:
    """A record's row; checks its digest."""
    head, _, rest = gzip.decompress(record).partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (_digest(payload) != digest or len(payload) != int(fields["X-Payload-Length"])):
        raise ValueError(f"damaged record of {fields['WARC-Target-URI']}")
    number = lambda k: int(fields[k]) if k in fields else None
    return number("X-Page-Id"), fields["WARC-Target-URI"], payload if kind == "response" else None, number("X-Payload-Length"), digest, kind, number("X-Refers-To-Page-Id")


def coalesced(ranges: list[tuple[int, int]], gap: int, most: int) -> Iterator[list[tuple[int, int]]]:
    """Sorted (offset, length) in groups to be read at once: holes of at most gap
    bytes, most bytes in all unless one record is longer."""
    held: list[tuple[int, int]] = []
    for at, n in ranges:
        if held and (at - sum(held[-1]) > gap or at + n - held[0][0] > most):
            yield held
            held = []
        held.append((at, n))
    if held:
        yield held


def _reader(gap: int, most: int):
    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for name, part in frame.groupby("file", sort=False):
                fs, path = store(name)
                with fs.open_input_file(path) as file:
                    for group in coalesced(list(zip(part["offset"].tolist(), part["length"].tolist())), gap, most):
                        start = group[0][0]
                        file.seek(start)
                        data = file.read(sum(group[-1]) - start)
                        rows = [parse(data[at - start : at - start + n]) for at, n in group]
                        yield pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64"})

    return f


def read(index: DataFrame, payload: bool = True, gap: int = 1 << 16, most: int = 8 << 20) -> DataFrame:
    """The records of selected index rows: page_id, url, payload (null for
    revisits), payload_bytes, payload_digest, record_type, refers_to."""
    n = partitions(index.sparkSession)
    rows = index.select("file", "offset", "length").repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
    out = rows.mapInPandas(_reader(gap, most), RECORD)
    return out if payload else out.drop("payload")


def digest_query(pages: DataFrame) -> DataFrame:
    """What is asked of op1."""
    rows = lambda: read(write(pages, revisit_bytes=0)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return written_stage(rows, "warc-digests")  # the archives go


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS x, max(page_id) OVER (PARTITION BY sha1(b)) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((('0x' || substr(x, CAST(i // 4 * 5 + 1 AS INT), 5))::BIGINT >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1 AS INT), 1)), '') AS payload_digest,
CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to
FROM h
"""
