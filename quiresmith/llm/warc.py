"""WARC archives, index first (operator 4).

Writing returns an index of one row per record: file, offset, length, URL,
digest. Reading takes any selection of index rows, sorts it by place, joins
neighbouring byte ranges into larger reads, and parses the records out of them.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiresmith.llm.files import Input, Output
from quiresmith.session import work_path, written

FILE_BYTES = 64 << 20
GAP_BYTES = 64 << 10
READ_BYTES = 8 << 20
INDEX = "page_id long, url string, payload_digest string, record_type string, refers_to long, file string, offset long, length long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode("ascii")


def record_id(page_id: int | None) -> str:
    """The same page always has the same record id."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}')}>"


def _field(value: str) -> str:
    """Header values stay on one line."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _plain(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> tuple[bytes, str]:
    """One WARC/1.1 record, gzipped on its own, and the payload digest."""
    sha = digest(payload)
    revisit = refers_to is not None
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", _field(url)))
    fields += [("WARC-Payload-Digest", f"sha1:{sha}"), ("X-Payload-Length", str(len(payload)))]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-ID", str(refers_to))]
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (b"" if revisit else payload)
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(body)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(head.encode("utf-8") + body + b"\r\n\r\n") + packer.flush(), sha


def parse_record(raw: bytes) -> dict:
    """The fields of one gzipped record; digest and length of a full payload are computed, not believed."""
    data = zlib.decompress(raw, 31)
    cut = data.index(b"\r\n\r\n")
    lines = data[:cut].decode("utf-8").split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    body = data[cut + 4 : cut + 4 + int(fields["Content-Length"])]
    payload = body[body.index(b"\r\n\r\n") + 4 :]
    revisit = fields["WARC-Type"] == "revisit"
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "page_id": number("X-Page-ID"), "url": _plain(fields["WARC-Target-URI"]) if "WARC-Target-URI" in fields else None, "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page-ID"),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else digest(payload), "payload_bytes": number("X-Payload-Length") if revisit else len(payload), "payload": None if revisit else payload,
    }


def write_warc(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_revisit_bytes: int = 0, date: str = "2000-01-01T00:00:00Z", hot: int = 10_000) -> DataFrame:
    """Write one record per page below ``folder`` and return the index (INDEX), itself a written table.

    Of pages with equal payloads of at least ``min_revisit_bytes`` the one with
    the largest id is a response, the others are revisits of it; smaller
    payloads are responses all. A null html is an empty payload; null urls are
    left out of the record; rows with a null id are responses of their own kind
    and are referred to by none. Rows that repeat the largest id are responses
    each. An empty table gives an empty index. Other columns are ignored.
    Shuffles: digests, pre-aggregated; and pages by digest, where skewed digests split.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    last = rows.where(F.octet_length("html") >= min_revisit_bytes).groupBy("sha").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1")
    last = written(last, "payloads")
    rows = rows.join(F.broadcast(last.where(F.col("n") > hot).select("sha", F.col("last").alias("hot_last"))), "sha", "left")
    dealt = rows.withColumn("sha", F.when(F.col("hot_last").isNull(), F.col("sha")).otherwise(F.concat(F.lit("page "), F.xxhash64("page_id", "url"))))
    known = F.coalesce("hot_last", "last")
    marked = dealt.join(last.where(F.col("n") <= hot).drop("n"), "sha", "left").select("page_id", "url", "html", F.when(F.col("page_id") != known, known).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            index: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or out.offset >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    out = Output(folder, ".warc.gz")
                record, sha = build_record(row[0], row[1], row[2].encode("utf-8"), row[3], date)
                index.append((row[0], row[1], sha, "response" if row[3] is None else "revisit", row[3], out.uri, out.write(record), len(record)))
            types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            names = ["page_id", "url", "payload_digest", "record_type", "refers_to", "file", "offset", "length"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index, strict=True) if index else [[]] * 8, types, strict=True)], names)
        if out is not None:
            out.close()

    return written(marked.mapInArrow(run, INDEX), "warc-index")


def coalesced(ranges: list[tuple[int, int]], gap: int = GAP_BYTES, most: int = READ_BYTES) -> Iterator[tuple[int, int, list[int]]]:
    """(offset, length, members) of the reads that cover sorted (offset, length) ranges."""
    start = end = -1
    members: list[int] = []
    for i, (offset, length) in enumerate(ranges):
        if members and (offset - end > gap or max(end, offset + length) - start > most):
            yield start, end - start, members
            members = []
        if not members:
            start = end = offset
        members.append(i)
        end = max(end, offset + length)
    if members:
        yield start, end - start, members


def read_warc(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records that ``index`` selects (any rows of an index, in any order), as RECORD.

    Without ``with_payload`` the payload column is null. The selection is dealt out and sorted by file and offset,
    so a task reads stretches of files in order, and ranges that lie close are read together. Repeated index rows
    give repeated records; an empty selection gives none.
    """
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = index.select("file", "offset", "length").repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            places = sorted(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            by_file: dict[str, list[tuple[int, int]]] = {}
            for name, offset, length in places:
                by_file.setdefault(name, []).append((offset, length))
            for name, ranges in by_file.items():
                source = Input(name)
                for start, size, members in coalesced(ranges):
                    data = source.read(start, size)
                    rows = [parse_record(data[ranges[i][0] - start : ranges[i][0] - start + ranges[i][1]]) for i in members]
                    yield pa.RecordBatch.from_pylist([r if with_payload else r | {"payload": None} for r in rows], schema=schema)
                source.close()

    return places.mapInArrow(run, RECORD)


def archive(pages: DataFrame, name: str = "warc", **options) -> DataFrame:
    """Write ``pages`` to a fresh folder of archives and return the index."""
    return write_warc(pages, work_path(pages.sparkSession, name), **options)
