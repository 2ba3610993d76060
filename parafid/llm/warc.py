"""WARC records in seekable Zstandard bundles.

Records are grouped into independent frames; a bundle is a run of frames and
ends in a seek table (a skippable frame with the sizes of all frames), so any
zstd reader can read it whole and a seeking reader one frame alone. Record ids
map to (bundle, frame, offset inside the frame).

Bundles are written by Spark's text writer, one row a file, whose line end is
the four bytes that end a seek table. So they can go to any store Spark writes
to, and a task that is lost or repeated leaves no half file.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Store
from .registry import query, table

# Fixed values of the WARC and seekable zstd formats.
TABLE_MAGIC, SEEK_MAGIC = 0x184D2A5E, b"\xb1\xea\x92\x8f"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
           "payload binary")
INDEX = "bundle string, frame int, frame_start long, frame_bytes long, offset long, length long, " + RECORDS


def plan_records(pages: DataFrame, least: int = 1000, id_col: str = "page_id", url_col: str = "url",
                 html_col: str = "html") -> DataFrame:
    """The record of each page: RECORDS, with the payload of all of them.

    Of records with equal payloads (by SHA-1 and length) of ``least`` bytes or
    more, that with the largest id is ``response`` and the others ``revisit``
    it. Pages without an id are always ``response``; so are rows that repeat
    the id of the response. Null html is an empty payload.
    """
    body = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), body.alias("payload"))
    p = p.withColumn("payload_bytes", F.length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    groups = (p.filter(F.col("page_id").isNotNull() & (F.col("payload_bytes") >= least))
              .groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("_last"), F.count("*").alias("_n"))
              .filter("_n > 1").drop("_n"))
    groups = Store(pages.sparkSession, "warc-groups").keep(groups)
    p = p.join(groups, ["payload_digest", "payload_bytes"], "left")
    again = (F.col("page_id") != F.col("_last"))
    p = p.withColumn("record_type", F.when(again, "revisit").otherwise("response"))
    p = p.withColumn("refers_to", F.when(again, F.col("_last")))
    return p.select(*[c.split()[0] for c in RECORDS.split(", ")])


def _record(page_id, url, kind, refers_to, size: int, digest: str, payload: bytes) -> bytes:
    block = HTTP if kind == "revisit" else HTTP + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
            "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "%" else f"%{ord(c):02X}" for c in url))
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {size}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _parse(frame: bytes, at: int) -> tuple[dict, bytes, int]:
    """Head fields, block and end of the record at ``at``."""
    end = frame.index(b"\r\n\r\n", at)
    lines = frame[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record at {at}")
    head = dict(x.split(": ", 1) for x in lines[1:])
    block = frame[end + 4:end + 4 + int(head["Content-Length"])]
    stop = end + 4 + len(block) + 4
    if frame[stop - 4:stop] != b"\r\n\r\n":
        raise ValueError(f"record at {at} has no end")
    return head, block, stop


def seal(frames: list[bytes], raw: list[int]) -> bytes:
    """A bundle: frames and seek table, without the table's last four bytes."""
    entries = b"".join(struct.pack("<II", len(f), n) for f, n in zip(frames, raw, strict=True))
    return b"".join(frames) + struct.pack("<II", TABLE_MAGIC, len(entries) + 9) + entries + struct.pack("<IB", len(frames), 0)


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, size) of each frame, from the end of the bundle."""
    if bundle[-4:] != SEEK_MAGIC:
        raise ValueError("no seek table")
    n, flags = struct.unpack("<IB", bundle[-9:-4])
    step = 12 if flags & 0x80 else 8
    at, out = len(bundle) - 9 - n * step, []
    if struct.unpack("<II", bundle[at - 8:at]) != (TABLE_MAGIC, n * step + 9):
        raise ValueError("seek table is damaged")
    start = 0
    for i in range(n):
        packed, raw = struct.unpack("<II", bundle[at + i * step:at + i * step + 8])
        out.append((start, packed, raw))
        start += packed
    return out


def _bundles(frame_bytes: int, bundle_bytes: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, frames, raw, open_, size, total = zstandard.ZstdCompressor(level=level), [], [], [], 0, 0

        def close() -> None:
            nonlocal size, total
            if open_:
                frames.append(packer.compress(b"".join(open_)))
                raw.append(size)
                total += len(frames[-1])
                open_.clear()
                size = 0

        def emit() -> pa.RecordBatch:
            nonlocal total
            out = pa.RecordBatch.from_pydict({"value": pa.array([seal(frames, raw)], pa.binary())})
            frames.clear()
            raw.clear()
            total = 0
            return out

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                r = _record(*row)
                if size and size + len(r) > frame_bytes:
                    close()
                    if total >= bundle_bytes:
                        yield emit()
                open_.append(r)
                size += len(r)
        close()
        if frames:
            yield emit()
    return run


def write_archive(records: DataFrame, path: str, *, frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 25,
                  level: int = 3) -> None:
    """Writes RECORDS as bundles below ``path``. A record larger than a frame has a frame of its own."""
    rows = records.mapInArrow(_bundles(frame_bytes, bundle_bytes, level), "value binary")
    (rows.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1)
     .option("lineSep", SEEK_MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(path))


def _number(uri: str) -> int | None:
    digits = uri[len("<urn:page:"):-1]
    return int(digits) if digits else None


def _rows(name: str, bundle: bytes, wanted: dict[int, set[int]] | None, payloads: bool) -> Iterator[tuple]:
    for k, (start, packed, _) in enumerate(seek_table(bundle)):
        if wanted is not None and k not in wanted:
            continue
        frame, at = zstandard.ZstdDecompressor().decompress(bundle[start:start + packed]), 0
        for at in sorted(wanted[k]) if wanted is not None else _starts(frame):
            head, block, stop = _parse(frame, at)
            kind, digest, size = head["WARC-Type"], head["WARC-Payload-Digest"][5:], int(head["WARC-Payload-Length"])
            body = block[block.index(b"\r\n\r\n") + 4:]
            if kind == "response" and (len(body) != size or hashlib.sha1(body).hexdigest() != digest):
                raise ValueError(f"{name}: payload of the record at {k}:{at} does not match its digest")
            url, to = head.get("WARC-Target-URI"), head.get("WARC-Refers-To")
            yield (name, k, start, packed, at, stop - at, _number(head["WARC-Record-ID"]), url and unquote(url), kind,
                   _number(to) if to else None, size, digest, body if payloads and kind == "response" else None)


def _starts(frame: bytes) -> Iterator[int]:
    at = 0
    while at < len(frame):
        yield at
        end = frame.index(b"\r\n\r\n", at)
        mark = frame.rindex(b"Content-Length: ", at, end) + 16
        at = end + 4 + int(frame[mark:end]) + 4


def _decode(payloads: bool, wanted: bool):
    names = [c.split()[0] for c in INDEX.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in INDEX.split(", ")])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)), schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                at = None
                if wanted:
                    at = {}
                    for x in b.column("at")[i].as_py():
                        at.setdefault(x["frame"], set()).add(x["offset"])
                rows, held = [], 0
                for r in _rows(b.column("path")[i].as_py(), b.column("content")[i].as_py(), at, payloads):
                    rows.append(r)
                    held += len(r[-1] or b"")
                    if len(rows) >= 5000 or held > 1 << 23:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)
    return run


def _files(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
            .filter("length > 0").select("path", "content"))


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records of an archive as INDEX; payloads of responses are held against their digests.

    Without ``payloads`` this is the index that ``fetch`` takes: record id to
    bundle, frame and offset inside the frame.
    """
    return _files(spark, path).mapInArrow(_decode(payloads, False), INDEX)


def fetch(spark: SparkSession, path: str, index: DataFrame, ids: DataFrame) -> DataFrame:
    """The records of ``ids`` (page_id), a revisit with the payload of what it refers to.

    Only the frames that hold them are unpacked. Ids that the archive lacks give
    no row, and an id that repeats in ``ids`` one row.
    """
    ids = ids.select("page_id").distinct()
    found = index.select("bundle", "frame", "offset", "page_id", "refers_to").join(ids, "page_id")
    source = found.filter("refers_to is not null").select(F.col("refers_to").alias("page_id")).distinct()
    more = index.filter("record_type = 'response'").select("bundle", "frame", "offset", "page_id").join(source, "page_id")
    places = found.select("bundle", "frame", "offset").union(more.select("bundle", "frame", "offset"))
    places = places.groupBy("bundle").agg(F.collect_set(F.struct("frame", "offset")).alias("at"))
    got = (_files(spark, path).join(places, F.col("path") == F.col("bundle")).select("path", "content", "at")
           .mapInArrow(_decode(True, True), INDEX))
    got = Store(spark, "warc-fetch").keep(got)
    bodies = got.filter("record_type = 'response'").groupBy(F.col("page_id").alias("_to")).agg(F.first("payload").alias("_body"))
    return (got.join(ids, "page_id").join(bodies, got["refers_to"] == bodies["_to"], "left")
            .withColumn("payload", F.coalesce("payload", "_body")).drop("_to", "_body"))


_ORACLE = """
with p as (select page_id, coalesce(html,'') as h from pages),
q as (select page_id, h, strlen(h) as n, max(page_id) over (partition by h) as last from p)
select page_id, n::bigint as payload_bytes, sha1(h) as payload_digest,
  case when n>=1000 and page_id<>last then 'revisit' else 'response' end as record_type,
  case when n>=1000 and page_id<>last then last end as refers_to from q
"""


@query("op3_warc_bundles", _ORACLE)
def op3_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Store(spark, "warc").path()
    write_archive(plan_records(table(spark, sf_dir, "pages")), path)
    back = read_archive(spark, path, payloads=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
