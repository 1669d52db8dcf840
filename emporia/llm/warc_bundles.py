"""Operator 2: WARC archives as seekable Zstandard bundles.

Method: records are grouped into independent Zstandard frames, a footer in a
skippable frame holds the seek table (compressed and plain size of every
frame), and the index maps a record id to its file, frame and offset inside
the decompressed frame.  A reader fetches the footer, seeks to one frame and
decompresses only that.

Records with equal payloads of ``min_revisit`` bytes or more are written once,
as the response with the smallest id; the others become revisit records.

A bundle is written by one task under a name of its own attempt; only files
named by the index (a Parquet table that Spark commits) belong to the archive,
so retried or lost tasks leave no half-written archive behind.  Memory per
task is one frame.

Cases: a null html is an empty payload; a null url becomes an empty target; a
null id gives a record without id; repeated rows of one id are written as they
come, all of them responses if they hold the smallest id of their payload; an
empty table gives an empty index; other columns are not archived.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import shared_folder, ship, stored, table

# Fixed values of the public seekable format of Zstandard.
SKIPPABLE, SEEKABLE, ENTRY, FOOTER = 0x184D2A5E, 0x8F92EAB1, 8, 9

INDEX = "record_id bigint, record_type string, refers_to bigint, file string, frame int, offset bigint, length bigint"
RECORDS = ("record_id bigint, record_type string, refers_to bigint, target string, payload binary, "
           "payload_bytes bigint, payload_digest string")


def file_system(uri: str):
    """The file system and path of a folder or file given as URI or plain path."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    uri = uri.replace("s3a://", "s3://", 1)
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def record_bytes(rid, url, payload: bytes, digest: str, kind: str, refers_to, date: str) -> bytes:
    """One WARC/1.1 record.  A revisit keeps the HTTP header only, whose Content-Length is the payload's."""
    http = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http if kind == "revisit" else http + payload
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}",
            f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response"]
    if rid is not None:
        head.append(f"WARC-Record-ID: <urn:record:{rid}>")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:record:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes, bytes]]:
    """(offset, length, WARC headers, HTTP header, payload) of the records of one decompressed frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
        size = int(head["Content-Length"])
        http, _, payload = data[end + 4:end + 4 + size].partition(b"\r\n\r\n")
        stop = end + 4 + size + 4
        yield at, stop - at, head, http, payload
        at = stop


class BundleWriter:
    """One bundle file: frames of about ``frame_bytes``, closed by the seek table."""

    def __init__(self, uri: str, frame_bytes: int, level: int):
        import zstandard

        fs, path = file_system(uri)
        self.uri, self.out, self.frame_bytes = uri, fs.open_output_stream(path, compression=None), frame_bytes
        self.pack = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.frames: list[tuple[int, int]] = []
        self.parts: list[bytes] = []
        self.filled = self.size = 0

    def add(self, record: bytes) -> tuple[int, int, int]:
        """Append a record; its frame, offset in the frame and length."""
        place = (len(self.frames), self.filled, len(record))
        self.parts.append(record)
        self.filled += len(record)
        if self.filled >= self.frame_bytes:
            self.flush()
        return place

    def flush(self) -> None:
        if self.parts:
            packed = self.pack.compress(b"".join(self.parts))
            self.out.write(packed)
            self.frames.append((len(packed), self.filled))
            self.size += len(packed)
            self.parts, self.filled = [], 0

    def close(self) -> None:
        self.flush()
        table_bytes = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table_bytes)) + table_bytes)
        self.out.close()


class BundleReader:
    """Random access to the frames of a bundle through its footer."""

    def __init__(self, uri: str):
        import zstandard

        fs, path = file_system(uri)
        self.file = fs.open_input_file(path)
        end = self.file.size()
        self.file.seek(end - FOOTER)
        n, flags, magic = struct.unpack("<IBI", self.file.read(FOOTER))
        if magic != SEEKABLE or flags:
            raise ValueError(f"{uri} has no seek table")
        self.file.seek(end - FOOTER - n * ENTRY)
        entries = struct.unpack(f"<{2 * n}I", self.file.read(n * ENTRY))
        self.sizes = list(zip(entries[::2], entries[1::2]))
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)
        self.unpack = zstandard.ZstdDecompressor()

    def frame(self, i: int) -> bytes:
        self.file.seek(self.starts[i])
        return self.unpack.decompress(self.file.read(self.sizes[i][0]), max_output_size=self.sizes[i][1])

    def close(self) -> None:
        self.file.close()


def deduplicated(pages: DataFrame, min_revisit: int = 100) -> DataFrame:
    """(record_id, url, payload, digest, record_type, refers_to) of every page."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").alias("record_id"), "url", payload.alias("payload")).withColumn(
        "digest", F.sha2("payload", 256))
    firsts = (rows.where(F.octet_length("payload") >= min_revisit).groupBy("digest")
              .agg(F.min("record_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
              .where(F.col("n") > 1).select(F.col("digest").alias("same"), "first_id"))
    # A table of its own, so that the join shuffles both sides and can split a payload many pages share.
    joined = rows.join(stored(firsts, "payload-firsts"), F.col("digest") == F.col("same"), "left")
    again = F.coalesce(F.col("record_id") != F.col("first_id"), F.lit(False))
    return joined.select("record_id", "url", "payload", "digest",
                         F.when(again, "revisit").otherwise("response").alias("record_type"),
                         F.when(again, F.col("first_id")).alias("refers_to"))


def write_bundles(records: DataFrame, uri: str, frame_bytes: int = 1 << 20, file_bytes: int = 512 << 20,
                  level: int = 3, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write the records of ``deduplicated`` below ``uri``; the index as a table (INDEX)."""
    names = [c.split()[0] for c in INDEX.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
    ship(records.sparkSession)

    def write(batches):
        import uuid

        from pyspark import TaskContext

        stem = f"{uri}/bundle-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}"
        writer, files = None, 0
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if writer is None:
                    writer, files = BundleWriter(f"{stem}-{files:04d}.warc.zst", frame_bytes, level), files + 1
                place = writer.add(record_bytes(r["record_id"], r["url"], r["payload"], r["digest"], r["record_type"],
                                                r["refers_to"], date))
                rows.append((r["record_id"], r["record_type"], r["refers_to"], writer.uri, *place))
                if writer.size >= file_bytes:
                    writer.close()
                    writer = None
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names)
        if writer is not None:
            writer.close()

    return records.mapInArrow(write, INDEX)


def read_bundles(index: DataFrame) -> DataFrame:
    """Every record of the index's files (RECORDS), frame by frame.

    Payload size and digest are taken from the payload of responses and from
    the headers of revisits, which hold none.
    """
    schema = pa.schema([("record_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                        ("target", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
                        ("payload_digest", pa.string())])

    def read(batches):
        import hashlib

        for batch in batches:
            for name in batch.column("file").to_pylist():
                bundle = BundleReader(name)
                for i in range(len(bundle.sizes)):
                    rows = []
                    for _, _, head, http, payload in parse_records(bundle.frame(i)):
                        revisit = head["WARC-Type"] == "revisit"
                        size = int(http.rpartition(b": ")[2]) if revisit else len(payload)
                        digest = head["WARC-Payload-Digest"].removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest()
                        ids = [int(head[k][12:-1]) if k in head else None for k in ("WARC-Record-ID", "WARC-Refers-To")]
                        rows.append((ids[0], head["WARC-Type"], ids[1], head["WARC-Target-URI"], None if revisit else payload, size, digest))
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                bundle.close()

    ship(index.sparkSession)
    files = index.select("file").distinct()
    # A task a file: the names are a few bytes, which AQE would otherwise gather into one partition.
    return files.repartition(max(1, files.count())).mapInArrow(read, RECORDS)


def read_records(index: DataFrame) -> DataFrame:
    """Only the records of ``index`` (any selection of its rows): seeks to their frames and no others."""
    out = "record_id bigint, target string, payload binary"

    def read(key, rows):
        bundle = BundleReader(key[0].as_py())
        found = []
        want = sorted(zip(rows.column("frame").to_pylist(), rows.column("offset").to_pylist(), rows.column("length").to_pylist(),
                          rows.column("record_id").to_pylist()), key=lambda r: r[:2])
        at, data = -1, b""
        for frame, offset, length, rid in want:
            if frame != at:
                at, data = frame, bundle.frame(frame)
            _, _, head, _, payload = next(parse_records(data[offset:offset + length]))
            found.append((rid, head["WARC-Target-URI"], payload))
        bundle.close()
        types = [pa.int64(), pa.string(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*found), types)], names=["record_id", "target", "payload"])

    return index.groupBy("file").applyInArrow(read, out)


def archive(pages: DataFrame, uri: str | None = None, **options) -> DataFrame:
    """Archive ``pages`` below ``uri`` (default: a folder in the shared checkpoint folder); the committed index."""
    uri = uri or shared_folder(pages.sparkSession, "warc")
    return stored(write_bundles(deduplicated(pages), uri, **options), "warc-index")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return read_bundles(index).select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest",
                                      "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
