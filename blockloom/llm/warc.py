"""WARC records in seekable Zstandard bundles.

Records are grouped into independent frames of a bounded size. A bundle ends with a seek table (a skippable frame that
lists compressed and plain size of each frame), so any frame can be found and unpacked alone, and an index table maps
each record id to bundle, frame and offset inside the frame. Equal payloads are stored once: the record with
the smallest page id is the response, the others are revisits that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from blockloom.llm import common

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 25
DATE = "1970-01-01T00:00:00Z"
#: Fixed values of the seekable format: skippable frame, its footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "record_id string, page_id long, bundle string, frame int, offset int, length int"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """One record; ``first`` is the page whose response holds the payload, null for a response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if first is None else b"")
    head = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE),
            ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if url:
        head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if page_id is not None:
        head.append(("Page-ID", str(page_id)))
    if first is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                 ("WARC-Refers-To", record_id(first, digest)), ("Refers-To-Page-ID", str(first))]
    head.append(("Content-Length", str(len(block))))
    return "".join(["WARC/1.1\r\n", *[f"{k}: {v}\r\n" for k, v in head], "\r\n"]).encode() + block + b"\r\n\r\n"


def parse(data: bytes, start: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at ``start``, and where it ends."""
    stop = data.index(b"\r\n\r\n", start)
    lines = data[start:stop].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no record starts here")
    head = dict(line.split(": ", 1) for line in lines[1:])
    size = int(head["Content-Length"])
    return head, data[stop + 4:stop + 4 + size], stop + 8 + size


def payload_of(head: dict[str, str], block: bytes) -> tuple[int, bytes]:
    """Full payload size as the HTTP header states it, and the stored payload (empty for a revisit)."""
    stop = block.index(b"\r\n\r\n")
    http = dict(line.split(": ", 1) for line in block[:stop].decode().split("\r\n")[1:])
    return int(http["Content-Length"]), block[stop + 4:]


class Bundle:
    """Collects records into frames of one file."""

    def __init__(self, out):
        self.out, self.packer, self.sizes, self.frame, self.fill = out, zstandard.ZstdCompressor(level=3), [], [], 0

    def add(self, record: bytes) -> tuple[int, int]:
        place = len(self.sizes), self.fill
        self.frame.append(record)
        self.fill += len(record)
        if self.fill >= FRAME_BYTES:
            self.flush()
        return place

    def flush(self) -> None:
        if self.frame:
            packed = self.packer.compress(b"".join(self.frame))
            self.out.write(packed)
            self.sizes.append((len(packed), self.fill))
            self.frame, self.fill = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *pair) for pair in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()

    @property
    def plain_bytes(self) -> int:
        return self.fill + sum(plain for _, plain in self.sizes)


def seek_table(file) -> list[tuple[int, int]]:
    """(start, compressed size) of each frame, read from the end of a bundle."""
    size = file.size()
    file.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    width = 12 if flags & 0x80 else 8
    file.seek(size - 9 - width * count)
    entries, starts, at = file.read(width * count), [], 0
    for i in range(count):
        packed = struct.unpack_from("<I", entries, width * i)[0]
        starts.append((at, packed))
        at += packed
    return starts


def read_frame(file, place: tuple[int, int]) -> bytes:
    file.seek(place[0])
    return zstandard.ZstdDecompressor().decompress(file.read(place[1]))


def with_firsts(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, digest, first (page of the response with an equal payload; null for a response)."""
    @F.arrow_udf("string")
    def digest(payloads: pa.Array) -> pa.Array:
        return pa.array([digest_of(bytes(p)) for p in payloads.to_pylist()], pa.string())

    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", digest("payload"))
    groups = (rows.where(F.length("payload") >= least_bytes).groupBy("digest")
              .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").drop("n"))
    out = rows.join(groups, "digest", "left")
    return out.withColumn("first", F.when(F.coalesce(F.col("page_id") != F.col("first"), F.lit(True)), F.col("first")))


def write_bundles(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write one record per row and return the index: record_id, page_id, bundle, frame, offset, length.

    A null html is an empty payload. Payloads of fewer than ``least_bytes`` bytes are all responses. Rows with the same page id and payload are equal
    records and keep their type; a row with a null page id refers to the smallest id with its payload, if any. An empty
    table writes no bundle. Other columns are not read. A repeated task writes files of its own and the index names only
    those of the attempt that counted; a lost executor costs its tasks, as bundles lie in the shared folder.
    """
    folder = folder or common.new_folder(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        system, inner = common.open_folder(folder)
        system.create_dir(inner, recursive=True)
        bundle, name, number = None, "", 0
        for batch in common.pieces(batches):
            rows = []
            for row in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "first")]):
                if bundle is None:
                    name = f"{task.partitionId()}-{task.taskAttemptId()}-{number}.warc.zst"
                    bundle, number = Bundle(system.open_output_stream(f"{inner}/{name}", compression=None)), number + 1
                record = record_bytes(row[0], row[1], row[2], row[3], row[4])
                rows.append((record_id(row[0], row[3]), row[0], name, *bundle.add(record), len(record)))
                if bundle.plain_bytes >= BUNDLE_BYTES:
                    bundle.close()
                    bundle = None
            yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(
                zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()))],
                names=["record_id", "page_id", "bundle", "frame", "offset", "length"])
        if bundle is not None:
            bundle.close()

    index = with_firsts(common.few_rows(pages), least_bytes).mapInArrow(run, INDEX).withColumn("bundle", F.concat(F.lit(folder + "/"), "bundle"))
    return common.staged(index, "warc-index")


def _row(head: dict[str, str], block: bytes) -> tuple:
    size, payload = payload_of(head, block)
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if head["WARC-Type"] == "response" and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError(f"damaged record {head['WARC-Record-ID']}")
    page, first = head.get("Page-ID"), head.get("Refers-To-Page-ID")
    return page and int(page), size, digest, head["WARC-Type"], first and int(first)


def read_bundles(index: DataFrame) -> DataFrame:
    """All records of the bundles that an index names, frame by frame; the digest of each response is checked."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle in batch.column("bundle").to_pylist():
                system, path = common.open_folder(bundle)
                with system.open_input_file(path) as file:
                    for place in seek_table(file):
                        data, at, rows = read_frame(file, place), 0, []
                        while at < len(data):
                            head, block, at = parse(data, at)
                            rows.append(_row(head, block))
                        yield _batch(rows)

    bundles = index.select("bundle").distinct()
    return bundles.repartition(index.sparkSession.sparkContext.defaultParallelism * 4, "bundle").mapInArrow(run, READ)


def fetch(index: DataFrame, ids: DataFrame) -> DataFrame:
    """The records with the given ``record_id``, unpacking only the frames that hold them: record_id and payload (null for a revisit)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple = (None, None, None)
        for batch in batches:
            rows = []
            for bundle, frame, offset in zip(*[batch.column(c).to_pylist() for c in ("bundle", "frame", "offset")]):
                if kept[:2] != (bundle, frame):
                    system, path = common.open_folder(bundle)
                    with system.open_input_file(path) as file:
                        kept = bundle, frame, read_frame(file, seek_table(file)[frame])
                head, block, _ = parse(kept[2], offset)
                rows.append((head["WARC-Record-ID"], payload_of(head, block)[1] if head["WARC-Type"] == "response" else None))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())],
                                             names=["record_id", "payload"])

    wanted = index.join(ids.select("record_id").distinct(), "record_id", "left_semi").select("bundle", "frame", "offset")
    return wanted.repartition("bundle", "frame").sortWithinPartitions("bundle", "frame", "offset").mapInArrow(run, "record_id string, payload binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([row[k] for row in rows], kind) for k, kind in enumerate(kinds)],
                                      names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_bundles(write_bundles(common.table(spark, sf_dir, "pages")))


#: The digest column needs base32, which is spelled out over the bits of the hexadecimal digest.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, html,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST(('0b' || substr(array_to_string(list_transform(range(40), lambda k: substr('0000000100100011010001010110011110001001101010111100110111101111',
      1 + 4 * CAST(strpos('0123456789abcdef', substr(sha1(html), k + 1, 1)) - 1 AS INTEGER), 4)), ''), 1 + 5 * i, 5)) AS INTEGER), 1)), '') AS payload_digest
  FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""
