"""Archives are read back in full; frames are found by the seek table; the files are valid Zstandard streams."""

import glob
import hashlib

import zstandard
from pyspark.sql import functions as F

from blockloom.llm import warc
from tests.llm.helpers import LONG

ROWS = [(1, "http://a/", "same"), (2, "http://b/\r\nX: y", "same"), (3, None, None), (4, "http://c/", ""), (5, "http://d/é", "x" * 700_000),
        (None, "http://e/", "same"), (6, "http://f/", LONG), (6, "http://f/", LONG), (7, "http://g/", "\r\n\r\nWARC/1.1\r\n日本")]


def expected(least=0):
    out = []
    for page, _, html in ROWS:
        data = (html or "").encode()
        same = [p for p, _, h in ROWS if (h or "").encode() == data and p is not None]
        first = min(same) if same and len(data) >= least else None
        revisit = first is not None and page != first
        out.append((page, len(data), warc.digest_of(data), "revisit" if revisit else "response", first if revisit else None))
    return sorted(map(str, out))


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("digest", F.lit("d")).withColumn("first", F.lit(3))
    for least in (0, 10):
        index = warc.write_bundles(pages, least_bytes=least)
        assert sorted(str(tuple(r)) for r in warc.read_bundles(index).collect()) == expected(least)


def test_fetch_and_files(spark, tmp_path):
    pages = spark.createDataFrame(ROWS[4:], "page_id long, url string, html string").coalesce(1)
    index = warc.write_bundles(pages, str(tmp_path / "b"))
    assert index.select("bundle", "frame").distinct().count() > 1
    ids = index.where("page_id = 7").select("record_id")
    assert [bytes(r["payload"]).decode() for r in warc.fetch(index, ids).collect()] == [ROWS[-1][2]]
    for name in glob.glob(str(tmp_path / "b" / "*.zst")):
        data = open(name, "rb").read()
        plain = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        assert plain.startswith(b"WARC/1.1\r\n") and plain.count(b"WARC-Record-ID") >= 1
        at = 0
        while at < len(plain):
            head, block, at = warc.parse(plain, at)
            size, payload = warc.payload_of(head, block)
            assert head["WARC-Type"] == "revisit" or len(payload) == size


def test_empty(spark):
    index = warc.write_bundles(spark.createDataFrame([], "page_id long, url string, html string"))
    assert index.count() == 0 and warc.read_bundles(index).count() == 0


def test_digest_text():
    assert warc.digest_of(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ" and len(hashlib.sha1(b"").digest()) == 20
