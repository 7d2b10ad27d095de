"""URL verdicts equal a plain search through all rules, over several shards and with equal keys."""

import random
import tempfile

import numpy as np
from pyspark.sql import functions as F

from blockloom.llm import urls

RULES = urls.RULES + [("a.com", "/", "block"), ("com", "/fr/x", "block"), ("", "/", "block")]


def plain(url, rules, listed):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:cut], rest[cut:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = tail[:min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    return host, path, None, "block" if (host, path) in listed and host else "allow"


def urls_of(count):
    draw = random.Random(4)
    hosts = ["example.org", "www.Example.ORG", "a.com", "b.a.com", "x.net", "com", "org", "sub.b.com", "aexample.org"]
    paths = ["", "/", "/es/", "/es/1", "/en/1", "/en/12", "/fr/", "/fr/xy", "/de/9", "/q"]
    ends = ["", "?a=1", "#top", "?utm_source=x", "?x=://y"]
    found = [draw.choice(["http://", "https://", "x://", ""]) + draw.choice(hosts) + draw.choice(paths) + draw.choice(ends) for _ in range(count)]
    return found + [None, "", "://", "no scheme", "http://h\ni/es/"]


def test_equals_plain_search(spark):
    rows = list(enumerate(urls_of(400))) + [(None, "http://example.org/es/z"), (7, "http://a.com/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("other")).withColumn("rule", F.lit(1))
    listed = {plain(u, [], set())[:2] for _, u in rows if u and "utm_" in u}
    for size in (urls.SHARD_ROWS, 5):
        index = urls.build(urls.rule_rows(spark, RULES).unionByName(urls.tracked_pages(pages)), size)
        assert (len(index["shards"]) > 1) == (size == 5)
        got = sorted(str(tuple(row)) for row in urls.judge(pages, index).collect())
        assert got == sorted(str((number, *plain(url, RULES, listed))) for number, url in rows)


def test_equal_keys_are_told_apart():
    entries = sorted([(7, b"one\tblock"), (7, b"two\tallow"), (9, b"three\tblock")])
    with tempfile.NamedTemporaryFile() as file:
        file.write(urls.Shard.bytes_of(entries))
        file.flush()
        shard = urls.Shard(file.name)
        assert shard.find(np.array([7, 7, 7, 9, 1, 99], np.uint64), ["two", "one", "other", "three", "one", "one"]) == ["allow", "block", None, "block", None, None]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    index = urls.build(urls.rule_rows(spark, RULES).limit(0))
    assert urls.judge(none, index).count() == 0
    one = spark.createDataFrame([(1, "http://example.org/es/")], "page_id long, url string")
    assert [tuple(r) for r in urls.judge(one, index).collect()] == [(1, "example.org", "/es/", None, "allow")]
