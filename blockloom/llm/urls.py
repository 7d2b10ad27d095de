"""URL filters over a sorted digest array.

Entries (a rule of host and path prefix, or one exact address) are kept as 64-bit xxhash keys in sorted shards with
their full strings. The shards lie as files in the shared folder; tasks memory-map them, probe all keys of a batch with
a vectorised binary search and confirm each hit by comparing the full string, going on through equal keys. Pages are
never shuffled, so a host with a third of all rows is no special case, and shards are opened only when a key falls in
their range.
"""

from __future__ import annotations

import json
import mmap
import os
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from blockloom.llm import common

#: Separates the kind, host and path of an entry; no host contains it.
GAP = "\t"
SHARD_ROWS = 500_000
#: Fixed values of the contract: (host, path, verdict).
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def host_of(url: str = "url") -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    return _lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1))


def path_of(url: str = "url") -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def _lower(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _key(entry: str) -> int:
    return xxhash.xxh64_intdigest(entry.encode())


class Shard:
    """One memory-mapped shard: counts, sorted keys, string offsets, then the strings with their verdicts."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        count = struct.unpack_from("<Q", self.map)[0]
        self.keys = np.frombuffer(self.map, "<u8", count, 8)
        self.offsets = np.frombuffer(self.map, "<u8", count + 1, 8 + 8 * count)
        self.base = 8 + 8 * count + 8 * (count + 1)

    @staticmethod
    def bytes_of(entries: list[tuple[int, bytes]]) -> bytes:
        keys = np.array([key for key, _ in entries], "<u8")
        offsets = np.concatenate([[0], np.cumsum([len(text) for _, text in entries], dtype="<u8")]).astype("<u8")
        return struct.pack("<Q", len(entries)) + keys.tobytes() + offsets.tobytes() + b"".join(text for _, text in entries)

    def find(self, keys: np.ndarray, entries: list[str]) -> list[str | None]:
        """Verdict of each probed entry that is stored in full, else null."""
        places = np.searchsorted(self.keys, keys)
        inside = np.minimum(places, len(self.keys) - 1)
        out: list[str | None] = [None] * len(entries)
        for i in np.flatnonzero(self.keys[inside] == keys):
            place = int(places[i])
            while place < len(self.keys) and self.keys[place] == keys[i]:
                text, verdict = self._text(place).rsplit(GAP, 1)
                if text == entries[i]:
                    out[i] = verdict
                    break
                place += 1
        return out

    def _text(self, place: int) -> str:
        return self.map[self.base + int(self.offsets[place]):self.base + int(self.offsets[place + 1])].decode()


def build(entries: DataFrame, shard_rows: int = SHARD_ROWS) -> dict:
    """Write entries (kind ``rule`` or ``page``, host, path, verdict) as sorted shards; returns what probing needs.

    Entries with a null host or path are left out; of repeated entries with different verdicts ``block`` stays. What comes back to
    the driver is a row per shard and the lengths of rule paths and hosts in labels (at most a few hundred values).
    """
    spark = entries.sparkSession
    folder = common.new_folder(spark, "digests")

    @F.arrow_udf("long")
    def key(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([_key(text) for text in texts.to_pylist()], "<u8").view("<i8") ^ np.int64(-2**63))

    text = F.concat_ws(GAP, "kind", "host", "path")
    rows = (entries.where(F.col("host").isNotNull() & F.col("path").isNotNull())
            .groupBy(text.alias("text")).agg(F.max(F.col("verdict")).alias("verdict"))
            .withColumn("key", key("text")))
    rows = common.staged(rows, "entries")  # read by the count, the range bounds and the shards
    shards = max(1, -(-rows.count() // shard_rows))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(int(k) + 2**63, f"{t}{GAP}{v}".encode()) for batch in batches
                 for k, t, v in zip(*[batch.column(c).to_pylist() for c in ("key", "text", "verdict")])]
        if not found:
            return
        task = TaskContext.get()
        system, inner = common.open_folder(folder)
        system.create_dir(inner, recursive=True)
        name = f"{task.partitionId()}-{task.taskAttemptId()}.bin"  # a second attempt writes a file of its own
        with system.open_output_stream(f"{inner}/{name}", compression=None) as out:
            out.write(Shard.bytes_of(found))
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([str(found[0][0])]), pa.array([str(found[-1][0])])], names=["name", "low", "high"])

    ordered = rows.repartitionByRange(shards, "key", "text").sortWithinPartitions("key", "text") if shards > 1 else rows.coalesce(1).sortWithinPartitions("key", "text")
    written = sorted(((int(r["low"]), int(r["high"]), r["name"]) for r in ordered.mapInArrow(write, "name string, low string, high string").collect()))
    common.remove(rows)
    rules = entries.where("kind = 'rule' AND host IS NOT NULL AND path IS NOT NULL")
    lengths = rules.agg(F.collect_set(F.length("path")).alias("paths"), F.collect_set(F.size(F.split("host", "\\."))).alias("labels")).first()
    return {"folder": folder, "shards": written, "paths": sorted(lengths["paths"]), "labels": sorted(lengths["labels"])}


class Probe:
    """Opens shards on demand: directly where the folder is mounted, else from one local copy for each worker."""

    def __init__(self, index: dict):
        self.index, self.open = index, {}
        self.lows = np.array([low for low, _, _ in index["shards"]], np.uint64)
        self.highs = np.array([high for _, high, _ in index["shards"]], np.uint64)

    def _shard(self, number: int) -> Shard:
        if number not in self.open:
            system, inner = common.open_folder(self.index["folder"])
            path = f"{inner}/{self.index['shards'][number][2]}"
            if system.type_name != "local":
                with system.open_input_stream(path, compression=None) as source, tempfile.NamedTemporaryFile(delete=False) as copy:
                    while block := source.read(1 << 22):
                        copy.write(block)
                self.open[number] = Shard(copy.name)
                os.unlink(copy.name)  # the mapping keeps the data
            else:
                self.open[number] = Shard(path)
        return self.open[number]

    def find(self, entries: list[str]) -> list[str | None]:
        out: list[str | None] = [None] * len(entries)
        if not len(self.lows) or not entries:
            return out
        keys = np.array([_key(entry) for entry in entries], np.uint64)
        # Equal keys may lie on both sides of a shard border, so every shard whose range holds the key is asked.
        first, last = np.searchsorted(self.highs, keys, "left"), np.searchsorted(self.lows, keys, "right") - 1
        for number in range(len(self.lows)):
            at = np.flatnonzero((first <= number) & (last >= number))
            if len(at):
                for i, verdict in zip(at, self._shard(number).find(keys[at], [entries[i] for i in at])):
                    out[i] = out[i] or verdict
        return out

    def judge(self, pairs: list[tuple[str, str]]) -> list[tuple[str | None, str | None]]:
        """(rule, verdict) of (host, path) pairs: the longest rule that fits, else an exact address, else nothing."""
        probes, owners = [], []
        for row, (host, path) in enumerate(pairs):
            labels = host.split(".")
            for count in self.index["labels"]:
                if count <= len(labels) and host:
                    tail = ".".join(labels[-count:])
                    for size in self.index["paths"]:
                        if size <= len(path):
                            probes.append(GAP.join(("rule", tail, path[:size])))
                            owners.append((row, tail + path[:size]))
            if host:
                probes.append(GAP.join(("page", host, path)))
                owners.append((row, None))
        best: list[tuple[str | None, str | None]] = [(None, None)] * len(pairs)
        for (row, rule), verdict in zip(owners, self.find(probes)):
            if verdict and (best[row][1] is None or rule and (best[row][0] is None or len(rule) > len(best[row][0]))):
                best[row] = (rule, verdict)
        return best


def judge(pages: DataFrame, index: dict, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (host and path of the longest rule that fits, else null) and verdict of every row.

    A rule fits its host and all subdomains when the path starts with the rule's. A url without a rule gets the verdict of its exact
    address in the list, else ``default``. Null and malformed urls have an empty host and path and the default;
    repeated rows stay; other columns are not read; an empty table gives an empty one.
    """
    text = json.dumps(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = Probe(json.loads(text))
        for batch in batches:
            found = probe.judge(list(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id").cast(pa.int64()), batch.column("host"), batch.column("path"),
                 pa.array([rule for rule, _ in found], pa.string()), pa.array([verdict or default for _, verdict in found], pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"])

    schema = "page_id long, host string, path string, rule string, verdict string"
    return pages.select("page_id", host_of().alias("host"), path_of().alias("path")).mapInArrow(run, schema)


def rule_rows(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame([("rule", *rule) for rule in rules], "kind string, host string, path string, verdict string")


def tracked_pages(pages: DataFrame) -> DataFrame:
    """Exact entries of the query: an address that is advertised with a campaign parameter anywhere is blocked."""
    return pages.where(F.col("url").contains("utm_")).select(
        F.lit("page").alias("kind"), host_of().alias("host"), path_of().alias("path"), F.lit("block").alias("verdict")).where("host <> ''")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    index = build(rule_rows(spark, RULES).unionByName(tracked_pages(pages)))
    return judge(pages, index)


_PARTS = """
WITH parts AS (
  SELECT page_id, url,
    CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts)"""
SQL = _PARTS + """,
rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits AS (
  SELECT page_id, host, path, h || p AS rule, v FROM split JOIN rules
  ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
best AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v FROM fits GROUP BY page_id),
listed AS (SELECT DISTINCT host, path FROM split WHERE contains(url, 'utm_') AND host <> '')
SELECT s.page_id, s.host, s.path, b.rule,
  CASE WHEN b.v IS NOT NULL THEN b.v WHEN l.host IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM split s LEFT JOIN best b USING (page_id) LEFT JOIN listed l ON s.host = l.host AND s.path = l.path
"""
