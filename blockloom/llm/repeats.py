"""Removal of passages that repeat an earlier document, by seed and extend over winnowed anchors.

A window is LENGTH consecutive words. Of the seeds (runs of SEED words) in a window the one whose hash is smallest is its anchor (the last of equal
ones), so the choice depends on the words of the window alone and equal windows of two documents have the same anchor at the same place. An
anchor serves a stretch of consecutive windows, on average about (LENGTH - SEED + 2) / 2.

* Seed: anchors are joined by hash; those of one document only are dropped.
* Extend: an anchor is extended both ways to the ends of the windows it serves. Extensions with equal words form a class, and every member but
  those of the smallest document has an earlier copy of its whole stretch. No member meets another one: a class knows its smallest document.
* Where the extensions of a seed differ, the windows of the smallest documents of each class are compared one by one, so that a match that ends inside a
  stretch is kept to the word.
* Stretches and windows with an earlier copy, united, are the maximal repeats of a document.

Rows grow with the windows near the ends of matches, never with pairs of documents. Words are compared by 64-bit hashes, stretches and
windows by the 64-bit hash of their seed together with a 64-bit hash of their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from blockloom.llm import common

LENGTH = 50
SEED = 20
#: Odd multipliers of the rolling hash and of the mixing.
BASE = 0x9E3779B97F4A7C15
MIX = [np.uint64(c) for c in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
ANCHORS = "array<struct<seed: bigint, stretch: bigint, start: int, count: int>>"


def scrambled(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that looks random."""
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the base and of its inverse modulo 2^64, as far as they were needed."""

    def __init__(self) -> None:
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, count: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < count:
            def powers(base: int) -> np.ndarray:
                steps = np.full(2 * count, base, np.uint64)
                steps[0] = 1
                return np.cumprod(steps, dtype=np.uint64)

            self.up, self.down = powers(BASE), powers(pow(BASE, -1, 1 << 64))
        return self.up[:count], self.down[:count]


POWERS = Powers()


class Rolling:
    """Hashes of any run of words of one text, each from two prefix sums."""

    def __init__(self, words: list[bytes]):
        hashes = np.array([xxhash.xxh64_intdigest(word) for word in words], np.uint64)
        self.up, down = POWERS.upto(len(words) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * down[:-1], dtype=np.uint64)])

    def of(self, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
        return scrambled((self.sums[starts + lengths] - self.sums[starts]) * self.up[starts])


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as bytes."""
    return text.encode().split()


def anchors(words: list[bytes], length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(seed hash, stretch hash, first window, number of windows) of every anchor; none for fewer words than a window."""
    if len(words) < length:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.int32),) * 2
    rolling = Rolling(words)
    seeds = rolling.of(np.arange(len(words) - seed + 1), seed)
    last = np.uint64(0xFFFFFFFF)
    order = (scrambled(seeds * MIX[2]) >> np.uint64(32)) << np.uint64(32) | (last - np.arange(len(seeds), dtype=np.uint64))
    width, wanted = 1, length - seed + 1
    while 2 * width <= wanted:  # smallest of windows twice as wide, up to the wanted width
        order = np.minimum(order[:-width], order[width:])
        width *= 2
    if wanted > width:
        order = np.minimum(order[:width - wanted], order[wanted - width:])
    chosen = (last - (order & last)).astype(np.int64)
    starts = np.flatnonzero(np.diff(chosen, prepend=-1))
    counts = np.diff(starts, append=len(chosen))
    stretches = rolling.of(starts, counts - 1 + length) ^ scrambled((chosen[starts] - starts).astype(np.uint64) + MIX[2])
    return seeds[chosen[starts]].view(np.int64), stretches.view(np.int64), starts.astype(np.int32), counts.astype(np.int32)


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, hash and text of the rows: id and hash find a row again, also where ids repeat."""
    text = F.coalesce("text", F.lit(""))
    return common.few_rows(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _anchors(rows: DataFrame, length: int, seed: int) -> DataFrame:
    """A row for each anchor of each row of documents that has an id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches):
            found = [anchors(words_of(text), length, seed) for text in common.text_of(batch)]
            owner = pa.array(np.repeat(np.arange(len(found)), [len(row[0]) for row in found]))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(name).take(owner) for name in ("doc_id", "th")], *[pa.array(np.concatenate([row[k] for row in found])) for k in range(4)]],
                names=["doc_id", "th", "seed", "stretch", "start", "count"])

    return rows.where("doc_id IS NOT NULL").mapInArrow(run, "doc_id long, th long, seed long, stretch long, start int, count int")


def _windows(rows: DataFrame, stretches: DataFrame, length: int) -> DataFrame:
    """The windows of the given stretches one by one: doc_id, th, seed, hash of the words, start."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, 64):
            parts = []
            for k, (text, own) in enumerate(zip(common.text_of(batch), batch.column("own").to_pylist())):
                rolling = Rolling(words_of(text))
                counts = np.array([row["count"] for row in own])
                starts = np.repeat([row["start"] for row in own], counts) + np.arange(counts.sum()) - np.repeat(counts.cumsum() - counts, counts)
                parts.append((np.full(len(starts), k), np.repeat(np.array([row["seed"] for row in own], np.int64), counts), rolling.of(starts, length), starts))
            if parts:
                owner, seeds, hashes, starts = (np.concatenate([part[k] for part in parts]) for k in range(4))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(name).take(pa.array(owner)) for name in ("doc_id", "th")], pa.array(seeds), pa.array(hashes.view(np.int64)), pa.array(starts.astype(np.int32))],
                    names=["doc_id", "th", "seed", "window", "start"])

    own = stretches.groupBy("doc_id", "th").agg(F.collect_set(F.struct("seed", "start", "count")).alias("own"))
    return rows.join(own, ["doc_id", "th"]).select("doc_id", "th", "text", "own").mapInArrow(run, "doc_id long, th long, seed long, window long, start int")


def _several(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that are in more than one document, with the smallest one; staged, so that a join with a key of very many rows can be split."""
    firsts = rows.groupBy(*keys).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    return common.staged(firsts.select(*keys, "first"), "several")


def repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(doc_id, th, begin, end): stretches of words, in windows of ``length``, that also start in a document with a smaller id.

    ``th`` is ``xxhash64`` of the text (a null one as empty). Stretches of a document may touch or overlap; their union is the set of its maximal repeats. A document's own
    repetitions do not count, nor do rows with the same id; a row without an id neither repeats nor is repeated.
    """
    rows = _rows(docs)
    found = common.staged(_anchors(rows, length, seed), "anchors")
    several = _several(found, "seed")
    shared = common.staged(found.join(several.select("seed"), "seed", "left_semi"), "shared")
    common.remove(found)
    classes = common.staged(shared.groupBy("seed", "stretch").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")), "classes")
    whole = (shared.join(classes.where("first < last").drop("last"), ["seed", "stretch"]).where("doc_id > first")
             .select("doc_id", "th", F.col("start").alias("begin"), (F.col("start") + F.col("count") - 1 + length).alias("end")))
    # Where all extensions of a seed are equal nothing is left to compare.
    differing = classes.groupBy("seed").agg(F.min("stretch").alias("low"), F.max("stretch").alias("high"), F.min("first").alias("first"), F.max("last").alias("last"))
    differing = differing.where("low <> high AND first < last").select("seed")
    open_ones = shared.join(classes.join(differing, "seed", "left_semi").select("seed", "stretch", F.col("first").alias("doc_id")), ["seed", "stretch", "doc_id"], "left_semi")
    windows = common.staged(_windows(rows, open_ones, length), "windows")
    again = _several(windows, "seed", "window")
    single = (windows.join(again, ["seed", "window"]).where("doc_id > first")
              .select("doc_id", "th", F.col("start").alias("begin"), (F.col("start") + length).alias("end")))
    spans = common.staged(whole.unionByName(single), "spans")
    for table in (several, shared, classes, windows, again):
        common.remove(table)
    return spans


def removed(count: int, spans: list) -> np.ndarray:
    """Which of so many words lie in one of the spans."""
    steps = np.zeros(count + 1, np.int64)
    for begin, end in spans:
        steps[begin] += 1
        steps[end] -= 1
    return steps[:-1].cumsum() > 0


def _judged(docs: DataFrame, length: int, seed: int) -> DataFrame:
    rows = _rows(docs)
    spans = repeats(docs, length, seed).groupBy("doc_id", "th").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    return rows.join(spans, ["doc_id", "th"], "left").select("doc_id", "text", "spans")


def without_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, kept (the words that stay, with one blank between), begins, ends (the maximal repeats, in words).

    A null, empty or short text keeps all its words; other columns are not read, repeated rows stay, an empty table gives an empty one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches):
            out = []
            for text, spans in zip(common.text_of(batch), batch.column("spans").to_pylist()):
                words = words_of(text)
                gone = removed(len(words), [(s["begin"], s["end"]) for s in spans or []])
                edges = np.flatnonzero(np.diff(gone, prepend=False, append=False)).reshape(-1, 2)
                out.append((b" ".join([word for word, out_ in zip(words, gone.tolist()) if not out_]).decode(), edges[:, 0].tolist(), edges[:, 1].tolist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([row[0] for row in out], pa.string()),
                                              *[pa.array([row[k] for row in out], pa.list_(pa.int32())) for k in (1, 2)]], names=["doc_id", "kept", "begins", "ends"])

    return _judged(docs, length, seed).mapInArrow(run, "doc_id long, kept string, begins array<int>, ends array<int>")


def measured(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256, the digest of the words that stay; rows as in ``without_repeats``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches):
            counts, gone, digests = [], [], []
            for text, spans in zip(common.text_of(batch), batch.column("spans").to_pylist()):
                words = words_of(text)
                counts.append(len(words))
                flags = removed(len(words), [(s["begin"], s["end"]) for s in spans]) if spans else None
                gone.append(int(flags.sum()) if spans else 0)
                kept = words if not spans else [word for word, out in zip(words, flags.tolist()) if not out]
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())],
                                             names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _judged(docs, length, seed).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(common.table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
w AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS pos FROM d WHERE len(words) >= 50),
h AS (SELECT doc_id, pos, sha256(array_to_string(words[pos:pos + 49], ' ')) AS h FROM w),
f AS (SELECT h, min(doc_id) AS first FROM h GROUP BY h HAVING min(doc_id) < max(doc_id)),
g AS (SELECT h.doc_id, list(DISTINCT h.pos) AS starts FROM h JOIN f ON h.h = f.h WHERE h.doc_id > f.first GROUP BY h.doc_id),
c AS (SELECT doc_id, list_distinct(flatten(list_transform(starts, lambda s: range(s, s + 50)))) AS gone FROM g),
x AS (SELECT doc_id, unnest(gone) AS pos FROM c),
k AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS pos FROM d WHERE len(words) >= 50),
s AS (SELECT k.doc_id, k.words[k.pos] AS word, k.pos FROM k ANTI JOIN x ON k.doc_id = x.doc_id AND k.pos = x.pos),
t AS (SELECT doc_id, count(*) AS kept, string_agg(word, ' ' ORDER BY pos) AS text FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words,
  CASE WHEN len(d.words) < 50 THEN 0 ELSE len(d.words) - coalesce(t.kept, 0) END AS n_removed,
  CASE WHEN len(d.words) < 50 THEN sha256(array_to_string(d.words, ' ')) ELSE sha256(coalesce(t.text, '')) END AS kept_sha256
FROM d LEFT JOIN t ON d.doc_id = t.doc_id
"""
