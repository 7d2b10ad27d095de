"""Alignment of two tokenizers by byte ranges, with document counts of all linked id pairs by an external, run-based count.

Both tokenizers encode the same bytes, a blank and the text. Tokens of the two are linked where their bytes overlap, and byte offsets at which
tokens of both end cut them into groups. How many documents hold an id pair linked is counted without a table of pairs in memory:

* A task writes its links as packed numbers (radix of the first id, pair, document) into a buffer. A full buffer is sorted, folded to one
  record for each pair and document, cut by radix, and written to the shared folder as a run: Zstandard frames of pairs and document counts,
  beside frames of the documents with their number of links.
* Counting reads the heads of the runs alone: a k-way merge, whose heap holds the block of each run by its last pair, sums equal pairs. The
  merged counts of different tasks meet in one partial aggregate over pairs, a table bounded by the two vocabularies and not by the documents.
* The totals are kept in order of the first id, so the highest count of an id is that of one stretch. Runs and totals have the same order;
  reading them side by side gives each document's share, which is added up by document.

Runs never move and are bounded, so neither a pair that every document holds nor a large table of documents makes a large task.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from blockloom.llm import common

RADIX_BITS = 6
PLACE_BITS = 20
#: Links of a buffer, pairs of a block and runs of a merge.
RUN_LINKS = 2_000_000
BLOCK_PAIRS = 16_384
RUNS_A_MERGE = 64 << RADIX_BITS
BYTE_PIECE, PLAIN_BYTES = 6, (*range(33, 127), *range(161, 173), *range(174, 256))
DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
STAGED = DOC + ", shard long, place long, radix int, run binary"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the others from 256 on."""
    others = [b for b in range(256) if b not in PLAIN_BYTES]
    return {chr(b): b for b in PLAIN_BYTES} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteLevel:
    """A byte-level BPE model from its file; special tokens are plain text. ``exact``: its tokens give back the bytes of any text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        special = {token["content"] for token in model["added_tokens"]}
        letters = byte_letters()
        self.size = 1 + max([*model["model"]["vocab"].values(), *(token["id"] for token in model["added_tokens"])])
        self.bytes = [b""] * self.size
        for token, number in model["model"]["vocab"].items():
            if token not in special:
                self.bytes[number] = bytes(letters[letter] for letter in token)
        pairs = [tuple(pair.split(" ")) if isinstance(pair, str) else tuple(pair) for pair in model["model"]["merges"]]
        ordered = all(model["model"]["vocab"].get(a + b) == 256 + k for k, (a, b) in enumerate(pairs))
        steps = model["pre_tokenizer"]
        plain = steps["type"] == "ByteLevel" and not steps["add_prefix_space"] and steps.get("use_regex", True) and not model["normalizer"]
        if ordered and plain:  # ids are merge ranks: the faster library gives the same ids
            import public_tokenizers
            import tiktoken

            ranks = {token: number for number, token in enumerate(self.bytes) if token}
            self.coder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.ids = self.coder.encode_ordinary
            self.exact = True
        else:
            self.coder = Tokenizer.from_file(path)
            self.coder.encode_special_tokens = True
            self.ids = lambda text: self.coder.encode(text, add_special_tokens=False).ids
            self.exact = False


class Pieces:
    """A SentencePiece model from its file; it puts the blank in front by itself."""

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = library.get_piece_size()
        self.bytes = [bytes([int(library.id_to_piece(i)[3:5], 16)]) if library.is_byte(i)
                      else b"" if library.is_control(i) or library.is_unknown(i) else library.id_to_piece(i).replace("▁", " ").encode()
                      for i in range(self.size)]
        self.ids = lambda text: library.encode(text[1:])
        self.exact = False


class Aligner:
    """Links and groups of a text under two models."""

    def __init__(self, first: str, second: str):
        self.a, self.b = ByteLevel(first), Pieces(second)
        if (self.a.size * self.b.size) >> (64 - RADIX_BITS - PLACE_BITS):
            raise ValueError("the vocabularies are too large for packed pairs")
        self.sizes = [np.array([len(token) for token in side.bytes], np.int64) for side in (self.a, self.b)]
        #: An id as text with each of the three separators behind it.
        self.shown = {mark: np.array([f"{i}{mark}" for i in range(max(self.a.size, self.b.size))], object) for mark in ",|;"}

    def links(self, text: str) -> tuple[np.ndarray, int, int, int, str]:
        """Pairs (first id * size of the second vocabulary + second id) of all links in order, counts of tokens and groups, groups as text."""
        data = " " + text if text else ""
        rows = [side.ids(data) if data else [] for side in (self.a, self.b)]
        if not data or any(not side.exact and b"".join(map(side.bytes.__getitem__, row)) != data.encode() for side, row in zip((self.a, self.b), rows)):
            return np.empty(0, np.uint64), 0, 0, 0, ""
        a, b = (np.array(row, np.int64) for row in rows)
        ends_a, ends_b = self.sizes[0][a].cumsum(), self.sizes[1][b].cumsum()
        ends = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
        again = ends[1:] == ends[:-1]
        cuts, ends = ends[1:][again], ends[np.append(~again, True)]
        # Between two ends lies the overlap of just one token of each side.
        pairs = a[np.searchsorted(ends_a, ends)] * self.b.size + b[np.searchsorted(ends_b, ends)]
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        shown = np.empty(len(a) + len(b), object)
        last_a, last_b = np.diff(group_a, append=len(cuts)) > 0, np.diff(group_b, append=len(cuts)) > 0
        shown[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = np.where(last_a, self.shown["|"][a], self.shown[","][a])
        shown[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = np.where(last_b, self.shown[";"][b], self.shown[","][b])
        return pairs.astype(np.uint64), len(a), len(b), len(cuts), "".join(shown.tolist())[:-1]


@lru_cache(maxsize=2)
def aligner_of(first: str, second: str) -> Aligner:
    """The aligner of two models, one for each worker process."""
    return Aligner(first, second)


def _planes(numbers: np.ndarray) -> bytes:
    """Bytes of like weight together, which compress well."""
    return np.ascontiguousarray(numbers.astype("<u8" if numbers.dtype.itemsize > 4 else "<u4").view(np.uint8).reshape(len(numbers), -1).T).tobytes()


def _unplaned(data: bytes, count: int, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(-1, count).T).view(kind).reshape(count)


def write_run(pairs: np.ndarray, places: np.ndarray, links: np.ndarray) -> bytes:
    """A run from records in order of (pair, place): blocks of a head (pairs, documents of each) and a body (places, links of each record)."""
    pack = zstandard.ZstdCompressor(level=1).compress
    starts = np.flatnonzero(np.diff(pairs, prepend=pairs[:1] + np.uint64(1)))
    out = []
    for first in range(0, len(starts), BLOCK_PAIRS):
        own = starts[first:first + BLOCK_PAIRS]
        stop = int(starts[first + BLOCK_PAIRS]) if first + BLOCK_PAIRS < len(starts) else len(pairs)
        keys = pairs[own]
        head = pack(_planes(np.diff(keys, prepend=np.uint64(0))) + _planes(np.diff(own, append=stop).astype(np.uint32)))
        body = pack(_planes(places[own[0]:stop].astype(np.uint32)) + _planes(links[own[0]:stop].astype(np.uint32)))
        out += [struct.pack("<IIII", len(keys), stop - int(own[0]), len(head), len(body)), head, body]
    return b"".join(out)


def read_run(run: bytes, bodies: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks of a run: pairs, documents of each pair and, if wanted, places and links of each record."""
    unpack, at = zstandard.ZstdDecompressor().decompress, 0
    while at < len(run):
        pairs, records, head, body = struct.unpack_from("<IIII", run, at)
        at += 16
        data = unpack(run[at:at + head])
        block = (_unplaned(data[:8 * pairs], pairs, "<u8").cumsum(dtype=np.uint64), _unplaned(data[8 * pairs:], pairs, "<u4").astype(np.int64))
        if bodies:
            data = unpack(run[at + head:at + head + body])
            block += (_unplaned(data[:4 * records], records, "<u4"), _unplaned(data[4 * records:], records, "<u4"))
        yield block
        at += head + body


def merge_counts(runs: Iterable[Iterator[tuple[np.ndarray, ...]]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs in order with the sum of their counts over all runs; a block of each run is held, in a heap by its last pair."""
    heap = []

    def load(number: int, run: Iterator[tuple[np.ndarray, ...]]) -> None:
        block = next(run, None)
        if block is not None:
            heapq.heappush(heap, (int(block[0][-1]), number, block[0], block[1], run))

    for number, run in enumerate(runs):
        load(number, run)
    while heap:
        bound, parts, spent = heap[0][0], [], []
        while heap and heap[0][0] == bound:
            _, number, keys, counts, run = heapq.heappop(heap)
            parts.append((keys, counts))
            spent.append((number, run))
        for place, (last, number, keys, counts, run) in enumerate(heap):  # the order of last pairs stays
            cut = int(np.searchsorted(keys, np.uint64(bound), "right"))
            if cut:
                parts.append((keys[:cut], counts[:cut]))
                heap[place] = (last, number, keys[cut:], counts[cut:], run)
        keys, inverse = np.unique(np.concatenate([part[0] for part in parts]), return_inverse=True)
        yield keys, np.bincount(inverse, weights=np.concatenate([part[1] for part in parts])).astype(np.int64)
        for number, run in spent:
            load(number, run)


def aligned(docs: DataFrame, first: str, second: str) -> DataFrame:
    """The staged rows of documents, and the runs of their links, under one schema: a row with a radix is a run.

    (shard, place) is the row's name in the runs; a shard is what one buffer took.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, task = aligner_of(first, second), TaskContext.get().partitionId() << 32
        shard, place, buffer, held = 0, 0, [], 0

        def flush() -> pa.RecordBatch:
            records, links = np.unique(np.concatenate(buffer), return_counts=True)
            places = records & np.uint64((1 << PLACE_BITS) - 1)
            pairs = records >> np.uint64(PLACE_BITS) & np.uint64((1 << 64 - RADIX_BITS - PLACE_BITS) - 1)
            bounds = np.searchsorted(records, np.arange(1 << RADIX_BITS, dtype=np.uint64) << np.uint64(64 - RADIX_BITS))
            cuts = [*bounds.tolist(), len(records)]
            runs = [(radix, write_run(pairs[x:y], places[x:y], links[x:y])) for radix, (x, y) in enumerate(zip(cuts, cuts[1:])) if y > x]
            n = len(runs)
            empty = [pa.nulls(n, pa.int64())] * 5 + [pa.nulls(n, pa.string()), pa.array([task + shard] * n, pa.int64()), pa.nulls(n, pa.int64())]
            return pa.RecordBatch.from_arrays([*empty, pa.array([r for r, _ in runs], pa.int32()), pa.array([b for _, b in runs], pa.binary())], names=NAMES)

        for batch in common.pieces(batches):
            rows, names = [], []
            for text in common.text_of(batch):
                pairs, n_a, n_b, groups, shown = aligner.links(text)
                rows.append((n_a, n_b, groups, len(pairs), hashlib.sha256(shown.encode()).hexdigest() if n_a else ""))
                names.append((task + shard, place))
                if len(pairs):
                    radix = pairs // np.uint64(aligner.b.size) & np.uint64((1 << RADIX_BITS) - 1)
                    buffer.append(radix << np.uint64(64 - RADIX_BITS) | pairs << np.uint64(PLACE_BITS) | np.uint64(place))
                place, held = place + 1, held + len(pairs)
                if held >= RUN_LINKS or place >> PLACE_BITS:
                    if buffer:
                        yield flush()
                    shard, place, buffer, held = shard + 1, 0, [], 0
            columns = [pa.array([row[k] for row in rows], pa.string() if k == 4 else pa.int64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *columns, *[pa.array([name[k] for name in names], pa.int64()) for k in range(2)],
                 pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.binary())], names=NAMES)
        if buffer:
            yield flush()

    return common.staged(common.few_rows(docs).select("doc_id", "text").mapInArrow(run, STAGED), "alignments")


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "shard", "place", "radix", "run"]


def _runs(rows: DataFrame) -> DataFrame:
    return rows.where("radix IS NOT NULL").select("shard", "radix", "run")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of the runs that a task reads."""
    def merge(held: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        for radix, runs in held.items():
            for keys, counts in merge_counts(read_run(run, False) for run in runs):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), radix, np.int32)), pa.array(keys.view(np.int64)), pa.array(counts)],
                                                 names=["radix", "pair", "n"])

    held, count = {}, 0
    for batch in batches:
        for radix, run in zip(batch.column("radix").to_pylist(), batch.column("run").to_pylist()):
            held.setdefault(radix, []).append(run)
            count += 1
            if count >= RUNS_A_MERGE:
                yield from merge(held)
                held, count = {}, 0
    yield from merge(held)


def _totals(rows: DataFrame, second_size: int) -> DataFrame:
    """(radix, pair, n, best): documents that hold a pair linked, and whether no pair of its first id is in more."""
    counts = _runs(rows).select("radix", "run").mapInArrow(_merged, "radix int, pair long, n long").groupBy("radix", "pair").agg(F.sum("n").alias("n"))
    counts = common.staged(counts, "pairs").withColumn("a", F.expr(f"pair div {second_size}"))
    highest = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(highest, "a").select("radix", "pair", "n", (F.col("n") == F.col("most")).alias("best"))


def pair_counts(docs: DataFrame, first: str, second: str) -> DataFrame:
    """The crosswalk of two vocabularies: a, b, docs (documents that hold the two ids linked), best (no other b is in more with this a)."""
    size = Pieces(second).size
    return _totals(aligned(docs, first, second), size).select(
        F.expr(f"pair div {size}").alias("a"), F.expr(f"pair % {size}").alias("b"), F.col("n").alias("docs"), "best")


def _shares(folder: str):
    """Per document of the runs read: links whose pair is the best of its first id, and the sum of the counts of all links."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, inner = common.open_folder(folder)
        tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

        def table(radix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            if radix not in tables:
                found = store.get_file_info(pafs.FileSelector(f"{inner}/radix={radix}"))
                parts = [pq.read_table(info.path, filesystem=store, columns=["pair", "n", "best"], partitioning=None, use_threads=False) for info in found if info.path.endswith(".parquet")]
                rows = pa.concat_tables(parts)
                pairs = rows["pair"].to_numpy()
                order = np.argsort(pairs, kind="stable")
                tables[radix] = pairs[order].view(np.uint64), rows["n"].to_numpy()[order], rows["best"].to_numpy(zero_copy_only=False)[order]
            return tables[radix]

        def rows(shard: int, sums: np.ndarray) -> pa.RecordBatch:
            places = np.flatnonzero(sums[1])
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(places), shard)), pa.array(places), pa.array(sums[0][places]), pa.array(sums[1][places])],
                                              names=["shard", "place", "n_best", "count_sum"])

        current, sums = None, np.zeros((2, 0), np.int64)
        for batch in batches:
            for shard, radix, data in zip(*(batch.column(name).to_pylist() for name in ("shard", "radix", "run"))):
                if shard != current:
                    if current is not None:
                        yield rows(current, sums)
                    current, sums = shard, np.zeros((2, 0), np.int64)
                totals, counts, best = table(radix)
                for keys, documents, places, links in read_run(data, True):
                    found = np.searchsorted(totals, keys)
                    if int(places.max()) >= sums.shape[1]:
                        sums = np.pad(sums, ((0, 0), (0, int(places.max()) + 1 - sums.shape[1])))
                    spread = np.repeat(found, documents)
                    for k, share in enumerate((links * best[spread], links * counts[spread])):
                        np.add.at(sums[k], places, share.astype(np.int64))
        if current is not None:
            yield rows(current, sums)

    return run


def align(docs: DataFrame, first: str, second: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A null or empty text, and one whose bytes a model does not give back, has no tokens: zeros and an empty digest; it counts for no
    pair. Repeated rows are documents of their own, and a null id keeps its row. Of several pairs of an id with the highest count all
    are best. Other columns are not read; an empty table gives an empty one. Texts are whole, of any length.
    """
    rows = aligned(docs, first, second)
    folder = common.new_folder(docs.sparkSession, "totals")
    totals = _totals(rows, Pieces(second).size).repartition(1 << RADIX_BITS, "radix").sortWithinPartitions("radix", "pair")
    totals.write.partitionBy("radix").parquet(folder)
    shares = (_runs(rows).mapInArrow(_shares(folder), "shard long, place long, n_best long, count_sum long")
              .groupBy("shard", "place").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")))
    own = rows.where("radix IS NULL").drop("radix", "run")
    return own.join(shares, ["shard", "place"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")


def op13_alignment(spark: SparkSession, sf_dir: str, first: str | None = None, second: str | None = None) -> DataFrame:
    import public_tokenizers

    return align(common.table(spark, sf_dir, "documents"), first or public_tokenizers.path("byte_bpe_50k.json"),
                 second or public_tokenizers.path("piece_bpe_32k.model"))
