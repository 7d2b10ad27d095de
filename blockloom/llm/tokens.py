"""Edit-aware token counts.

A document's pre-tokens are the leaves of a segment tree whose nodes hold the characters and the tokens below them. An
edit finds its leaves by going down the character sums; from a few leaves before it the text is cut anew until a new
cut falls on an old one behind the edit, and only these pre-tokens are encoded. Their leaves are replaced and the sums above
are updated; everything else keeps its counts.

Trees outlive the task: ``plant`` encodes documents once and keeps text and leaves of each, packed, as rows of a stored table; ``count`` applies a
batch of edits to stored trees, which are built from their leaves without encoding; ``Orchard`` keeps versions of such a table, in which an edit batch
writes the documents that it changes and no others.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from blockloom.llm import common

#: A leaf of the tree is a block of consecutive pre-tokens, so that inserted pre-tokens seldom change the tree's shape.
BLOCK = 32
KEPT = 300_000
EDITS = "array<struct<start:int,stop:int,insert:string>>"
COUNTS = "doc_id long, tokens_before long, tokens_after long, n_pretokens long, n_reencoded long, n_edits long"
#: A stored tree: the text and, leaf by leaf, characters and tokens, both packed.
TREES = "doc_id long, body binary, leaves binary, n_tokens long, n_pretokens long"


class Counter:
    """Tokens of a pre-token, kept for pre-tokens seen before."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.cut = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def counts(self, found: list[str]) -> list[int]:
        known = self.known
        if len(known) > KEPT:
            known.clear()
        for piece in found:
            if piece not in known:
                known[piece] = len(self.encoding.encode_ordinary(piece))
        return [known[piece] for piece in found]


class Tree:
    """Blocks of (characters, tokens) leaves under a complete binary tree of sums."""

    def __init__(self, sizes: list[int], tokens: list[int]):
        self.blocks = [(sizes[i:i + BLOCK], tokens[i:i + BLOCK]) for i in range(0, len(sizes), BLOCK)] or [([], [])]
        self._build()

    def _build(self) -> None:
        self.width = 1 << (len(self.blocks) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, (sizes, tokens) in enumerate(self.blocks):
            self.chars[self.width + i], self.tokens[self.width + i] = sum(sizes), sum(tokens)
        for node in range(self.width - 1, 0, -1):
            self._add_up(node)

    def _add_up(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def leaves(self) -> int:
        return sum(len(sizes) for sizes, _ in self.blocks)

    def locate(self, at: int) -> tuple[int, int, int]:
        """(block, place in it, first character) of the leaf that holds character ``at``; the last leaf if it is behind the text."""
        at, node, start = max(0, min(at, self.chars[1] - 1)), 1, 0
        while node < self.width:
            node *= 2
            if at >= start + self.chars[node]:
                start += self.chars[node]
                node += 1
        block = min(node - self.width, len(self.blocks) - 1)
        for place, size in enumerate(self.blocks[block][0]):
            if at < start + size:
                return block, place, start
            start += size
        return block, max(0, len(self.blocks[block][0]) - 1), start

    def before(self, block: int, place: int) -> tuple[int, int]:
        if place:
            return block, place - 1
        while block and not self.blocks[block - 1][0]:
            block -= 1
        return (block - 1, len(self.blocks[block - 1][0]) - 1) if block else (0, 0)

    def ends_from(self, block: int, place: int, start: int) -> Iterator[tuple[int, int, int]]:
        """(block, place behind it, end character) of each leaf from a place on."""
        while block < len(self.blocks):
            sizes = self.blocks[block][0]
            for i in range(place, len(sizes)):
                start += sizes[i]
                yield block, i + 1, start
            block, place = block + 1, 0

    def replace(self, first: tuple[int, int], last: tuple[int, int], sizes: list[int], tokens: list[int]) -> None:
        """Put new leaves for those from ``first`` up to (not with) ``last`` and update the sums above."""
        (a, i), (b, j) = first, last
        own_sizes = self.blocks[a][0][:i] + sizes + self.blocks[b][0][j:]
        own_tokens = self.blocks[a][1][:i] + tokens + self.blocks[b][1][j:]
        if len(own_sizes) > 4 * BLOCK or b - a > 64:  # the shape changes: blocks are cut anew here
            self.blocks[a:b + 1] = [(own_sizes[k:k + BLOCK], own_tokens[k:k + BLOCK]) for k in range(0, len(own_sizes), BLOCK)] or [([], [])]
            self._build()
            return
        self.blocks[a] = own_sizes, own_tokens
        for block in range(a + 1, b + 1):
            self.blocks[block] = [], []
        for block in range(a, b + 1):
            node = self.width + block
            self.chars[node], self.tokens[node] = sum(self.blocks[block][0]), sum(self.blocks[block][1])
            while node > 1:
                node //= 2
                self._add_up(node)


class Document:
    """Text and tree of one document; the tree is encoded, or built from stored leaves."""

    def __init__(self, text: str, counter: Counter, leaves: tuple[list[int], list[int]] | None = None):
        self.text, self.counter = text, counter
        if leaves is None:
            found = counter.cut.findall(text)
            leaves = [len(piece) for piece in found], counter.counts(found)
        self.tree = Tree(*leaves)
        self.encoded = 0

    def packed(self, pack: zstandard.ZstdCompressor) -> tuple[bytes, bytes]:
        """Text and leaves as stored: characters, then tokens, low bytes first."""
        numbers = np.array([n for k in (0, 1) for block in self.tree.blocks for n in block[k]], "<u4")
        planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 4).T).tobytes()
        return pack.compress(self.text.encode()), pack.compress(planes)

    @classmethod
    def unpacked(cls, body: bytes, leaves: bytes, counter: Counter, unpack: zstandard.ZstdDecompressor) -> Document:
        planes = np.frombuffer(unpack.decompress(leaves), np.uint8).reshape(4, -1)
        numbers = np.ascontiguousarray(planes.T).view("<u4").reshape(2, -1)
        return cls(unpack.decompress(body).decode(), counter, (numbers[0].tolist(), numbers[1].tolist()))

    def edit(self, start: int, stop: int, insert: str) -> None:
        """Replace the characters from ``start`` to ``stop`` (both brought inside the text) by ``insert``."""
        start = max(0, min(start, len(self.text)))
        stop = max(start, min(stop, len(self.text)))
        old_size, shift = len(self.text), len(insert) - (stop - start)
        self.text = self.text[:start] + insert + self.text[stop:]
        tree = self.tree
        if not old_size:
            found = self.counter.cut.findall(self.text)
            self.tree = Tree([len(piece) for piece in found], self.counter.counts(found))
            self.encoded += len(found)
            return
        # A cut depends on at most one character behind the pre-token that it ends, so cuts that end two characters before the edit stay.
        block, place, begin = tree.locate(start - 2)
        earlier = tree.before(block, place)
        if earlier != (block, place):
            block, place = earlier
            begin -= tree.blocks[block][0][place]
        olds = tree.ends_from(block, place, begin)
        old = next(olds, None)
        found, at, last = [], begin, None
        for match in self.counter.cut.finditer(self.text, begin):
            found.append(match.group())
            at = match.end()
            while old and old[2] + shift < at:
                old = next(olds, None)
            # Behind the edit, a cut at an old place is followed by the old cuts, as cutting only looks ahead.
            if old and old[2] + shift == at and old[2] >= stop and at >= start + len(insert):
                last = old[0], old[1]
                break
        if last is None:
            last = len(tree.blocks) - 1, len(tree.blocks[-1][0])
        tree.replace((block, place), last, [len(piece) for piece in found], self.counter.counts(found))
        self.encoded += len(found)


@lru_cache(maxsize=2)
def counter_of(ranks_path: str, pattern: str) -> Counter:
    """The counter of a vocabulary, one for each worker process."""
    return Counter(ranks_path, pattern)


def _stored(documents: list[Document], pack: zstandard.ZstdCompressor) -> list[pa.Array]:
    packed = [document.packed(pack) for document in documents]
    return [pa.array([p[0] for p in packed], pa.binary()), pa.array([p[1] for p in packed], pa.binary()),
            pa.array([d.tree.total for d in documents], pa.int64()), pa.array([d.tree.leaves for d in documents], pa.int64())]


def plant(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """The trees of all documents, to be stored: doc_id, body, leaves, n_tokens, n_pretokens.

    A null text is empty, repeated rows stay, other columns are not read, an empty table gives an empty one. No shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, pack = counter_of(ranks_path, pattern), zstandard.ZstdCompressor(level=1)
        for batch in common.pieces(batches):
            documents = [Document(text, counter) for text in common.text_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *_stored(documents, pack)],
                                             names=["doc_id", "body", "leaves", "n_tokens", "n_pretokens"])

    return common.few_rows(docs).select("doc_id", "text").mapInArrow(run, TREES)


def _grown(batch: pa.RecordBatch, counter: Counter, unpack: zstandard.ZstdDecompressor) -> Iterator[tuple[Document, int, int]]:
    """(document after its edits, tokens before, number of edits) of rows of stored trees with edits."""
    for body, leaves, changes in zip(*(batch.column(name).to_pylist() for name in ("body", "leaves", "edits"))):
        document = Document.unpacked(body, leaves, counter, unpack)
        before = document.tree.total
        changes = [c for c in changes or [] if c and c["start"] is not None and c["stop"] is not None]
        for c in changes:
            document.edit(c["start"], c["stop"], c["insert"] or "")
        yield document, before, len(changes)


def edited(trees: DataFrame, ranks_path: str, pattern: str, edits: str = "edits") -> DataFrame:
    """Stored trees after the edits in a column of theirs, in the form of ``plant``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, pack, unpack = counter_of(ranks_path, pattern), zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        for batch in common.pieces(batches):
            documents = [document for document, _, _ in _grown(batch, counter, unpack)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_stored(documents, pack)], names=["doc_id", "body", "leaves", "n_tokens", "n_pretokens"])

    return common.few_rows(trees).select("doc_id", "body", "leaves", F.col(edits).cast(EDITS).alias("edits")).mapInArrow(run, TREES)


def counted(trees: DataFrame, ranks_path: str, pattern: str, edits: str = "edits") -> DataFrame:
    """Token counts before and after the edits of stored trees: doc_id, tokens_before, tokens_after, n_pretokens (after),
    n_reencoded (pre-tokens encoded because of edits) and n_edits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, unpack = counter_of(ranks_path, pattern), zstandard.ZstdDecompressor()
        for batch in common.pieces(batches):
            rows = [(before, document.tree.total, document.tree.leaves, document.encoded, number) for document, before, number in _grown(batch, counter, unpack)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([row[k] for row in rows], pa.int64()) for k in range(5)]],
                                             names=["doc_id", "tokens_before", "tokens_after", "n_pretokens", "n_reencoded", "n_edits"])

    return common.few_rows(trees).select("doc_id", "body", "leaves", F.col(edits).cast(EDITS).alias("edits")).mapInArrow(run, COUNTS)


def count(docs: DataFrame, ranks_path: str, pattern: str, edits: str = "edits") -> DataFrame:
    """``counted`` for documents with a column of edits: trees are planted, stored with the edits, and read back for them.

    ``edits`` names a column of (start, stop, insert) in code points; they are applied in order, each to the text that the ones before
    have left, with places outside brought inside. A null text is empty, null edits or inserts are none; repeated rows
    stay, each with its own edits; other columns are not read; an empty table gives an empty one. No shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, pack = counter_of(ranks_path, pattern), zstandard.ZstdCompressor(level=1)
        for batch in common.pieces(batches):
            documents = [Document(text, counter) for text in common.text_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *_stored(documents, pack), batch.column("edits")],
                                             names=["doc_id", "body", "leaves", "n_tokens", "n_pretokens", "edits"])

    rows = common.few_rows(docs).select("doc_id", "text", F.col(edits).cast(EDITS).alias("edits"))
    return counted(common.staged(rows.mapInArrow(run, f"{TREES}, edits {EDITS}"), "trees"), ranks_path, pattern)


class Orchard:
    """Versions of stored trees under a folder: the first holds all documents, each later one those that an edit batch has changed.

    A document is named by its doc_id, which has to be unique here; rows without one are not kept. A version counts once its folder is complete.
    """

    def __init__(self, spark: SparkSession, folder: str, ranks_path: str, pattern: str):
        self.spark, self.folder, self.ranks_path, self.pattern = spark, folder.rstrip("/"), ranks_path, pattern
        self.versions = 0

    def _version(self, number: int) -> DataFrame:
        return self.spark.read.schema(TREES).parquet(f"{self.folder}/version={number}")

    def plant(self, docs: DataFrame) -> None:
        plant(docs.where("doc_id IS NOT NULL"), self.ranks_path, self.pattern).write.parquet(f"{self.folder}/version=0")
        self.versions = 1

    def trees(self) -> DataFrame:
        """The newest tree of every document."""
        out = self._version(0)
        for number in range(1, self.versions):
            newer = self._version(number)
            out = out.join(newer.select("doc_id"), "doc_id", "left_anti").unionByName(newer)
        return out

    def apply(self, edits: DataFrame) -> DataFrame:
        """Apply an edit table (doc_id, seq, start, stop, insert) and return the counts of the documents it names; only these are read into tasks and written."""
        touched = common.staged(self.trees().join(_gathered(edits), "doc_id"), "touched")
        edited(touched, self.ranks_path, self.pattern).write.parquet(f"{self.folder}/version={self.versions}")
        self.versions += 1
        return counted(touched, self.ranks_path, self.pattern)


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """doc_id, text, edits: the rows of an edit table (doc_id, seq, start, stop, insert) gathered by document in the order of seq."""
    return docs.select("doc_id", "text").join(_gathered(edits), "doc_id", "left")


def _gathered(edits: DataFrame) -> DataFrame:
    change = F.struct(F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"), F.col("insert"))
    return edits.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", change.alias("change")))), lambda e: e["change"]).alias("edits"))


def revision(text: Column, lang: Column) -> Column:
    """The edits of the query: five characters go at a quarter, the language's name comes in at the half, seven become capitals at three quarters."""
    size = F.coalesce(F.length(text), F.lit(0))

    def at(share: float) -> Column:
        return F.floor(size * share).cast("int")

    return F.array(
        F.struct(at(0.25).alias("start"), (at(0.25) + 5).alias("stop"), F.lit("").alias("insert")),
        F.struct(at(0.5).alias("start"), at(0.5).alias("stop"), F.concat(F.lit(" "), F.coalesce(lang, F.lit(""))).alias("insert")),
        F.struct(at(0.75).alias("start"), (at(0.75) + 7).alias("stop"), F.upper(F.substring(F.coalesce(text, F.lit("")), at(0.75) + 1, F.lit(7))).alias("insert")))


def op8_token_counts(spark: SparkSession, sf_dir: str, ranks_path: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents")
    revised = docs.select("doc_id", "text", revision(F.col("text"), F.col("lang")).alias("edits"))
    return count(revised, ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
