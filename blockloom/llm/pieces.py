"""SentencePiece encoding that maps every piece back to bytes of the original text, and decoding.

The model's compiled character map is a double-array trie over UTF-8 with a pool of replacements. At every position the
longest matching prefix is replaced and the place it came from is recorded, so that the boundary of any piece in the
normalised text has a byte offset in the original. The merges of the normalised text are the library's, run on the model without its
normaliser; byte lengths of the pieces, added up, give the boundaries that are looked up in that record.

``profile`` does all of it in one pass over a batch: ids, spans, the decoded text and their digests. A worker process keeps one codec.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from blockloom.llm import common

MARK = "▁"
MARK_BYTES = MARK.encode()
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
    T.StructField("begins", T.ArrayType(T.IntegerType(), False)), T.StructField("ends", T.ArrayType(T.IntegerType(), False))])


PROFILE = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long"


class CharacterMap:
    """Longest-prefix replacements of a compiled map: size of the trie in bytes, its 32-bit units, then the pool."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, dtype="<u4", count=size // 4, offset=4).tolist() if blob else []
        self.pool = blob[4 + size:] if blob else b""

    def __bool__(self) -> bool:
        return bool(self.units)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that starts at ``at`` and its replacement."""
        units, found = self.units, None
        node = _offset(units[0])
        for end in range(at, len(data)):
            node ^= data[end]
            if node >= len(units) or units[node] & 0x800000FF != data[end]:
                break
            unit = units[node]
            node ^= _offset(unit)
            if unit >> 8 & 1:
                found = end + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        start = found[1]
        return found[0], self.pool[start:self.pool.index(b"\0", start)]


def _offset(unit: int) -> int:
    return unit >> 10 << ((unit & 0x200) >> 6)


class Codec:
    """Normaliser and library merger of one model."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        spec = model.normalizer_spec
        self.prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        if not spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models with other word marks are not supported")
        if any(p.type == 4 for p in model.pieces):
            raise ValueError("models with user-defined pieces are not supported")
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces = b"", False, False
        self.merger = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        #: Without byte fallback the surface of an unknown piece is not the piece's name, so sizes come from surfaces.
        self.surfaces = not model.trainer_spec.byte_fallback
        self.sizes = np.array([1 if p.type == 6 else len(p.piece.encode()) for p in model.pieces], np.int32)
        self.names = [str(i) for i in range(len(model.pieces))]
        self.starts = {}

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text, and for each of its byte boundaries the byte offset in the original."""
        data = text.encode()
        if self.map:
            out, origin = self._mapped(data)
        else:
            out, origin = data, np.arange(len(data) + 1, dtype=np.int32)
        if self.squeeze:
            out, origin = _squeezed(out, origin)
        if not out:
            return "", origin[:1]
        repeats = np.where(np.frombuffer(out, np.uint8) == 0x20, 3, 1)
        spread = np.repeat(origin[:-1], repeats)
        head = [spread[:1]] * 3 if self.prefix else []
        result = out.replace(b" ", MARK_BYTES)
        return ((MARK_BYTES if self.prefix else b"") + result).decode(), np.concatenate([*head, spread, origin[-1:]])

    def _mapped(self, data: bytes) -> tuple[bytes, np.ndarray]:
        out, origin, at = bytearray(), [], 0
        while at < len(data):
            lead = data[at]
            size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            if lead < 0x80 and self.starts.get(lead) is False:
                hit = None
            else:
                hit = self.map.longest(data, at)
                if lead < 0x80 and lead not in self.starts:
                    node = _offset(self.map.units[0]) ^ lead
                    self.starts[lead] = node < len(self.map.units) and self.map.units[node] & 0x800000FF == lead
            size, piece = hit if hit else (size, data[at:at + size])
            if hit:
                origin += [at] * len(piece)
            else:
                origin += range(at, at + size)
            out += piece
            at += size
        return bytes(out), np.array([*origin, len(data)], dtype=np.int32)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids with the first and the end byte of each piece in the original text."""
        normal, origin = self.normalise(text)
        ids = np.array(self.merger.encode(normal), np.int32)
        if self.surfaces:
            sizes = np.array([len(piece.encode()) for piece in self.merger.encode(normal, out_type=str)], np.int32)
        else:
            sizes = self.sizes[ids]
        bounds = origin[np.concatenate([[0], np.cumsum(sizes)])]
        return ids, bounds[:-1], bounds[1:]

    def profile(self, text: str) -> tuple[int, str, str, int]:
        """Number of ids, digests of the ids and of the decoded text, and the number of bytes of the original under the spans."""
        ids, begins, ends = self.encode(text)
        row = ids.tolist()
        shown, decoded = ",".join(map(self.names.__getitem__, row)), self.library.decode(row) if row else ""
        return (len(row), hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(),
                int(ends[-1] - begins[0]) if row else 0)


@lru_cache(maxsize=2)
def codec_of(path: str) -> Codec:
    """The codec of a model, one for each worker process."""
    return Codec(path)


def _squeezed(data: bytes, origin: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Without leading and trailing blanks, runs of blanks as one."""
    blank = np.frombuffer(data, np.uint8) == 0x20
    keep = ~(blank & np.concatenate([[True], blank[:-1]]))
    last = np.flatnonzero(~blank)
    stop = int(last[-1]) + 1 if len(last) else 0
    keep[stop:] = False
    kept = np.flatnonzero(keep)
    end = origin[stop:stop + 1] if stop else origin[:1]
    return np.frombuffer(data, np.uint8)[kept].tobytes(), np.concatenate([origin[kept], end])


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """Ids of every whole text with the byte span of each piece in the original: doc_id, ids, begins, ends.

    The ids are those of the library without begin or end marks and without sampling. A null or empty text has empty
    lists, repeated rows stay, other columns of ``docs`` are not read, and an empty table gives an empty one. Pieces of a byte
    fallback cover their own byte; the word mark put in front of a text covers nothing. There is no shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model_path)
        for batch in common.pieces(batches):
            coded = [codec.encode(text) for text in common.text_of(batch)]
            offsets = pa.array(np.cumsum([0, *[len(row[0]) for row in coded]]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([row[k] for row in coded]), pa.int32())) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *lists], names=SCHEMA.fieldNames())

    return common.few_rows(docs).select("doc_id", "text").mapInArrow(run, SCHEMA)


def decode(encoded: DataFrame, model_path: str, column: str = "decoded") -> DataFrame:
    """Adds the text that the library decodes the ids to."""
    @F.arrow_udf("string")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        for ids in batches:
            out = []
            for start in range(0, len(ids), 128):  # the ids of few rows at a time as Python numbers
                out += [library.decode(row) if row else "" for row in ids.slice(start, 128).to_pylist()]
            yield pa.array(out, pa.string())

    return common.few_rows(encoded).withColumn(column, decoded("ids"))


def digests(encoded: DataFrame, model_path: str) -> DataFrame:
    """Count and digests of ids and decoded text per document."""
    return decode(encoded, model_path, "decoded").select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def profile(docs: DataFrame, model_path: str) -> DataFrame:
    """Encodes and decodes every whole text in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes under the pieces' spans.

    The same as ``digests(encode(...))`` without ids or texts between the JVM and Python. Rows behave as in ``encode``: a null or empty text
    has no tokens and the digests of the empty text, repeated rows stay, other columns are not read, an empty table gives an empty one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model_path)
        for batch in common.pieces(batches):
            rows = [codec.profile(text) for text in common.text_of(batch)]
            counts, ids, decoded, covered = zip(*rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(ids), pa.array(decoded),
                                              pa.array(covered, pa.int64())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"])

    return common.few_rows(docs).select("doc_id", "text").mapInArrow(run, PROFILE)


def op4_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    return profile(common.table(spark, sf_dir, "documents"), model_path or default_model())


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
