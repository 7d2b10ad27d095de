"""Encoding equals the library, spans lie on the original bytes, and a compiled character map is followed."""

import hashlib
import random

import pytest
import sentencepiece

from blockloom.llm import pieces
from tests.llm.helpers import ROWS, clashing, documents

MODEL = pieces.default_model()
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_ids_and_round_trip(spark):
    docs = documents(spark)
    got = pieces.encode(clashing(docs), MODEL).collect()
    assert len(got) == len(ROWS)
    texts = sorted(LIBRARY.encode(row[1] or "") for row in ROWS)
    assert sorted(list(row["ids"]) for row in got) == texts
    for row in pieces.digests(pieces.encode(docs, MODEL), MODEL).collect():
        text = next(r[1] or "" for r in ROWS if r[0] == row["doc_id"])
        ids = LIBRARY.encode(text)
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()


def test_empty_table(spark):
    assert pieces.digests(pieces.encode(documents(spark, []), MODEL), MODEL).count() == 0


def test_random_texts_and_spans():
    codec, draw = pieces.Codec(MODEL), random.Random(5)
    for _ in range(400):
        text = "".join(draw.choice(["a", "th", " ", "  ", "\n", "é", "日", "😀", "▁", "<s>", "."]) for _ in range(draw.randint(0, 60)))
        ids, begins, ends = codec.encode(text)
        assert ids.tolist() == LIBRARY.encode(text)
        data = text.encode()
        assert list(begins[1:]) == list(ends[:-1]) and (not len(ids) or (begins[0], ends[-1]) == (0, len(data)))
        for i, a, b in zip(ids.tolist(), begins, ends):
            piece = LIBRARY.id_to_piece(i)
            if not LIBRARY.is_byte(i):
                assert data[a:b].decode().replace(" ", "▁") in (piece, piece[1:] if a == 0 else piece)
            else:
                assert data[a:b] == bytes([int(piece[3:5], 16)])


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_compiled_character_map(rule):
    """The normaliser follows a compiled map as the library does, with leading, trailing and repeated blanks removed."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    spec = proto.ModelProto()
    spec.ParseFromString(library.serialized_model_proto())
    codec = pieces.Codec(MODEL)
    codec.map = pieces.CharacterMap(spec.normalizer_spec.precompiled_charsmap)
    assert codec.map
    codec.prefix, codec.squeeze = False, True
    reference = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=False, escape_whitespaces=True, remove_extra_whitespaces=True)
    for text in ["ＡＢＣ　ｄ", "  ﬁne ½ ①", "Ａ\tb\u200b", "한글 ｶﾞ", "plain", "", "x  y ", "e\u0301"]:
        normal, origin = codec.normalise(text)
        assert normal == reference.normalize(text), text
        assert len(origin) == len(normal.encode()) + 1 and all(a <= b for a, b in zip(origin, origin[1:]))


def test_one_pass_equals_the_library(spark):
    docs = documents(spark)
    got = pieces.profile(clashing(docs), MODEL).collect()
    assert len(got) == len(ROWS)
    for row in got:
        text = next(r[1] or "" for r in ROWS if r[0] == row["doc_id"])
        ids = LIBRARY.encode(text)
        assert (row["n_tokens"], row["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert row["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()
        assert row["n_bytes"] == len(text.encode())
    assert pieces.profile(documents(spark, []), MODEL).count() == 0


def test_random_digests():
    codec, draw = pieces.Codec(MODEL), random.Random(8)
    for _ in range(600):
        text = "".join(draw.choice(["a", "th", " ", "  ", "\n", "é", "日", "😀", "▁", "<s>", ".", "<0x41>", "\u0000", "<unk>"]) for _ in range(draw.randint(0, 30)))
        count, ids, decoded, covered = codec.profile(text)
        want = LIBRARY.encode(text)
        assert count == len(want) and covered == len(text.encode())
        assert ids == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert decoded == hashlib.sha256(LIBRARY.decode(want).encode()).hexdigest(), text


def test_unknown_pieces_of_a_model_without_byte_fallback(tmp_path):
    """A model without byte fallback gives unknown pieces the bytes of their surface."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(MODEL, "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.byte_fallback = False
    kept = [piece for piece in model.pieces if piece.type != 6]
    del model.pieces[:]
    model.pieces.extend(kept)
    path = tmp_path / "plain.model"
    path.write_bytes(model.SerializeToString())
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    codec = pieces.Codec(str(path))
    for text in ["日𓀀 the 𓀀𓀀 end", "𓀀", "x 𓀀", ""]:
        ids, begins, ends = codec.encode(text)
        assert ids.tolist() == library.encode(text)
        assert list(begins[1:]) == list(ends[:-1]) and (not len(ids) or ends[-1] == len(text.encode()))
        assert codec.profile(text)[2] == hashlib.sha256(library.decode(ids.tolist()).encode()).hexdigest()
