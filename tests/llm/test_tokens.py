"""Counts after edits equal a full encoding of the edited text."""

import random

import public_tokenizers
from pyspark.sql import functions as F

from blockloom.llm import tokens
from tests.llm.helpers import LONG, ROWS, clashing, documents

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
COUNTER = tokens.Counter(RANKS, public_tokenizers.PATTERN)


def full(text):
    return len(COUNTER.encoding.encode_ordinary(text))


def test_random_edits_equal_a_full_encoding():
    draw = random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", " \n ", "'s", "'", "l", "1", "9", ".", "!?", "é", "日", "\t", "ve", "\u0000"]
    for _ in range(3000):
        document = tokens.Document("".join(draw.choice(parts) for _ in range(draw.randint(0, 200))), COUNTER)
        for _ in range(draw.randint(1, 5)):
            size = len(document.text)
            start = draw.randint(-2, size + 2)
            document.edit(start, start + draw.choice([-1, 0, 1, 3, 40]), "".join(draw.choice(parts) for _ in range(draw.choice([0, 1, 2, 300]))))
            found = COUNTER.cut.findall(document.text)
            assert [size for sizes, _ in document.tree.blocks for size in sizes] == [len(piece) for piece in found]
            assert document.tree.total == full(document.text) and document.tree.chars[1] == len(document.text)


def test_an_edit_encodes_little():
    document = tokens.Document(LONG, COUNTER)
    document.edit(len(LONG) // 2, len(LONG) // 2 + 5, "xy z")
    assert document.encoded <= 10 and document.tree.total == full(document.text)


def test_query_columns(spark):
    docs = clashing(documents(spark))
    revised = docs.select("doc_id", "text", tokens.revision(F.col("text"), F.col("lang")).alias("edits"))
    got = tokens.count(revised, RANKS, public_tokenizers.PATTERN).collect()
    assert len(got) == len(ROWS)
    for row in got:
        text = next(r for r in ROWS if r[0] == row["doc_id"])
        assert row["tokens_before"] == full(text[1] or "") and row["n_edits"] == 3


def test_edit_table(spark):
    docs = documents(spark)
    edits = spark.createDataFrame([(1, 2, 0, 3, "A"), (1, 1, 4, 4, None), (5, 1, 0, 0, "Oh, "), (99, 1, 0, 1, "x"), (2, 1, 0, 9, "new"), (3, 1, None, 9, "new")],
                                  "doc_id long, seq int, start int, stop int, insert string")
    got = {r["doc_id"]: r for r in tokens.count(tokens.with_edits(docs, edits), RANKS, public_tokenizers.PATTERN).collect()}
    text = ROWS[0][1]
    assert got[1]["tokens_after"] == full("A" + text[3:]) and got[5]["tokens_after"] == full("Oh, " + text)
    assert got[2]["tokens_after"] == full("new") and got[3]["tokens_after"] == 0 and got[7]["n_edits"] == 0
    assert tokens.count(tokens.with_edits(documents(spark, []), edits), RANKS, public_tokenizers.PATTERN).count() == 0


def test_stored_trees_take_edit_batches(spark, tmp_path, monkeypatch):
    """Two batches of edits on stored trees: counts equal full encodings, a batch writes the documents it names, and nothing else is encoded."""
    docs = documents(spark, [row for row in ROWS if row[0] != 5])
    orchard = tokens.Orchard(spark, str(tmp_path / "trees"), RANKS, public_tokenizers.PATTERN)
    orchard.plant(docs)
    schema = "doc_id long, seq int, start int, stop int, insert string"
    texts = {row[0]: row[1] or "" for row in ROWS if row[0] not in (5, None)}
    batches = ([(1, 1, 0, 3, "A"), (7, 1, 9, 12, " x "), (99, 1, 0, 1, "x")], [(7, 2, 0, 5, ""), (7, 1, 100, 100, "!!"), (2, 1, 0, 0, "new text")])
    for number, batch in enumerate(batches, 1):
        for doc_id, _, start, stop, insert in sorted(batch):
            if doc_id in texts:
                texts[doc_id] = texts[doc_id][:start] + insert + texts[doc_id][stop:]
        got = orchard.apply(spark.createDataFrame(batch, schema)).collect()
        assert {r["doc_id"]: r["tokens_after"] for r in got} == {d: full(texts[d]) for d in {row[0] for row in batch} & texts.keys()}
        assert sum(r["n_reencoded"] for r in got) < 40
        assert {r["doc_id"] for r in spark.read.parquet(str(tmp_path / f"trees/version={number}")).collect()} == {row[0] for row in batch} & texts.keys()
        trees = {r["doc_id"]: r["n_tokens"] for r in orchard.trees().collect()}
        assert trees == {d: full(text) for d, text in texts.items()}


def test_packed_documents_come_back():
    import zstandard

    draw = random.Random(4)
    for text in ("", "a", LONG, "".join(draw.choice("ab \n日😀's") for _ in range(3000))):
        document = tokens.Document(text, COUNTER)
        again = tokens.Document.unpacked(*document.packed(zstandard.ZstdCompressor()), COUNTER, zstandard.ZstdDecompressor())
        assert again.text == text and again.tree.total == full(text) and again.tree.leaves == document.tree.leaves and again.encoded == 0
