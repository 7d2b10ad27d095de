"""Alignment of two tokenizers against a plain version that holds all links."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from blockloom.llm import crosswalk
from tests.llm.helpers import ROWS, clashing, documents

FIRST, SECOND = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A = Tokenizer.from_file(FIRST)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=SECOND)
LETTERS = crosswalk.byte_letters()


def spans(text):
    """(id, first byte, end byte) of the tokens of both sides, or None without tokens."""
    if not text:
        return None
    data, out = (" " + text).encode(), []
    for rows in ([(i, bytes(LETTERS[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids],
                 [(i, bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode()) for i in B.encode(text)]):
        if b"".join(piece for _, piece in rows) != data:
            return None
        at, side = 0, []
        for number, piece in rows:
            side.append((number, at, at + len(piece)))
            at += len(piece)
        out.append(side)
    return out


def plain(rows):
    """The contract word for word: all pairs of token occurrences are compared within a document."""
    links, shown = [], []
    for _, text, *_ in rows:
        both = spans(text)
        if both is None:
            links.append([])
            shown.append((0, 0, 0, ""))
            continue
        a, b = both
        links.append([(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]])
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        groups = ";".join(",".join(str(x[0]) for x in a if low < x[2] <= high) + "|" + ",".join(str(y[0]) for y in b if low < y[2] <= high)
                          for low, high in zip([0, *cuts], cuts))
        shown.append((len(a), len(b), len(cuts), hashlib.sha256(groups.encode()).hexdigest()))
    count = Counter(pair for row in links for pair in set(row))
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    return sorted((str(row[0]), n_a, n_b, groups, len(own), sum(count[p] == most[p[0]] for p in own), sum(count[p] for p in own), digest)
                  for row, own, (n_a, n_b, groups, digest) in zip(rows, links, shown)), count


def result(df):
    return sorted((str(r["doc_id"]), r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in df.collect())


SMALL = [row if row[1] is None or len(row[1]) < 5000 else (row[0], row[1][:3000], *row[2:]) for row in ROWS]


def random_rows(draw, count):
    parts = ["the", " quick", "  ", "\n", "é", "日本", "😀", "<|endoftext|>", "</s>", "<0x0A>", "\t", "running", " 1234", "'s", "—", "\u0000", "naïve", " unbelievable", "\r\n"]
    return [(i, "".join(draw.choice(parts) for _ in range(draw.randint(0, 40))), "en", "a", 0) for i in range(count)]


def test_equals_the_plain_version(spark):
    rows = SMALL + [(100 + i, text, *rest) for i, text, *rest in random_rows(random.Random(3), 120)]
    want, count = plain(rows)
    assert result(crosswalk.align(clashing(documents(spark, rows)).repartition(5), FIRST, SECOND)) == want
    table = {(r["a"], r["b"]): r["docs"] for r in crosswalk.pair_counts(documents(spark, rows), FIRST, SECOND).collect()}
    assert table == dict(count)


def test_many_small_runs(spark, monkeypatch):
    """A run of blocks of a few pairs reads back as written, and many tasks with a run each give the plain result."""
    rows = random_rows(random.Random(4), 60)
    monkeypatch.setattr(crosswalk, "BLOCK_PAIRS", 3)
    pairs = np.sort(np.random.default_rng(1).integers(0, 1 << 30, 500).astype(np.uint64))
    places = np.arange(500, dtype=np.uint64) % 7
    order = np.lexsort((places, pairs))
    run = crosswalk.write_run(pairs[order], places[order], places[order] + np.uint64(1))
    keys = np.concatenate([block[0] for block in crosswalk.read_run(run, True)])
    again = np.concatenate([np.repeat(block[0], block[1]) for block in crosswalk.read_run(run, False)])
    assert (np.unique(pairs) == keys).all() and (again == pairs).all()
    assert (np.concatenate([block[2] for block in crosswalk.read_run(run, True)]) == places[order]).all()
    assert result(crosswalk.align(documents(spark, rows).repartition(16), FIRST, SECOND)) == plain(rows)[0]


def test_merge_of_runs():
    draw = random.Random(6)
    for _ in range(50):
        want, runs = Counter(), []
        for _ in range(draw.randint(0, 7)):
            row = Counter(draw.choices(range(40), k=draw.randint(1, 60)))
            want.update(row)
            keys = np.array(sorted(row), np.uint64)
            step = draw.randint(1, 9)
            runs.append(iter([(keys[i:i + step], np.array([row[int(k)] for k in keys[i:i + step]])) for i in range(0, len(keys), step)]))
        got = [(int(k), int(n)) for keys, counts in crosswalk.merge_counts(runs) for k, n in zip(keys, counts)]
        assert got == sorted(want.items())


def test_ids_are_those_of_the_given_library():
    aligner, draw = crosswalk.Aligner(FIRST, SECOND), random.Random(9)
    for _, text, *_ in random_rows(draw, 400):
        assert aligner.a.ids(" " + text) == A.encode(" " + text, add_special_tokens=False).ids
    for text in ("x" * 20_000, " " * 30_000, "\n" * 30_000 + "a", "é" * 5_000):
        assert aligner.a.ids(" " + text) == A.encode(" " + text, add_special_tokens=False).ids


def test_empty_table(spark):
    assert crosswalk.align(documents(spark, []), FIRST, SECOND).collect() == []
    assert result(crosswalk.align(documents(spark, [(1, None, "en", "a", 0)]), FIRST, SECOND)) == [("1", 0, 0, 0, 0, 0, 0, "")]
