"""Removal of repeated passages against a plain comparison of all windows."""

import hashlib
import random

import numpy as np

from blockloom.llm import repeats
from tests.llm.helpers import ROWS, clashing, documents


def plain(rows, length):
    """The contract word for word: a window's word sequence starts in a document with a smaller id."""
    starts = {}
    for number, text, *_ in rows:
        words = (text or "").encode().split()
        for i in range(len(words) - length + 1):
            if number is not None:
                window = tuple(words[i:i + length])
                starts[window] = min(number, starts.get(window, number))
    out = []
    for number, text, *_ in rows:
        words = (text or "").encode().split()
        gone = set()
        for i in range(len(words) - length + 1):
            if number is not None and starts[tuple(words[i:i + length])] < number:
                gone.update(range(i, i + length))
        kept = b" ".join(word for i, word in enumerate(words) if i not in gone)
        out.append((str(number), len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect())


def corpus(draw, count, vocabulary):
    """Texts of random words with stretches of earlier texts, edited and unedited, and whole copies."""
    texts = []
    for _ in range(count):
        parts = []
        for _ in range(draw.randint(1, 5)):
            fresh = [draw.choice(vocabulary) for _ in range(draw.randint(0, 60))]
            if texts and draw.random() < 0.6:
                other = draw.choice(texts).split()
                at = draw.randint(0, len(other))
                fresh = other[at:at + draw.randint(10, 160)]
                if fresh and draw.random() < 0.4:
                    fresh[draw.randrange(len(fresh))] = "edited"
            parts += fresh
        texts.append(draw.choice([" ", "\n", "\t "]).join(parts))
    return texts


def test_equals_the_plain_comparison(spark):
    draw = random.Random(2)
    for vocabulary, length, seed in (([f"w{i}" for i in range(400)], 50, 20), (["a", "b"], 50, 20), (["a", "b", "c"], 12, 5), ([f"w{i}" for i in range(40)], 9, 9), (["x"], 50, 20)):
        numbers = list(range(90))
        draw.shuffle(numbers)
        rows = [(n if k % 11 else draw.choice([n, None, 3]), text, "en", "a", 0) for k, (n, text) in enumerate(zip(numbers, corpus(draw, 90, vocabulary)))]
        got = result(repeats.measured(documents(spark, rows), length, seed))
        assert got == plain(rows, length), (length, seed)


def test_awkward_rows(spark):
    rows = [*ROWS, (9, ROWS[0][1] * 9, "en", "a", 1), (10, ROWS[0][1] * 9, "en", "a", 1), (10, ROWS[0][1] * 9, "en", "a", 1), (0, ROWS[7][1] + " end", "en", "a", 1)]
    got = result(repeats.measured(clashing(documents(spark, rows))))
    assert got == plain(rows, 50)
    assert repeats.measured(documents(spark, [])).collect() == []


def test_kept_words_and_maximal_repeats(spark):
    passage = [f"p{i}" for i in range(60)]
    first, second = "head " + " ".join(passage) + " tail", " ".join(["x"] * 7 + passage + ["y"] * 3)
    got = {r["doc_id"]: r for r in repeats.without_repeats(documents(spark, [(1, first, "en", "a", 0), (2, second, "en", "a", 0)])).collect()}
    assert got[1]["kept"] == first and got[1]["begins"] == []
    assert got[2]["kept"] == " ".join(["x"] * 7 + ["y"] * 3) and (got[2]["begins"], got[2]["ends"]) == ([7], [67])


def test_equal_windows_have_equal_anchors():
    """Every window that two texts share is served by an anchor with the same seed at the same place of the window."""
    draw = random.Random(7)
    for _ in range(40):
        words = [draw.choice([b"a", b"b", b"c", b"dd"]) for _ in range(90)]
        other = [b"z"] * draw.randint(0, 30) + words[draw.randint(0, 30):] + [b"q"] * draw.randint(0, 20)
        def windows(text):
            out = {}
            for seed, _, start, count in zip(*repeats.anchors(text, 50, 20)):
                for i in range(start, start + count):
                    out.setdefault(tuple(text[i:i + 50]), set()).add(int(seed))
            assert len(text) - 49 == sum(repeats.anchors(text, 50, 20)[3])
            return out
        a, b = windows(words), windows(other)
        assert all(a[w] == b[w] and len(a[w]) == 1 for w in a.keys() & b.keys())
    assert len(repeats.anchors([b"a"] * 49, 50, 20)[0]) == 0 and np.array_equal(repeats.anchors([b"a"] * 50, 50, 20)[3], [1])
