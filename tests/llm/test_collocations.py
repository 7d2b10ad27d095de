"""Collocations against plain counting, and the automata against dictionaries."""

import random
import re
from collections import Counter

import numpy as np

from blockloom.llm import collocations
from tests.llm.helpers import ROWS, clashing, documents


def plain(rows, least):
    """The contract word for word, with whole dictionaries."""
    counts, totals = {}, Counter()
    for _, text, lang, *_ in rows:
        own = counts.setdefault(lang or "und" if lang is None else lang, Counter())
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            totals["und" if lang is None else lang] += len(words)
            own.update(tuple(words[i:i + m]) for m in range(1, 6) for i in range(len(words) - m + 1))
    out = []
    for lang, own in counts.items():
        candidates = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        inside = {}
        for p, a in candidates.items():
            for i in range(len(p)):
                for j in range(i + 1, len(p) + 1):
                    if j - i < len(p):
                        inside[p[i:j]] = max(a, inside.get(p[i:j], 0))
        for p, a in candidates.items():
            if 100 * inside.get(p, 0) < 100 * a:
                score, k = min((1000 * a * totals[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                out.append((lang, " ".join(p), a, own[p[:k]], own[p[k:]], totals[lang], score))
    return sorted(out)


def result(df):
    return sorted((r["lang"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect())


def random_rows(draw, count):
    words = ["the", "of", "New", "york", "City", "a", "b,", "c.", "Über", "日本", "x y", "\n", "\t", "end!", "\u0000", "\u000b"]
    fixed = ["once upon a time there", "New York City council", "a a a a a a"]
    out = []
    for i in range(count):
        text = " ".join(draw.choice(fixed) if draw.random() < 0.3 else draw.choice(words) for _ in range(draw.randint(0, 60)))
        out.append((i, text, draw.choice(["en", "de", None, "und", ""]), "a", 0))
    return out


def test_equals_plain_counting(spark, monkeypatch):
    rows = [*ROWS, *random_rows(random.Random(1), 300)]
    docs = clashing(documents(spark, rows)).repartition(6)
    for least in (100, 12, 3):
        want = plain(rows, least)
        assert result(collocations.collocations(docs, least)) == want and want
    monkeypatch.setattr(collocations, "RANGE_WORDS", 50)  # many prefix ranges
    assert result(collocations.collocations(docs, 5)) == plain(rows, 5)


def test_first_of_each(spark):
    rows = random_rows(random.Random(2), 200)
    found = collocations.collocations(documents(spark, rows), 4)
    want = {}
    for row in sorted(plain(rows, 4), key=lambda r: (-r[6], -r[2], r[1].encode())):
        want.setdefault(row[0], []).append(row[1])
    got = {}
    for row in sorted(collocations.first_of_each(found, 7).collect(), key=lambda r: r["rank"]):
        got.setdefault(row["lang"], []).append(row["phrase"])
        assert row["rank"] == len(got[row["lang"]])
    assert got == {lang: phrases[:7] for lang, phrases in want.items()}


def test_empty_tables(spark):
    assert collocations.first_of_each(collocations.collocations(documents(spark, []))).collect() == []
    assert collocations.collocations(documents(spark, [(1, None, None, "a", 0), (2, " . ", "en", "a", 0)]), 1).collect() == []


def test_automata_hold_counts_of_all_prefixes():
    draw = random.Random(3)
    for _ in range(30):
        names = sorted({bytes([draw.randrange(97, 123)]) * draw.randint(1, 3) for _ in range(draw.randint(1, 9))})
        parts, want = [], Counter()
        for _ in range(draw.randint(1, 4)):
            count = Counter()
            for _ in range(draw.randint(1, 60)):
                row = [draw.randint(1, len(names)) for _ in range(draw.randint(2, 5))]
                count[tuple(row + [0] * (5 - len(row)))] += draw.randint(1, 3)
            rows = sorted(count)
            part = collocations.Automaton.build(names, [np.array([row[k] for row in rows], np.int64) for k in range(5)], np.array([count[row] for row in rows]))
            own = Counter()
            for row, n in count.items():
                for k in range(1, 6):
                    if row[k - 1]:
                        own[tuple(names[i - 1] for i in row[:k])] += n
            part = collocations.Automaton.from_bytes(part.to_bytes())
            paths = sorted(own)
            assert part.weights_of([list(path) for path in paths] + [[b"none"], [*names[:1], b"none"]]).tolist() == [own[path] for path in paths] + [0, 0]
            parts.append(part)
            want += own
        words, nodes = collocations.union(parts, 5)
        paths, got = [()], {}
        for parent, label, weight in nodes:
            paths = [(*paths[p], words[w]) for p, w in zip(parent, label)]
            got |= dict(zip(paths, weight.tolist()))
        assert got == {path: n for path, n in want.items() if n >= 5}


def test_equal_ends_share_states():
    """Words that are followed by the same ends with the same counts lead to one state."""
    rows = [(a, 7, 8, 9, 0) for a in range(1, 6)]
    automaton = collocations.Automaton.build([bytes([97 + i]) for i in range(9)], [np.array([row[k] for row in rows]) for k in range(5)], np.ones(5, np.int64))
    assert [len(level[0]) for level in automaton.levels] == [1, 2, 2, 2, 1]
