"""Components equal those of all pairs; linked sets always share a block; sketches bound the difference from below."""

import itertools
import random

import numpy as np
import pytest

from blockloom.llm import jaccard
from tests.llm.helpers import LONG, ROWS, TEXT, clashing, documents


def plain_set(text, n=4):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(blank, " ")
    words = [w for w in lowered.split(" ") if w]
    return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def plain(rows):
    sets = [plain_set(row[1]) for row in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
            parent[root(i)] = root(j)
    least = {}
    for i, row in enumerate(rows):
        if row[0] is not None:
            least[root(i)] = min(least.get(root(i), row[0]), row[0])
    return sorted(str((row[0], len(sets[i]), least.get(root(i)) if sets[i] else row[0])) for i, row in enumerate(rows))


def corpus(seed, count=120):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [draw.choice(vocabulary) for _ in range(40)]
    rows, number = [], 100
    for _ in range(count // 6):
        base = [draw.choice(vocabulary) for _ in range(draw.choice([3, 6, 12, 30, 80, 200]))]
        if draw.random() < 0.3:
            base = passage + base
        for copy in range(6):
            words = list(base)
            for _ in range(draw.choice([0, 0, 1, 1, 2, 3])):
                words[draw.randrange(len(words))] = draw.choice(vocabulary)
            rows.append((number, draw.choice([" ", "\n", "  "]).join(words).upper() if copy == 5 else " ".join(words), "en", "a", 0))
            number += 1
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_all_pairs(spark, seed):
    rows = corpus(seed) + ROWS
    got = sorted(str(tuple(r)[:3]) for r in jaccard.components(clashing(documents(spark, rows))).collect())
    assert got == plain(rows)


def plain_links(rows, n=4, share=85):
    """(classes as sets of shingles, linked pairs of them) by comparing all."""
    classes = sorted({frozenset(plain_set(row[1], n)) for row in rows} - {frozenset()}, key=lambda c: sorted(c))
    return classes, {(a, b) for a, b in itertools.permutations(classes, 2) if 100 * len(a & b) >= share * len(a | b)}


@pytest.mark.parametrize("n, share", [(4, 85), (5, 80), (2, 60)])
def test_all_links_are_found(spark, n, share, monkeypatch):
    """Link counts and the pairs of the join equal those of comparing all different sets, also where a component takes several blocks."""
    if n == 4:
        monkeypatch.setattr(jaccard, "BLOCK_CLASSES", 2)
    rows = corpus(n) + ROWS
    classes, links = plain_links(rows, n, share)
    sets = {row[0]: frozenset(plain_set(row[1], n)) for row in rows}
    docs = documents(spark, rows)
    for row in jaccard.components(docs, n, share).collect():
        own = sets[row["doc_id"]]
        assert row["n_links"] == sum(a == own for a, _ in links)
        assert sets[row["class_id"]] == own
    pairs, membership = jaccard.join(docs, n, share)
    named = {bytes(r["cls"]): sets[r["doc_id"]] for r in membership.collect() if r["cls"] is not None}
    got = [(named[bytes(r["src"])], named[bytes(r["dst"])]) for r in pairs.collect()]
    assert len(got) == len(set(got)) == len(links) // 2 and set(got) | {(b, a) for a, b in got} == links and links


def test_compared_blocks_of_many_shingles():
    draw = np.random.default_rng(5)
    base = np.unique(draw.integers(0, 2 ** 64, 40_000, dtype=np.uint64))
    sets = [np.unique(np.concatenate([base[draw.random(len(base)) > p], draw.integers(0, 2 ** 64, 50, dtype=np.uint64)])) for p in (0.0, 0.02, 0.05, 0.1, 0.3, 0.08)]
    first = np.array([True, False, True, False, True, False])
    def linked(a, b):
        return 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b))
    assert jaccard._compared(sets, first, False, 85).tolist() == [[linked(sets[i], sets[j]) for j in (1, 3, 5)] for i in (0, 2, 4)]
    assert jaccard._compared(sets, np.ones(6, bool), True, 85).tolist() == [[i != j and linked(sets[i], sets[j]) for j in range(6)] for i in range(6)]


def test_linked_sets_share_a_block_and_sketches_bound_the_difference():
    draw, linked = np.random.default_rng(3), 0
    for step in range(1500):
        size = int(draw.integers(5, 300 if step % 20 else 5000))
        a = draw.integers(0, 2 ** 64, size, dtype=np.uint64)
        b = np.concatenate([a[int(draw.integers(0, size * 0.12 + 1)):], draw.integers(0, 2 ** 64, int(draw.integers(0, size * 0.12 + 1)), dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        differ = len(a) + len(b) - 2 * both
        assert np.bitwise_count(jaccard.short_sketch(a).view(np.uint64) ^ jaccard.short_sketch(b).view(np.uint64)).sum() <= differ
        if 100 * both >= 85 * (differ + both) and differ:
            linked += 1
            assert len(np.intersect1d(jaccard.block_keys(a), jaccard.block_keys(b)))
    assert linked > 300


def test_bands_cover_every_pair_of_sizes():
    for size in range(1, 3000):
        for partner in range(size, jaccard.largest_partner(size) + 1):
            d = 15 * (size + partner) // 185
            assert any(x == y and e >= d for x, e in jaccard.bands_of(size) for y, _ in jaccard.bands_of(partner))


def test_one_of_each(spark):
    rows = ROWS + [(9, TEXT.upper(), "en", "c", 1), (10, LONG + " more", "en", "c", 1), (None, "only here", "en", "c", 1), (None, "only here", "en", "c", 1)]
    docs = clashing(documents(spark, rows))
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "4", "7", "8", "None"]
    assert jaccard.one_of_each(documents(spark, [])).count() == 0 and jaccard.components(documents(spark, [])).count() == 0

