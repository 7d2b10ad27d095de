"""Collocations by weighted acyclic automata over the n-grams of shards.

Texts are cut into pieces at punctuation and line ends, pieces into words; all counts are per language.

* Words are counted first. Those below the threshold end a run of words, as no phrase across them can reach it; tasks know them by a bit set
  of fixed size in the shared folder (a bit may be set for a rare word, which costs room and changes no count).
* A shard, a bounded number of words, sorts the words from each of its positions, folds equal ones and builds a
  transducer: an arc holds a word and how many positions take it on this path, so the weight of a path is the count of its phrase in the shard.
  States with equal arcs, weights and targets are one.
* This is done twice. Transducers of word pairs give the frequent pairs, a second bit set; a rare pair ends a run as well, and what is left goes
  into transducers of up to five words, which are small.
* Transducers are cut into prefix ranges, by a hash of the first two words. Those of a range meet in one task, where their union is walked in
  breadth: arcs of a common prefix are added up by word, and a prefix below the threshold ends there.
* The union of a range is written as a transducer again. Parts of a phrase at its start are on its own path; a part at its end is looked up by
  composition of the phrases' ends with the transducer of the range they lie in. Single words have their counts.

Scores are exact decimals.
"""

from __future__ import annotations

import functools
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from blockloom.llm import common

LEAST = 100
LONGEST = 5
TOP = 2000
#: Words of a shard, positions of a prefix range, bits of the word filter (as a power of two) and bits of one row of it.
SHARD_WORDS = 2_000_000
RANGE_WORDS = 4_000_000
FILTER_BITS = 27
ROW_BITS = 32_768
KEPT_WORDS = 400_000
ID_BITS = 21
BREAK = b"\xff"
TABLE = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", BREAK * 10)
SEED = 42


def words_of(text: str) -> list[bytes]:
    """Lower-cased words of a text, with BREAK (a byte no text holds) between pieces and at the end."""
    return (text.encode().lower().translate(TABLE) + BREAK).replace(BREAK, b" \xff ").split()


def _hash(word: bytes, seed: int = SEED) -> int:
    """``xxhash64`` of the session's SQL."""
    return xxhash.xxh64_intdigest(word, seed)


# --- counts of words ---------------------------------------------------------------------------------------------------------------


def _texts(docs: DataFrame) -> DataFrame:
    return common.few_rows(docs).select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text IS NOT NULL")


def _word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, n): occurrences of every word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def flush() -> pa.RecordBatch:
            rows = [(lang, word.decode(), n) for lang, counts in held.items() for word, n in counts.items() if word != BREAK]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([row[k] for row in rows], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int64()))],
                                              names=["lang", "word", "n"])

        for batch in common.pieces(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), common.text_of(batch)):
                held.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, held.values())) > KEPT_WORDS:
                yield flush()
        if held:
            yield flush()

    return texts.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _write_filter(hashes: DataFrame, column: Column) -> str:
    """The folder of the bit set of 64-bit hashes, in rows of a fixed number of bits."""
    folder = common.new_folder(hashes.sparkSession, "bits")
    place = F.shiftrightunsigned(column, 64 - FILTER_BITS)
    bits = hashes.select(place.alias("place")).groupBy(F.expr(f"place div {ROW_BITS}").alias("row")).agg(
        F.bitmap_construct_agg(F.col("place") % ROW_BITS).alias("bits"))
    bits.coalesce(8).write.parquet(folder)
    return folder


@functools.lru_cache(maxsize=2)
def _read_filter(folder: str) -> np.ndarray:
    store, inner = common.open_folder(folder)
    out = np.zeros(1 << FILTER_BITS >> 3, np.uint8)
    for info in store.get_file_info(pafs.FileSelector(inner)):
        if info.path.endswith(".parquet"):
            table = pq.read_table(info.path, filesystem=store, partitioning=None)
            for row, bits in zip(table["row"].to_pylist(), table["bits"].to_pylist()):
                out[row * ROW_BITS // 8:row * ROW_BITS // 8 + len(bits)] |= np.frombuffer(bits, np.uint8)
    return out


# --- automata ----------------------------------------------------------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _ramps(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each count."""
    return np.arange(counts.sum()) - np.repeat(counts.cumsum() - counts, counts)


class Automaton:
    """A count transducer of bounded depth: for each depth the states' numbers of arcs, and the arcs' words, weights and target states.

    State 0 of every depth but the first has no arcs; arcs of a state are in the order of their words, and so are words by number.
    """

    def __init__(self, words: list[bytes], levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        self.words, self.levels = words, levels

    @classmethod
    def build(cls, words: list[bytes], rows: list[np.ndarray], counts: np.ndarray) -> Automaton:
        """From distinct word-number rows in order, column by column; numbers begin at 1, and 0 is behind the end of a row."""
        total = np.concatenate([[0], counts.cumsum()])
        changed, nodes = np.zeros(len(counts), bool), []
        for column in rows:
            changed = changed | (np.diff(column, prepend=-1) != 0)
            starts = np.flatnonzero(changed)
            ends = np.append(starts[1:], len(counts))
            real = column[starts] > 0
            nodes.append((starts[real], column[starts[real]] - 1, total[ends[real]] - total[starts[real]]))
        levels, targets = [], np.zeros(len(nodes[-1][0]), np.int64)
        for depth in range(len(rows) - 1, -1, -1):
            starts, labels, weights = nodes[depth]
            if not depth:
                levels.append((np.array([len(labels)]), labels, weights, targets))
                break
            parent = np.searchsorted(nodes[depth - 1][0], starts, "right") - 1
            arcs = np.bincount(parent, minlength=len(nodes[depth - 1][0]))
            owners = np.flatnonzero(arcs)
            first = (arcs.cumsum() - arcs)[owners]
            state, kept = cls._registered(first, labels, weights, targets)
            places = np.repeat(first[kept], arcs[owners][kept]) + _ramps(arcs[owners][kept])
            levels.append((np.append(0, arcs[owners][kept]), labels[places], weights[places], targets[places]))
            targets = np.zeros(len(arcs), np.int64)
            targets[owners] = state + 1
        return cls(words, levels[::-1])

    @staticmethod
    def _registered(first: np.ndarray, labels: np.ndarray, weights: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State of each run of arcs, equal runs the same, and which runs the states keep."""
        if not len(first):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        marks = []
        for salt in (1, 2):
            arc = _mixed(_mixed(_mixed(labels.astype(np.uint64) + np.uint64(salt)) + weights.astype(np.uint64)) + targets.astype(np.uint64))
            marks.append(np.add.reduceat(arc, first))
        _, kept, state = np.unique(marks[0], return_index=True, return_inverse=True)
        if (marks[1][kept][state] != marks[1]).any():  # two runs under one mark: share nothing here
            return np.arange(len(first)), np.arange(len(first))
        return state, kept

    def to_bytes(self) -> bytes:
        parts = [BREAK.join(self.words)]
        for level in self.levels:
            for numbers in level:
                wide = int(numbers.max(initial=0)) >> 32
                kind = "<u8" if wide else "<u4"
                size = 8 if wide else 4
                planes = np.ascontiguousarray(numbers.astype(kind).view(np.uint8).reshape(len(numbers), size).T).tobytes()
                parts.append(struct.pack("<B", size) + planes)
        body = b"".join(struct.pack("<Q", len(part)) + part for part in parts)
        return zstandard.ZstdCompressor(level=1).compress(body)

    @classmethod
    def from_bytes(cls, data: bytes) -> Automaton:
        body, parts, at = zstandard.ZstdDecompressor().decompress(data), [], 0
        while at < len(body):
            size = struct.unpack_from("<Q", body, at)[0]
            parts.append(body[at + 8:at + 8 + size])
            at += 8 + size
        numbers = []
        for part in parts[1:]:
            planes = np.frombuffer(part, np.uint8)[1:].reshape(part[0], len(part) // part[0])
            numbers.append(np.ascontiguousarray(planes.T).view(f"<u{part[0]}").reshape(-1).astype(np.int64))
        return cls(parts[0].split(BREAK) if parts[0] else [], [tuple(numbers[i:i + 4]) for i in range(0, len(numbers), 4)])

    def weights_of(self, phrases: list[list[bytes]]) -> np.ndarray:
        """Weights of the paths of phrases, 0 where there is none: the composition with an acceptor of the phrases."""
        number = {word: i for i, word in enumerate(self.words)}
        state, weight, alive = np.zeros(len(phrases), np.int64), np.zeros(len(phrases), np.int64), np.ones(len(phrases), bool)
        for depth, (arcs, labels, weights, targets) in enumerate(self.levels):
            on = alive & np.array([len(phrase) > depth for phrase in phrases], bool)
            rows = np.flatnonzero(on)
            if not len(rows):
                break
            label = np.array([number.get(phrases[i][depth], -1) for i in rows])
            size = len(self.words) + 1
            keys = np.repeat(np.arange(len(arcs)), arcs) * size + labels
            place = np.searchsorted(keys, state[rows] * size + label)
            hit = (label >= 0) & (place < len(keys))
            hit[hit] = keys[place[hit]] == state[rows][hit] * size + label[hit]
            weight[rows] = 0
            weight[rows[hit]], state[rows[hit]] = weights[place[hit]], targets[place[hit]]
            alive[rows[~hit]] = False
        return weight


def union(parts: list[Automaton], least: int) -> tuple[list[bytes], list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Words, and for each depth (parent, word, weight) of the paths whose weights over all parts, of equal depth, add up to ``least``."""
    words = sorted(set().union(*[part.words for part in parts]))
    number = {word: i for i, word in enumerate(words)}
    renamed = [np.array([number[word] for word in part.words], np.int64) for part in parts]
    nodes, group = [], np.zeros(len(parts), np.int64)
    deepest = len(parts[0].levels)
    depth_bases = [np.cumsum([0, *[len(part.levels[d][0]) for part in parts]]) for d in range(deepest)]
    state = depth_bases[0][:-1].copy()
    for depth in range(deepest):
        arcs = np.concatenate([part.levels[depth][0] for part in parts])
        labels = np.concatenate([names[part.levels[depth][1]] for names, part in zip(renamed, parts)])
        weights = np.concatenate([part.levels[depth][2] for part in parts])
        lasts = depth_bases[depth + 1] if depth + 1 < deepest else np.zeros(len(parts) + 1, np.int64)
        targets = np.concatenate([part.levels[depth][3] + base for part, base in zip(parts, lasts)])
        counts = arcs[state]
        taken = np.repeat((arcs.cumsum() - arcs)[state], counts) + _ramps(counts)
        keys = np.repeat(group, counts) * len(words) + labels[taken]
        order = np.argsort(keys, kind="stable")
        keys, taken = keys[order], taken[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        sums = np.add.reduceat(weights[taken], first) if len(first) else np.empty(0, np.int64)
        kept = sums >= least
        owner = np.repeat(np.cumsum(kept) - 1, np.diff(first, append=len(keys)))
        on = np.repeat(kept, np.diff(first, append=len(keys)))
        nodes.append((keys[first][kept] // max(len(words), 1), keys[first][kept] % max(len(words), 1), sums[kept]))
        group, state = owner[on], targets[taken[on]]
    return words, nodes


# --- shards and ranges -------------------------------------------------------------------------------------------------------------


class Lexicon(dict):
    """Numbers from 1 of the frequent words of a language, 0 for others; rare words are asked again rather than kept."""

    def __init__(self, lang: str, bits: np.ndarray):
        super().__init__({BREAK: 0})
        self.lang, self.bits, self.seed, self.words, self.hashes = lang, bits, _hash(lang.encode()), [], []

    def __missing__(self, word: bytes) -> int:
        place = _hash(word, self.seed) >> (64 - FILTER_BITS)
        if not self.bits[place >> 3] >> (place & 7) & 1:
            return 0
        self.words.append(word)
        self.hashes.append(_hash(word))
        self[word] = len(self.words)
        return len(self.words)


def pair_hash(first: np.ndarray, second: np.ndarray, lang: str) -> np.ndarray:
    """Hash of two words of a language from the words' hashes."""
    return _mixed(_mixed(first ^ np.uint64(_hash(lang.encode()))) + second)


def shard_automata(lexicon: Lexicon, numbers: np.ndarray, ranges: int, depth: int = LONGEST, pairs: np.ndarray | None = None) -> Iterator[tuple[int, Automaton]]:
    """(range, automaton) of the phrases of up to ``depth`` words in a stretch of word numbers, 0 between runs; ``pairs`` is the bit set of pairs that go on."""
    order = sorted(range(len(lexicon.words)), key=lexicon.words.__getitem__)  # numbers in the order of the words
    rank = np.zeros(len(order) + 1, np.int64)
    rank[np.array(order, np.int64) + 1] = np.arange(1, len(order) + 1)
    hashes = np.array([0, *[lexicon.hashes[i] for i in order]], np.uint64)
    words = [lexicon.words[i] for i in order]
    numbers = np.concatenate([rank[numbers], np.zeros(depth + 1, np.int64)])
    size = len(numbers) - depth
    goes_on = (numbers[:-1] > 0) & (numbers[1:] > 0)
    if pairs is not None:
        at = np.flatnonzero(goes_on)
        place = (pair_hash(hashes[numbers[at]], hashes[numbers[at + 1]], lexicon.lang) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
        goes_on[at] = pairs[place >> 3] >> (place & 7).astype(np.uint8) & 1
    at = np.flatnonzero(goes_on[:size])
    if not len(at):
        return
    columns, alive = [numbers[at], numbers[at + 1]], np.ones(len(at), bool)
    for k in range(2, depth):
        alive = alive & goes_on[at + k - 1]
        columns.append(np.where(alive, numbers[at + k], 0))
    span = (((hashes[columns[0]] >> np.uint64(7)) ^ hashes[columns[1]]) & np.uint64(ranges - 1)).astype(np.int64)
    if len(words) >> ID_BITS:  # one very long text
        keys = [*columns[::-1], span]
    else:
        packed = [columns[0] << ID_BITS | columns[1]]
        for column in columns[2:]:
            if int(packed[-1].max()) >> 63 - ID_BITS:
                packed.append(column)
            else:
                packed[-1] = packed[-1] << ID_BITS | column
        keys = [*packed[::-1], span]
    order = np.lexsort(keys)
    first = np.flatnonzero(functools.reduce(np.logical_or, [np.diff(key[order], prepend=-1) != 0 for key in keys]))
    counts = np.diff(first, append=len(order))
    chosen = order[first]
    span, rows = span[chosen], [column[chosen] for column in columns]
    starts = np.flatnonzero(np.diff(span, prepend=-1))
    for x, y in zip(starts.tolist(), [*starts[1:].tolist(), len(span)]):
        used, local = np.unique(np.concatenate([row[x:y] for row in rows]), return_inverse=True)
        shift = 0 if used[0] == 0 else 1  # 0 stays the end of a row
        local = (local + shift).reshape(depth, -1)
        yield int(span[x]), Automaton.build([words[i - 1] for i in used if i], list(local), counts[x:y])


def _shards(texts: DataFrame, folder: str, ranges: int, depth: int = LONGEST, pair_folder: str | None = None) -> DataFrame:
    """(lang, part, shard): automata of the shards, cut by prefix range."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, pairs = _read_filter(folder), _read_filter(pair_folder) if pair_folder else None
        lexicons, held, count = {}, {}, 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                found = shard_automata(lexicons[lang], np.concatenate(parts), ranges, depth, pairs)
                rows = [(lang, span, automaton.to_bytes()) for span, automaton in found]
                yield pa.RecordBatch.from_arrays([pa.array([row[k] for row in rows], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.binary()))],
                                                 names=["lang", "part", "shard"])

        for batch in common.pieces(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), common.text_of(batch)):
                if lang not in lexicons:
                    lexicons[lang] = Lexicon(lang, bits)
                found = words_of(text)
                held.setdefault(lang, []).append(np.fromiter(map(lexicons[lang].__getitem__, found), np.int64, len(found)))
                count += len(found)
                if count >= SHARD_WORDS:
                    yield from flush()
                    lexicons, held, count = {}, {}, 0
        yield from flush()

    return texts.mapInArrow(run, "lang string, part int, shard binary")


def _frequent_pairs(table: pa.Table, least: int) -> pa.Table:
    """Hashes of the pairs of a range that are frequent over all shards."""
    lang = table["lang"][0].as_py()
    words, nodes = union([Automaton.from_bytes(data) for data in table["shard"].to_pylist()], least)
    hashes = np.array([_hash(word) for word in words], np.uint64)
    parent, second, _ = nodes[1]
    return pa.Table.from_arrays([pa.array(pair_hash(hashes[nodes[0][1][parent]], hashes[second], lang).view(np.int64))], names=["hash"])


UNITED = "lang string, part int, automaton binary, phrase string, size int, a long, lefts array<long>, contained boolean"


def _united(table: pa.Table, least: int) -> pa.Table:
    """The union of a range, and a row for each of its phrases: counts of its first parts of two words and more, and whether a longer phrase with this start is as frequent."""
    lang, part = table["lang"][0].as_py(), table["part"][0].as_py()
    words, nodes = union([Automaton.from_bytes(data) for data in table["shard"].to_pylist()], least)
    texts = [word.decode() for word in words]
    out, names, lefts = [], [], []
    for depth, (parent, label, weight) in enumerate(nodes):
        names = [texts[w] if not depth else f"{names[p]} {texts[w]}" for p, w in zip(parent.tolist(), label.tolist())]
        lefts = [[] if depth < 2 else [*lefts[p], int(nodes[depth - 1][2][p])] for p in parent.tolist()]
        most = np.zeros(len(label), np.int64)
        if depth + 1 < LONGEST:
            np.maximum.at(most, nodes[depth + 1][0], nodes[depth + 1][2])
        if depth:
            out += [(name, depth + 1, int(a), left, bool(m == a)) for name, a, left, m in zip(names, weight.tolist(), lefts, most.tolist())]
    data = _trie(words, nodes).to_bytes()
    rows = [(lang, part, data, None, None, None, None, None), *[(lang, part, None, *row) for row in out]]
    kinds = (pa.string(), pa.int32(), pa.binary(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.bool_())
    return pa.Table.from_arrays([pa.array([row[k] for row in rows], kind) for k, kind in enumerate(kinds)],
                                names=["lang", "part", "automaton", "phrase", "size", "a", "lefts", "contained"])


def _trie(words: list[bytes], nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Automaton:
    """The kept paths as a transducer; every path has a state of its own, 0 left empty."""
    levels = []
    for depth, (parent, label, weight) in enumerate(nodes):
        arcs = np.bincount(parent, minlength=len(nodes[depth - 1][0])) if depth else np.array([len(label)])
        levels.append((np.append(0, arcs) if depth else arcs, label, weight, np.arange(1, len(label) + 1)))
    return Automaton(words, levels)


def _composed(phrases: pa.Table, automata: pa.Table) -> pa.Table:
    """The count of the end part of each row of a range."""
    ends = [end.encode().split(b" ") for end in phrases["rest"].to_pylist()]
    found = np.zeros(len(ends), np.int64)
    for data in automata["automaton"].to_pylist():
        found += Automaton.from_bytes(data).weights_of(ends)
    return pa.Table.from_arrays([phrases["lang"], phrases["phrase"], phrases["cut"], phrases["a"], phrases["l"], pa.array(found), phrases["rest"]],
                                names=["lang", "phrase", "cut", "a", "l", "r", "rest"])


def _part(words: Column, ranges: int) -> Column:
    """Prefix range of a phrase, as in the shards."""
    first, second = F.xxhash64(F.element_at(words, 1)), F.xxhash64(F.element_at(words, 2))
    return F.shiftrightunsigned(first, 7).bitwiseXOR(second).bitwiseAND(F.lit(ranges - 1)).cast("int")


def collocations(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """All collocations: lang, phrase, a, l, r, n, score, cut, of the cut with the lowest score (the first of equal ones).

    A null language is ``und``; a null or empty text has no words, repeated rows count again, other columns are not read and an empty table gives
    an empty one. A phrase inside a longer one that is as frequent is left out. The count of a phrase includes overlapping occurrences.
    """
    texts = _texts(docs)
    counted = common.staged(_word_counts(texts), "words")
    totals = common.staged(counted.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    words = common.staged(counted.where(F.col("n") >= least), "frequent")
    common.remove(counted)
    total = totals.agg(F.sum("n")).first()[0] or 0
    ranges = 1 << max(2, (total // RANGE_WORDS).bit_length())
    word_bits = _write_filter(words, F.xxhash64("lang", "word"))
    pairs = _shards(texts, word_bits, ranges, 2).groupBy("lang", "part").applyInArrow(lambda table: _frequent_pairs(table, least), "hash long")
    shards = _shards(texts, word_bits, ranges, LONGEST, _write_filter(pairs, F.col("hash")))
    united = shards.groupBy("lang", "part").applyInArrow(lambda table: _united(table, least), UNITED)
    united = common.staged(united, "united")
    phrases = united.where("phrase IS NOT NULL").select("lang", "phrase", "a", "lefts", "contained", F.split("phrase", " ").alias("w"), "size")
    cuts = phrases.select("lang", "phrase", "a", "size", "w", "lefts", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.when(F.col("cut") > 1, F.get("lefts", F.col("cut") - 2)).alias("l"), F.element_at("w", 1).alias("head"),
                       F.expr("slice(w, cut + 1, size - cut)").alias("tail"))
    one = words.select("lang", F.col("word"), F.col("n").alias("f"))
    heads = one.select(F.col("lang").alias("hl"), F.col("word").alias("head_word"), F.col("f").alias("head_n"))
    cuts = (cuts.join(heads, (F.col("cut") == 1) & (F.col("lang") == F.col("hl")) & (F.col("head") == F.col("head_word")), "left")
            .select("lang", "phrase", "a", "cut", F.coalesce("l", "head_n").alias("l"), "tail", F.array_join("tail", " ").alias("rest")))
    cuts = common.staged(cuts, "cuts")
    single = (cuts.where(F.size("tail") == 1).join(one.withColumnRenamed("word", "rest"), ["lang", "rest"])
              .select("lang", "phrase", "cut", "a", "l", F.col("f").alias("r"), "rest"))
    longer = cuts.where(F.size("tail") > 1).withColumn("part", _part(F.col("tail"), ranges)).drop("tail")
    automata = united.where("automaton IS NOT NULL").select("lang", "part", "automaton")
    composed = longer.groupBy("lang", "part").cogroup(automata.groupBy("lang", "part")).applyInArrow(
        _composed, "lang string, phrase string, cut int, a long, l long, r long, rest string")
    scored = common.staged(single.unionByName(composed), "scored")
    # A phrase is also inside one that has a word more in front of it: the end of the first cut.
    behind = scored.where("cut = 1 AND a = r").select("lang", F.col("rest").alias("phrase")).distinct()
    whole = phrases.where("NOT contained").select("lang", "phrase").join(behind, ["lang", "phrase"], "left_anti")
    exact = "CAST(1000 AS DECIMAL(4, 0)) * CAST(a AS DECIMAL(15, 0)) * CAST(n AS DECIMAL(17, 0)) DIV (CAST(l AS DECIMAL(17, 0)) * CAST(r AS DECIMAL(17, 0)))"
    scored = scored.join(totals, "lang").withColumn("score", F.expr(exact))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    return best.join(whole, ["lang", "phrase"], "left_semi").select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score", "best.cut")


def first_of_each(found: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` collocations of each language with their rank; a part of the rows is cut to as many before the rows of a language meet."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(64))
    some = found.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    return (some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_of_each(collocations(common.table(spark, sf_dir, "documents")))


SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM p),
q AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w),
k AS (SELECT lang, words, i, unnest(range(1, 6)) AS m FROM q),
f AS (SELECT lang, m, array_to_string(words[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM k WHERE i + m - 1 <= len(words) GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, string_split(phrase, ' ') AS words, f AS a FROM f WHERE m > 1 AND f >= 100),
t AS (SELECT lang, m, phrase, words, a, unnest(range(1, m)) AS cut FROM c),
s AS (SELECT t.lang, t.phrase, t.a, t.cut, x.f AS l, y.f AS r, n.n, (CAST(1000 AS HUGEINT) * t.a * n.n) // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM t JOIN n ON t.lang = n.lang JOIN f x ON x.lang = t.lang AND x.phrase = array_to_string(t.words[1:t.cut], ' ') AND x.m = t.cut
  JOIN f y ON y.lang = t.lang AND y.phrase = array_to_string(t.words[t.cut + 1:t.m], ' ') AND y.m = t.m - t.cut),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
u AS (SELECT lang, m, words, a, unnest(range(1, m + 1)) AS i FROM c),
v AS (SELECT lang, m, words, a, i, unnest(range(i + 1, m + 1)) AS j FROM u),
g AS (SELECT lang, array_to_string(words[i:j], ' ') AS phrase, max(a) AS longer FROM v WHERE j - i + 1 < m GROUP BY ALL),
z AS (SELECT b.* FROM b LEFT JOIN g ON b.lang = g.lang AND b.phrase = g.phrase WHERE g.longer IS NULL OR 100 * g.longer < 100 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
  CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM z QUALIFY rank <= 2000
"""
