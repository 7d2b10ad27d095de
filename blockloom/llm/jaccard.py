"""Near-duplicate join by n-gram Jaccard over parity sketches.

A document is the set of its distinct four-word shingles. Two sets with Jaccard of at least 0.85 and sizes a and b differ
in at most d = 15 (a + b) / 185 shingles. Each shingle flips one bit of a sketch, so sketches of such sets
differ in at most d bits:

* A wide sketch is cut into k = d + 1 + s blocks by a hash of the shingle, with d taken over a band of sizes. At least s + 1 blocks of
  a linked pair are equal. Each set drops its s blocks with the fewest set bits (by an order that depends on the
  block alone), which leaves at least one equal block kept by both, and joins on digests of the d + 1 others.
  The digest of a block is the XOR of the digests of its set bits.
* A short sketch of 512 bits goes with each set; a pair whose sketches differ in more than d bits cannot be linked.
* What is left is compared shingle by shingle.

Components come first, and for them a pair inside one component need not be looked at: two rounds with one pivot for each
group that shares a block connect large groups of copies with a number of pairs that grows with their rows; the last looks at
all remaining pairs that share a block and lie in different components. Every linked pair then lies inside a component, and the join compares
all sets of a component in blocks of classes: a task holds two blocks and multiplies their incidence matrices, so no row is written for a pair that is
not linked, and only the counts, or the linked pairs themselves where they are asked for, leave it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from blockloom.llm import common

N = 4
SHARE = 85
#: Classes of a block of a component, and shingles of a slice of an incidence matrix.
BLOCK_CLASSES = 512
SLICE = 16_384
PIVOT_ROUNDS = 2
#: Rows of a partition of the small tables between rounds.
ROWS_A_TASK = 200_000
LONGS = 8
SKETCH = [f"s{i}" for i in range(LONGS)]
#: Odd multipliers that mix 64-bit hashes.
MIX = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, n: int = N) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a whole text; words are cut at the six ASCII blanks, A-Z is lower-cased.

    Fewer than ``n`` words make one shingle, no words none. Two different shingles are taken for equal with a chance of 2^-64.
    """
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.array([xxhash.xxh64_intdigest(word) for word in words], np.uint64)
    width = min(n, len(words))
    mixed = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        mixed = mixed * MIX[3] + hashes[k:len(hashes) - width + 1 + k]
        mixed ^= mixed >> np.uint64(29)
    return np.unique(_mixed(mixed))


def class_of(shingles: np.ndarray) -> bytes:
    """96-bit digest of a set: equal sets are one class."""
    return xxhash.xxh3_128_digest(shingles.tobytes())[:12]


def short_sketch(shingles: np.ndarray) -> np.ndarray:
    """Parity of the shingles of each of 512 bits."""
    bits = np.bincount((shingles >> np.uint64(55)).astype(np.int64), minlength=64 * LONGS) & 1
    return np.packbits(bits.astype(np.uint8)).view("<i8")


def largest_partner(size: int, share: int = SHARE) -> int:
    return 100 * size // share


@lru_cache(maxsize=None)
def band(number: int, share: int = SHARE) -> tuple[int, int, int]:
    """(first own size, last own size, last size of a partner) of a band; a band is about 1.38 wide."""
    first = 1 if number == 0 else band(number - 1, share)[1] + 1
    last = max(first, first * 10_000 // share ** 2 - 1)
    return first, last, largest_partner(last, share)


@lru_cache(maxsize=1 << 16)
def bands_of(size: int, share: int = SHARE) -> tuple[tuple[int, int], ...]:
    """(band, d) of the bands in which a set of this size can meet a partner: as the smaller set and as the larger one."""
    number = 0
    while band(number, share)[1] < size:
        number += 1
    found = []
    for candidate in range(max(0, number - 1), number + 1):
        _, last, partner = band(candidate, share)
        if size <= partner:
            found.append((candidate, (100 - share) * (last + partner) // (100 + share)))
    return tuple(found)


def block_keys(shingles: np.ndarray, share: int = SHARE) -> np.ndarray:
    """Join keys of a set: digests of the d + 1 heaviest of its blocks in each band; none where d is 0, as then only equal sets are linked."""
    keys = []
    for number, d in bands_of(len(shingles), share):
        if not d:
            continue
        count = d + 1 + d // 4
        block = ((shingles >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)  # sorted, as the shingles are
        weight = np.bincount(block, minlength=count)
        digest = np.zeros(count, np.uint64)
        starts = np.flatnonzero(np.diff(block, prepend=-1))
        digest[block[starts]] = np.bitwise_xor.reduceat(_mixed(shingles * MIX[0]), starts)
        order = np.argsort(~((np.minimum(weight, 255).astype(np.uint64) << np.uint64(56)) | (digest >> np.uint64(8))), kind="stable")[:d + 1]
        place = np.uint64(number << 40) + order.astype(np.uint64)
        keys.append(_mixed(digest[order] ^ _mixed(place * MIX[0])))
    return np.concatenate(keys) if keys else np.empty(0, np.uint64)


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text and the hash of the text: id and hash find a row again without any assumption on ids."""
    text = F.coalesce("text", F.lit(""))
    return common.few_rows(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _members(rows: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches):
            sets = [shingle_set(text, n) for text in common.text_of(batch)]
            sketches = np.stack([short_sketch(s) for s in sets]) if sets else np.empty((0, LONGS), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([class_of(s) if len(s) else None for s in sets], pa.binary()), *[pa.array(column) for column in sketches.T]],
                names=["doc_id", "th", "n", "cls", *SKETCH])

    return rows.mapInArrow(run, "doc_id long, th long, n long, cls binary, " + ", ".join(f"{s} long" for s in SKETCH))


def _keys(rows: DataFrame, n: int, share: int) -> DataFrame:
    """(key, cls) of every set; a class that a task has just seen is not repeated."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in common.pieces(batches):
            keys, classes, counts = [], [], []
            for text in common.text_of(batch):
                shingles = shingle_set(text, n)
                name = class_of(shingles)
                if not len(shingles) or name in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(name)
                keys.append(block_keys(shingles, share))
                classes.append(name)
                counts.append(len(keys[-1]))
            if keys:
                repeated = pa.array(classes, pa.binary()).take(pa.array(np.repeat(np.arange(len(classes)), counts)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), repeated], names=["key", "cls"])

    return rows.select("text").mapInArrow(run, "key long, cls binary")


def _near(a: str, b: str, share: int) -> Column:
    """The necessary conditions: sizes, then bits in which the short sketches differ."""
    x, y = F.col(f"{a}.n"), F.col(f"{b}.n")
    differ = sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in SKETCH[1:]),
                 F.bit_count(F.col(f"{a}.s0").bitwiseXOR(F.col(f"{b}.s0"))))
    return (100 * F.least(x, y) >= share * F.greatest(x, y)) & ((100 + share) * differ <= (100 - share) * (x + y))


def _linked(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """The pairs (src, dst) whose sets reach the share."""
    close = (pairs.alias("p").join(nodes.alias("a"), F.col("p.src") == F.col("a.cls")).join(nodes.alias("b"), F.col("p.dst") == F.col("b.cls"))
             .where(_near("a", "b", share)).select("p.src", "p.dst"))
    both = (close.join(sets.select(F.col("cls").alias("src"), F.col("shingles").alias("x")), "src")
            .join(sets.select(F.col("cls").alias("dst"), F.col("shingles").alias("y")), "dst"))
    shared = F.size(F.array_intersect("x", "y"))
    return both.where((100 + share) * shared >= share * (F.size("x") + F.size("y"))).select("src", "dst")


def _with_components(rows: DataFrame, components: DataFrame | None) -> DataFrame:
    if components is None:
        return rows.withColumn("comp", F.col("cls"))
    return (rows.join(components.select(F.col("node").alias("cls"), "component"), "cls", "left")
            .withColumn("comp", F.coalesce("component", "cls")).drop("component"))


def _open(rows: DataFrame, salt: int | None) -> DataFrame:
    """Rows of keys that still hold more than one component; with a salt also the key's pivot (cls, comp) for this round.

    What a key holds is a partial aggregate, staged, so that the join of a key with very many rows can be split.
    """
    facts = [F.min("comp").alias("lo"), F.max("comp").alias("hi")]
    if salt is not None:
        facts.append(F.min(F.struct(F.xxhash64("cls", F.lit(salt)).alias("rank"), "cls", "comp")).alias("pivot"))
    keys = common.staged(rows.groupBy("key").agg(*facts).where("lo <> hi").drop("lo", "hi"), "open-keys")
    return rows.join(keys, "key")


def _shared_keys(rows: DataFrame) -> DataFrame:
    """(key, cls) of the keys with more than one class."""
    by_key = Window.partitionBy("key")
    return rows.withColumn("lo", F.min("cls").over(by_key)).withColumn("hi", F.max("cls").over(by_key)).where("lo <> hi").select("key", "cls").distinct()


def _one_key_for_each_group(keys: DataFrame) -> DataFrame:
    """Of the keys with the same classes (by number and two 64-bit sums of their hashes) only the smallest: the others give the same pairs."""
    groups = keys.groupBy("key").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("cls")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), "cls")).alias("b"))
    chosen = groups.groupBy("size", "a", "b").agg(F.min("key").alias("key")).select("key")
    return keys.join(chosen, "key", "left_semi")


def classes_with_components(rows: DataFrame, members: DataFrame, n: int = N, share: int = SHARE) -> tuple[DataFrame | None, DataFrame | None]:
    """(node, component) of the classes that are linked with another class, and their staged shingles; null if there is no link."""
    keys = _shared_keys(_keys(rows, n, share))
    spent = [common.staged(keys, "all-keys")]
    keys = common.staged(_one_key_for_each_group(spent[0]), "keys")
    if keys.isEmpty():
        return None, None
    wanted = keys.select("cls").distinct()
    # Copies are folded before the join, so a class with very many of them is a row for each task. All firsts are of one row.
    folded = members.where("n > 0").groupBy("cls").agg(*[F.first(c).alias(c) for c in ("n", *SKETCH, "th", "doc_id")])
    nodes = common.staged(folded.join(wanted, "cls", "left_semi"), "nodes")
    sets = common.staged(_sets(rows, nodes, n), "sets")
    spent += [keys, nodes]
    nodes = nodes.drop("th", "doc_id")
    links, components = None, None
    for salt in range(PIVOT_ROUNDS):
        rest = _open(_with_components(keys, components), salt).where("comp <> pivot.comp")
        pairs = rest.select(F.least("cls", "pivot.cls").alias("src"), F.greatest("cls", "pivot.cls").alias("dst")).distinct()
        found = common.staged(_linked(pairs, nodes, sets, share), "links")
        links = found if links is None else links.unionByName(found)
        spent += [found] + ([components] if components is not None else [])
        components = joined_up(links)
    rest = common.staged(_open(_with_components(keys, components), None).join(nodes, "cls"), "rest")
    a, b = rest.alias("a"), rest.alias("b")
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.cls") < F.col("b.cls")) & (F.col("a.comp") != F.col("b.comp")) & _near("a", "b", share))
    pairs = pairs.select(F.col("a.cls").alias("src"), F.col("b.cls").alias("dst")).distinct()
    more = common.staged(_linked(pairs, nodes, sets, share), "links")
    spent += [rest, more]
    if not more.isEmpty():
        spent += [components] if components is not None else []
        components = joined_up(links.unionByName(more))
    for table in spent:  # the components are written; nothing reads these again
        common.remove(table)
    return components, sets


def _compared(sets: list[np.ndarray], first: np.ndarray, within: bool, share: int) -> np.ndarray:
    """Which sets of the first kind (rows) are linked with which of the second kind (columns); within one block, which are linked with which others."""
    sizes = np.array([len(s) for s in sets])
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    several = np.bincount(codes, minlength=len(values)) > 1  # a shingle of one set is shared by none
    number = np.cumsum(several) - 1
    kept = several[codes]
    codes, owner = number[codes[kept]], owner[kept]
    rows = np.flatnonzero(first)
    columns = rows if within else np.flatnonzero(~first)
    shared = np.zeros((len(rows), len(columns)), np.float32)
    order = np.argsort(codes, kind="stable")
    codes, owner = codes[order], owner[order]
    bounds = np.searchsorted(codes, np.arange(0, int(several.sum()) + SLICE, SLICE))
    for step, (low, high) in enumerate(zip(bounds, bounds[1:])):  # float sums of ones are exact up to 2^24 shingles a slice
        part = np.zeros((len(sets), min(SLICE, int(several.sum()) - step * SLICE)), np.float32)
        part[owner[low:high], codes[low:high] - step * SLICE] = 1
        shared += part[rows] @ part[columns].T
    linked = (100 + share) * shared.astype(np.int64) >= share * (sizes[rows][:, None] + sizes[columns][None, :])
    if within:
        np.fill_diagonal(linked, False)
    return linked


def _blocks(components: DataFrame, sets: DataFrame) -> DataFrame:
    """The classes of each component dealt into blocks, with a row for each pair of blocks that a class takes part in: component, i, j, own, cls, shingles."""
    blocks = components.groupBy("component").agg(F.ceil(F.count("*") / BLOCK_CLASSES).cast("int").alias("blocks"))
    placed = components.join(blocks, "component").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    spread = placed.select("component", F.col("node").alias("cls"), "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return spread.join(sets, "cls").select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cls", "shingles")


def _joined(components: DataFrame, sets: DataFrame, share: int, as_pairs: bool) -> DataFrame:
    """Linked pairs (src, dst) of classes, or for each class a number of its links; each pair is seen in just one pair of blocks."""
    def run(table: pa.Table) -> pa.Table:
        shingles = table["shingles"].combine_chunks()
        flat, bounds = shingles.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(shingles.value_lengths().to_numpy())])
        sets_here = [flat[a:b] for a, b in zip(bounds, bounds[1:])]
        names, own = table["cls"].combine_chunks(), table["own"].to_numpy()
        within = table["i"][0].as_py() == table["j"][0].as_py()
        first = own == table["i"][0].as_py()
        if not within and (first.all() or not first.any()):
            linked, rows, columns = np.zeros((0, 0), bool), np.empty(0, np.int64), np.empty(0, np.int64)
        else:
            linked, rows = _compared(sets_here, first, within, share), np.flatnonzero(first)
            columns = rows if within else np.flatnonzero(~first)
        if as_pairs:
            a, b = np.nonzero(np.triu(linked) if within else linked)
            return pa.table({"src": names.take(pa.array(rows[a])), "dst": names.take(pa.array(columns[b]))})
        counts = np.bincount(rows, linked.sum(1), len(own)) + (0 if within else np.bincount(columns, linked.sum(0), len(own)))
        return pa.table({"cls": names, "links": pa.array(counts.astype(np.int64))})

    schema = "src binary, dst binary" if as_pairs else "cls binary, links long"
    return _blocks(components, sets).groupBy("component", "i", "j").applyInArrow(run, schema)


def joined_up(links: DataFrame) -> DataFrame | None:
    """(node, component) of the ends of links; null without links.

    Contraction: in each round every node moves to the one of its neighbours and itself that a fresh random order puts first,
    the links are drawn between the places moved to, and loops go. A round leaves a fraction of the nodes at most on average, and
    a hub is one group of a partial aggregate and a skewed side of a join. Tables are staged in few, filled partitions.
    """
    moves, edges, spent, count = [], links, [], links.count()
    while count:
        tasks = 1 + count // ROWS_A_TASK
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))

        def order(column: str) -> Column:
            return F.struct(F.xxhash64(column, F.lit(len(moves))).alias("rank"), F.col(column).alias("to"))

        move = both.groupBy("src").agg(F.min(order("dst")).alias("first")).select("src", F.least("first", order("src"))["to"].alias("to"))
        move = common.staged(move.coalesce(tasks), "moves")
        moves.append(move)
        edges = (edges.join(move, "src").select("dst", F.col("to").alias("a")).join(move.withColumnRenamed("src", "dst"), "dst")
                 .where("a <> to").select(F.least("a", "to").alias("src"), F.greatest("a", "to").alias("dst")).distinct())
        edges = common.staged(edges.coalesce(tasks), "edges")
        spent += [move, edges]
        count = edges.count()
    if not moves:
        return None
    places = moves[0].select(F.col("src").alias("node"), F.col("to").alias("component"))
    for move in moves[1:]:
        places = places.join(move, F.col("component") == F.col("src"), "left").select("node", F.coalesce("to", "component").alias("component"))
    places = common.staged(places.coalesce(1 + links.count() // ROWS_A_TASK), "components")
    for table in spent:
        common.remove(table)
    return places


def _sets(rows: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(cls, shingles) of the wanted classes, each from one row that has it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches):
            sets = [shingle_set(text, n) for text in common.text_of(batch)]
            offsets = pa.array(np.cumsum([0, *[len(s) for s in sets]]), pa.int32())
            flat = pa.array(np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.ListArray.from_arrays(offsets, flat)], names=["cls", "shingles"])

    wanted = nodes.select("cls", "th", F.col("doc_id").alias("id"))
    found = rows.join(wanted, (rows["th"] == wanted["th"]) & rows["doc_id"].eqNullSafe(wanted["id"])).select("cls", "text")
    return found.dropDuplicates(["cls"]).mapInArrow(run, "cls binary, shingles array<long>")


def _placed(docs: DataFrame, n: int, share: int, links: bool = False) -> tuple[DataFrame, DataFrame]:
    """(members, classes): a row for each row of ``docs``, and for each class its component, the smallest ids there and in the class, and its links if wanted."""
    rows = _rows(docs)
    members = common.staged(_members(rows, n), "members")
    components, sets = classes_with_components(rows, members, n, share)
    own = members.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("row"))
    own = _with_components(own, components)
    if links and components is not None:
        counts = common.staged(_joined(components, sets, share, False).groupBy("cls").agg(F.sum("links").alias("n_links")), "counts")
        own = own.join(counts, "cls", "left")
    elif links:
        own = own.withColumn("n_links", F.lit(0).cast("long"))
    if sets is not None and links:
        common.remove(sets)
    groups = own.groupBy("comp").agg(F.min("least").alias("component_id"), F.min("row").alias("keeper"))
    kept = ["n_links"] if links else []
    return members, own.select("cls", "comp", F.col("least").alias("class_id"), *kept).join(groups, "comp").select("cls", "component_id", "keeper", "class_id", *kept)


def join(docs: DataFrame, n: int = N, share: int = SHARE) -> tuple[DataFrame, DataFrame]:
    """The whole join: (pairs, membership). Pairs (src, dst) are all linked pairs of different classes, by name; membership gives each row's doc_id and class.

    Rows with equal shingle sets are one class; a row without words has none and is in no pair. Links reach ``share`` per cent over shingles of ``n`` words.
    """
    rows = _rows(docs)
    members = common.staged(_members(rows, n), "members")
    components, sets = classes_with_components(rows, members, n, share)
    membership = members.select("doc_id", "cls")
    if components is None:
        return docs.sparkSession.createDataFrame([], "src binary, dst binary"), membership
    return _joined(components, sets, share, True), membership


def components(docs: DataFrame, n: int = N, share: int = SHARE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id that links reach, itself included), class_id, n_links.

    ``class_id`` is the smallest doc_id with the same set, ``n_links`` the number of other classes that are linked with this one.
    A null, empty or blank text has no shingles, is linked with nothing and is its own component and class. Repeated rows and equal texts are one class
    and share a component. A component of null ids only has a null id. Other columns are not read; an empty table gives
    an empty one. Components and links are exact. A block value that very many small unlinked sets share costs the square of their number in
    sketch comparisons, inside a join that passes on the close pairs only; counting the links of a component of m different sets costs m * m
    products of incidence rows, spread over pairs of blocks.
    """
    members, classes = _placed(docs, n, share, links=True)
    out = members.select("doc_id", "n", "cls").join(classes.select("cls", F.col("component_id").alias("found"), "class_id", "n_links"), "cls", "left")
    alone = F.col("n") == 0
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("found")).alias("component_id"),
                      F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def one_of_each(docs: DataFrame, n: int = N, share: int = SHARE) -> DataFrame:
    """The rows of ``docs`` that stay when each component keeps the row with its smallest id (nulls last), all columns.

    Of repeated rows with that id and text one stays. Texts without words all stay.
    """
    members, classes = _placed(docs, n, share)
    keepers = common.staged(classes.select("keeper.doc_id", "keeper.th").distinct().unionByName(
        members.where("n = 0").select("doc_id", "th").distinct()).withColumnsRenamed({"doc_id": "keep_id", "th": "keep_th"}), "keepers")
    th = next(name for name in (f"text_hash_{i}" for i in range(len(docs.columns) + 1)) if name not in docs.columns)
    marked = docs.withColumn(th, F.xxhash64(F.coalesce(docs["text"], F.lit(""))))
    kept = marked.join(keepers, (marked[th] == keepers["keep_th"]) & marked["doc_id"].cast("long").eqNullSafe(keepers["keep_id"]), "left_semi")
    blank = F.translate(F.coalesce("text", F.lit("")), common.BLANKS, "") == ""
    return kept.where(~blank).dropDuplicates(["doc_id", th]).unionByName(kept.where(blank)).drop(th)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(common.table(spark, sf_dir, "documents")).drop("class_id")


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
  ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) END AS shingles FROM w),
n AS (SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n, list_sort(shingles) AS shingles FROM s),
c AS (SELECT shingles, n, min(doc_id) AS rep FROM n WHERE n > 0 GROUP BY shingles, n),
g AS (SELECT rep, n, unnest(shingles) AS g FROM c),
p AS (SELECT a.rep AS x, b.rep AS y FROM g a JOIN g b ON a.g = b.g AND a.rep < b.rep
  AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.rep, b.rep, a.n, b.n HAVING 185 * count(*) >= 85 * (a.n + b.n)),
e AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r(node, reached) AS (SELECT rep, rep FROM c UNION SELECT r.node, e.y FROM r JOIN e ON r.reached = e.x),
k AS (SELECT node, min(reached) AS component_id FROM r GROUP BY node),
l AS (SELECT x, count(*) AS links FROM e GROUP BY x)
SELECT n.doc_id, n.n AS n_shingles, coalesce(k.component_id, n.doc_id) AS component_id, coalesce(l.links, 0) AS n_links
FROM n LEFT JOIN c ON n.shingles = c.shingles AND n.n = c.n LEFT JOIN k ON c.rep = k.node LEFT JOIN l ON c.rep = l.x
"""
