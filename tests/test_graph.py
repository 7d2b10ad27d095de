import hashlib
import itertools
import random
from collections import defaultdict
from datetime import datetime

import pytest

from blockloom.operators import entities, graph, patterns
from blockloom.plans.jobs import AddressGraph, ClusterStore, run_clustering, run_update

from pyspark.sql import functions as F

T0 = datetime(2024, 1, 1)
SIDE = "txid string, vout int, address string, value double, sats bigint, tx_timestamp timestamp"


def sides(spark, ins, outs):
    def frame(rows):
        return spark.createDataFrame([(t, i, a, v / 1.0, v, T0) for t, i, a, v in rows], SIDE)
    return frame(ins), frame(outs)


def sample(seed=7, txs=60):
    """Random transactions over few addresses, plus one bulk transaction of one-time addresses."""
    rng, ins, outs = random.Random(seed), [], []
    for t in range(txs):
        for i in range(rng.randint(0, 4)):
            ins.append((f"t{t}", i, f"a{rng.randint(0, 30)}", rng.randint(1, 9)))
        for i in range(rng.randint(1, 4)):
            outs.append((f"t{t}", i, f"a{rng.randint(0, 40)}", rng.randint(1, 9)))
    ins += [("bulk", i, f"once{i}", 5) for i in range(25)] + [("bulk", 25, "a1", 5)]
    outs += [("bulk", i, f"paid{i}", 1) for i in range(6)]
    return ins, outs


def brute(ins, outs):
    """All address pairs written out, by the plain rules."""
    weight, types = defaultdict(int), defaultdict(set)
    by_in, by_out = defaultdict(list), defaultdict(list)
    for t, _, a, _ in ins:
        by_in[t].append(a)
    for t, _, a, v in sorted(outs, key=lambda r: (r[0], r[1])):
        by_out[t].append((a, v))

    def add(x, y, w, kind):
        if x != y:
            weight[min(x, y), max(x, y)] += w
            types[min(x, y), max(x, y)].add(kind)

    for t, members in by_in.items():
        for x, y in itertools.combinations(members, 2):
            add(x, y, 10, "common_input")
        values = [v for _, v in by_out[t]]
        if len(values) > 1:
            top = values.index(max(values))
            for x in members:
                for i, (y, _) in enumerate(by_out[t]):
                    if i != top:
                        add(x, y, 7, "change_detection")
    return weight, types


def test_compact_graph_expands_to_every_pair(spark):
    ins, outs = sample()
    weight, types = brute(ins, outs)
    for block_nodes in (1024, 3):
        members = graph.memberships(*sides(spark, ins, outs))
        nodes, twins = graph.twin_members(members)
        edges = graph.twin_edges(nodes, block_nodes).persist()
        full = graph.address_graph(edges)
        pairs = graph.expand(full, twins, twins.select("address"))
        assert {(r.source, r.target): int(r.weight * 10) for r in pairs.collect()} == dict(weight)
        assert full.agg(F.sum("pairs")).first()[0] == len(weight)
    assert edges.count() < len(weight) / 2
    kinds = {tuple(r.types) for r in full.collect()}
    assert kinds == {tuple(sorted(k)) for k in types.values()}


def test_node_features_equal_the_plain_graph(spark):
    ins, outs = sample(11)
    weight, _ = brute(ins, outs)
    peers = defaultdict(set)
    for x, y in weight:
        peers[x].add(y)
        peers[y].add(x)
    g = AddressGraph.build(*sides(spark, ins, outs)).stored()
    got = {r.address: r for r in graph.per_address(graph.node_features(g.edges), g.twins).collect()}
    assert set(got) == set(peers)
    for a, near in peers.items():
        linked = sum(1 for x, y in itertools.combinations(sorted(near), 2) if y in peers[x])
        d = len(near)
        assert got[a].degree == d
        assert got[a].clustering_coefficient == pytest.approx(2 * linked / (d * (d - 1)) if d > 1 else 0)
        assert got[a].avg_neighbor_degree == pytest.approx(sum(len(peers[n]) for n in near) / d)


def test_degrees_without_pairs(spark):
    """Degrees and neighbours' degrees equal those of the plain graph for any width that counts as wide."""
    for seed in (3, 8):
        ins, outs = sample(seed)
        weight, _ = brute(ins, outs)
        peers = defaultdict(set)
        for x, y in weight:
            peers[x].add(y)
            peers[y].add(x)
        members = graph.memberships(*sides(spark, ins, outs)).persist()
        for wide in (1, 3, 6, 64):
            got = graph.neighbour_degrees(members, wide).collect()
            assert {r.address: r.degree for r in got} == {a: len(near) for a, near in peers.items()}
            assert {r.address: r.avg_neighbor_degree for r in got} == pytest.approx({a: sum(len(peers[n]) for n in near) / len(near) for a, near in peers.items()})


def test_a_transaction_of_very_many_addresses(spark):
    """10^5 different addresses in one transaction: 5 * 10^9 pairs, counted from about as many rows as there are addresses."""
    n = 100_000
    big = spark.range(n).select(F.lit("big").alias("txid"), F.concat(F.lit("a"), "id").alias("address"), F.lit(1).alias("ins"), F.lit(0).alias("changes"))
    own = spark.range(0, n, 2).select(F.concat(F.lit("t"), "id").alias("txid"), F.col("id")).select(
        "txid", F.explode(F.array(F.concat(F.lit("a"), "id"), F.concat(F.lit("b"), "id"))).alias("address"), F.lit(1).alias("ins"), F.lit(0).alias("changes"))
    got = graph.neighbour_degrees(big.unionByName(own)).persist()
    rows = {(r.address[0], r.degree): r["count"] for r in got.withColumn("address", F.substring("address", 1, 1)).groupBy("address", "degree").count().collect()}
    assert rows == {("a", n): n // 2, ("a", n - 1): n // 2, ("b", 1): n // 2}
    assert got.where("address = 'b0'").first().avg_neighbor_degree == n


def plain_components(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for x, y in pairs:
        a, b = find(x), find(y)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components(spark):
    rng = random.Random(3)
    pairs = [(f"n{rng.randint(0, 400):03}", f"n{rng.randint(0, 400):03}") for _ in range(260)] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(90)]
    pairs += [("hub", f"s{i}") for i in range(200)]
    df = spark.createDataFrame(pairs, "src string, dst string")
    got = {r.node: r.component for r in graph.connected_components(df).collect()}
    assert got == plain_components([p for p in pairs if p[0] != p[1]])
    assert graph.connected_components(df.limit(0)).count() == 0


def test_dictionary_is_dense_and_keeps_the_order(spark):
    values = [f"v{i * 7919 % 5000:04}" for i in range(5000)] + ["v0003", "", "é", None]
    got = {r.name: r.id for r in graph.dictionary(spark.createDataFrame([(v,) for v in values], "name string").repartition(9), "name").collect()}
    want = sorted({v for v in values if v is not None}, key=lambda v: v.encode())
    assert got == {v: i for i, v in enumerate(want)}
    assert graph.dictionary(spark.createDataFrame([], "name string"), "name").count() == 0


def test_density_clusters_equal_brute_force(spark):
    rng = random.Random(5)
    centres = [[rng.uniform(-3, 3) for _ in range(3)] for _ in range(12)]
    points = [(f"p{i:03}", *[c + rng.gauss(0, 0.25) for c in rng.choice(centres)]) for i in range(220)]
    points += [(f"same{i}", 9.0, 9.0, 9.0) for i in range(30)] + [("alone", 50.0, 50.0, 50.0)]
    columns, eps = ["x", "y", "z"], 0.6
    df = spark.createDataFrame(points, "address string, x double, y double, z double")
    got = {r.address: r.component for r in graph.density_clusters(df, eps, columns=columns).collect()}
    near = [(p[0], q[0]) for p, q in itertools.combinations(sorted(points), 2) if sum((u - v) ** 2 for u, v in zip(p[1:], q[1:])) <= eps * eps]
    want = plain_components(near)
    assert got == want and "alone" not in got and len(set(got.values())) > 3


def test_density_clusters_with_points_near_the_limit(spark):
    rng = random.Random(9)
    points = [(f"p{i:03}", *[rng.uniform(0, 6) for _ in range(3)]) for i in range(150)]
    df = spark.createDataFrame(points, "address string, x double, y double, z double")
    near = [(p[0], q[0]) for p, q in itertools.combinations(sorted(points), 2) if sum((u - v) ** 2 for u, v in zip(p[1:], q[1:])) <= 0.81]
    assert {r.address: r.component for r in graph.density_clusters(df, 0.9, columns=["x", "y", "z"]).collect()} == plain_components(near)


def test_neighbour_distances_equal_a_plain_search(spark):
    rng = random.Random(4)
    points = [tuple(rng.gauss(c, 0.02) for c in rng.choice([(0, 0, 0, 0), (3, 3, 0, 1), (0.5, 0, 9, 9)])) for _ in range(150)]
    points += [(50.0, 50.0, 50.0, 50.0), (0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 0.0), (-0.001, 0.0, 0.0, 0.0)]
    columns = ["w", "x", "y", "z"]
    df = spark.createDataFrame(points, "w double, x double, y double, z double")
    plain = sorted(set(points))
    for k in (1, 3):
        want = {p: sorted(sum((u - v) ** 2 for u, v in zip(p, q)) for q in plain if q != p)[k - 1] for p in plain}
        got = {tuple(r)[:4]: r.gap for r in graph.neighbour_distances(df, columns, k).collect()}
        assert got == pytest.approx(want) and len(got) == len(want)
        assert graph.reach(df, columns, k) == pytest.approx(sorted(want.values())[(len(want) - 1) // 2])
    assert graph.reach(df.limit(1), columns) == 0.0 and graph.reach(df.limit(0), columns) == 0.0


def test_density_clusters_with_the_median_reach(spark):
    rng = random.Random(8)
    points = [(f"p{i:03}", *[rng.choice([0, 4, 9]) + rng.gauss(0, 0.3) for _ in range(3)]) for i in range(160)]
    df = spark.createDataFrame(points, "address string, x double, y double, z double")
    gaps = {(p[0], q[0]): sum((u - v) ** 2 for u, v in zip(p[1:], q[1:])) for p, q in itertools.combinations(sorted(points), 2)}
    nearest = sorted(min(gap for pair, gap in gaps.items() if p[0] in pair) for p in points)
    want = plain_components([pair for pair, gap in gaps.items() if gap <= nearest[79]])
    got = {r.address: r.component for r in graph.density_clusters(df, columns=["x", "y", "z"]).collect()}
    assert got == want
    same = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "address string, x double")
    assert {r.address: r.component for r in graph.density_clusters(same, columns=["x"]).collect()} == {"a": "a", "b": "a", "c": "a"}


def test_links_of_crowded_bins_take_few_comparisons(spark):
    """Two bins of 10^5 distinct points each, 10^10 pairs: a link is found, or shown to be absent, with at most 2 * 10^6 comparisons."""
    n = 100_000
    axis = spark.range(n).select("id", ((F.col("id") % 317) / 317).alias("x"), ((F.col("id") / 317).cast("int") / 317).alias("y"))
    left = axis.select(F.lit("a").alias("bin"), "x", "y")
    for gap, linked in ((0.5, True), (0.4999, False)):
        right = axis.select(F.lit("b").alias("bin"), (F.col("x") + (316 / 317 + 0.5)).alias("x"), (F.col("y") + 0.0001).alias("y"))
        compared = []
        pairs = spark.createDataFrame([("a", "b")], "src string, dst string")
        found = graph.closest_links(pairs, left.unionByName(right), ["x", "y"], (gap + 1e-7) ** 2, compared=compared)
        assert (found.count() == 1) is linked and sum(compared) < 2_000_000


def test_closest_links_equal_all_pairs(spark):
    rng = random.Random(12)
    points = [(f"b{i % 7}", rng.gauss(i % 7, 0.8), rng.gauss(0, 1)) for i in range(500)]
    df = spark.createDataFrame(points, "bin string, x double, y double")
    pairs = [(f"b{i}", f"b{j}") for i in range(7) for j in range(i + 1, 7)]
    for limit in (1e-5, 1e-3, 0.1, 4.0):
        want = {(a, b) for a, b in pairs if any((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 <= limit for p in points if p[0] == a for q in points if q[0] == b)}
        for leaf in (2, 64):
            got = graph.closest_links(spark.createDataFrame(pairs, "src string, dst string"), df, ["x", "y"], limit, leaf)
            assert {tuple(r) for r in got.collect()} == want


def test_cluster_ids(spark):
    rows = [("c", f"a{i}") for i in (3, 1, 2)] + [("d", "z")]
    got = {r.component: (r.cluster_id, r.cluster_size) for r in entities.cluster_ids(spark.createDataFrame(rows, "component string, address string")).collect()}

    def plain(members):
        digests = [hashlib.sha256(m.encode()).hexdigest() for m in members]
        sums = [sum(int(d[8 * i:8 * i + 8], 16) for d in digests) for i in range(8)]
        return hashlib.sha256(",".join(map(str, [len(members), *sums])).encode()).hexdigest()[:16], len(members)

    assert got == {"c": plain(["a1", "a2", "a3"]), "d": plain(["z"])}
    big = [f"m{i}" for i in range(5000)]
    df = spark.createDataFrame([("big", m) for m in big + big[:7]], "component string, address string")
    for spreading in (1, 3):
        assert [(r.cluster_id, r.cluster_size) for r in entities.cluster_ids(df.repartition(spreading)).collect()] == [plain(big)]


def test_merge(spark):
    rows = [("a", x) for x in "1234"] + [("b", x) for x in "2345"] + [("c", x) for x in "456789"] + [("d", x) for x in "xy"]
    df = spark.createDataFrame(rows, "component string, address string")
    assert [(r.src, r.dst, r.shared) for r in entities.overlaps(df).collect()] == [("a", "b", 3)]
    groups = defaultdict(set)
    for r in entities.merge_overlaps(df).collect():
        groups[r.component].add(r.address)
    assert sorted(map(sorted, groups.values())) == [list("12345"), list("456789"), ["x", "y"]]


def test_entity_labels(spark):
    ins, outs = sides(spark, [("t1", 0, "w", 5000)], [("t2", 0, "w", 100), ("t2", 1, "r", 1)])
    members = spark.createDataFrame([("W", "w"), ("R", "r"), ("N", "nobody")], "cluster_id string, address string")
    late = {r.cluster_id: r.entity_type for r in entities.classify_entities(members, ins, outs, datetime(2024, 6, 1)).collect()}
    assert late == {"W": "dormant_whale", "R": "dormant", "N": "retail"}
    soon = {r.cluster_id: r.entity_type for r in entities.classify_entities(members, ins, outs, datetime(2024, 1, 3)).collect()}
    assert soon == {"W": "institutional", "R": "retail", "N": "retail"}


def test_incremental_growth(spark):
    ins, outs = sides(spark, [("t1", 0, "old1", 5), ("t1", 1, "new1", 5), ("t2", 0, "new1", 4), ("t2", 1, "old3", 4), ("t3", 0, "old5", 1), ("t3", 1, "old6", 1)],
                      [("t1", 0, "x", 9), ("t1", 1, "new2", 1), ("t4", 0, "z", 1)])
    held = spark.createDataFrame([("old1", "A"), ("old2", "A"), ("old3", "B"), ("old5", "C"), ("old6", "D")], "address string, cluster_id string")
    groups = defaultdict(set)
    for r in entities.update_clusters(graph.memberships(ins, outs), held).collect():
        groups[r.component].add(r.address)
    assert sorted(map(sorted, groups.values())) == [["new1", "new2", "old1", "old2", "old3"], ["old5"], ["old6"]]


def test_update_run(spark):
    """One new address is attached; several are clustered by density, and only their transactions are read."""
    held = spark.createDataFrame([("a", "A"), ("b", "A"), ("c", "B")], "address string, cluster_id string")
    ins, outs = sides(spark, [("t1", 0, "a", 5), ("t1", 1, "n", 5), ("t9", 0, "c", 1), ("t9", 1, "far", 1)], [("t1", 0, "b", 9)])
    one = spark.createDataFrame([("t1",)], "txid string")
    assert groups_of(run_update(ins, outs, one, held, F.lit(T0))) == [["a", "b", "n"]]
    pairs = [(f"u{i}", k, f"n{i}{k}", 5) for i in range(4) for k in range(2)]
    ins, outs = sides(spark, [("t1", 0, "a", 5), *pairs], [(f"u{i}", 0, "a", 9) for i in range(4)])
    fresh = spark.createDataFrame([(f"u{i}",) for i in range(4)], "txid string")
    found = groups_of(run_update(ins, outs, fresh, held, F.lit(T0), eps=0.5))
    assert found[0] == ["a", "b"] and sorted(sum(found[1:], [])) == sorted(name for _, _, name, _ in pairs)


def groups_of(clusters):
    groups = defaultdict(set)
    for r in clusters.collect():
        groups[r.component].add(r.address)
    return sorted(map(sorted, groups.values()))


def test_job_and_store(spark, tmp_path):
    ins, outs = sides(spark, *sample(2, 30))
    done = run_clustering(ins, outs, F.lit(T0), eps=0.8)
    assert done.mapping.count() == done.members.count() > 10
    store = ClusterStore(spark, str(tmp_path / "clusters"))
    assert store.store(done.mapping, done.metadata, T0) == 1
    assert store.store(done.mapping, done.metadata, T0) == 2
    assert store.mapping.read().count() == done.mapping.count()
    assert store.metadata.read().select("version").distinct().first().version == 1
    second = store.history().where("version = 2")
    assert second.count() == done.mapping.count() and second.where("cluster_id <> parent_id").count() == 0
    one = done.mapping.first().cluster_id
    assert {r.version for r in entities.evolution(store.history(), one).collect()} == {1, 2}
    with pytest.raises(ValueError):
        ClusterStore(spark, str(tmp_path / "other")).store(done.mapping, done.metadata.where("false"), T0)


def test_scaling_handles_constant_columns(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("b", 3.0, 5.0)], "address string, x double, y double")
    assert sorted(map(tuple, patterns.standardize(df, ["x", "y"]).collect())) == [("a", -1.0, 0.0), ("b", 1.0, 0.0)]
