"""The graph of one action stores nothing, shares its deals, and sums only pairs that may meet again; owners keep the size of their tasks."""

import datetime
import hashlib
import itertools
import os
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from blockloom.operators import entities, graph
from blockloom.plans import catalog
from blockloom.plans.jobs import AddressGraph
from blockloom.session import work_folder
from blockloom.sources.fixtures import Fixtures

DAY = datetime.datetime(1996, 1, 2)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Orders and lines whose spenders exist; an order key and a line that come twice, and null keys."""
    at = tmp_path_factory.mktemp("lines")
    orders = [(i, i % 3, "F", 10.5 + i, DAY + datetime.timedelta(days=i), "1-URGENT") for i in [*range(90), 7]] + [(None, 1, "F", 9.0, DAY, "1-URGENT")]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
                          ).write.parquet(f"{at}/orders.parquet")
    lines = [(i, i * n % 11, i % 10, n, 1.0, 5.25 * (n // 2 + 1), 0.0, 0.0, "NRA"[n % 3], "F" if n else "O", DAY) for i in range(90) for n in range(4)]
    lines += [lines[9], (None, 3, 4, 1, 1.0, 9.0, 0.0, 0.0, "N", "F", DAY), (5, None, 6, 9, 1.0, 9.0, 0.0, 0.0, "N", "F", DAY)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
                          "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(f"{at}/lineitem.parquet")
    return str(at)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(str, df.collect()))


def test_lines_are_dealt_by_order_once(spark, folder):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = plan(Fixtures(spark, folder).outputs)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "hashpartitioning(ok#" in found and "l_orderkey" not in "".join(re.findall(r"hashpartitioning\([^)]*\)", found))


def test_rows_of_both_sides_give_the_same_memberships(spark, folder):
    fx = Fixtures(spark, folder)
    want = graph.memberships(fx.tx_inputs, fx.tx_outputs)
    got = graph.counted_sides(fx.side_rows).selectExpr("concat('tx', txid) AS txid", "address", "ins", "changes")
    assert rows(got) == rows(want) and got.count() > 50


@pytest.mark.parametrize("name", ["graph_degree", "avg_neighbor_degree", "graph_sample_links", "address_graph", "edges_change"])
def test_a_graph_of_one_action_stores_nothing(spark, folder, name):
    before = set(os.listdir(work_folder(spark)))
    assert catalog.QUERIES[name](spark, folder).count() > 0
    assert set(os.listdir(work_folder(spark))) == before


def test_pairs_that_meet_often_are_summed_and_others_are_not(spark):
    """Two addresses meet in 150 transactions, more than a mask has bits; others meet in one, two, or under equal bits."""
    txs = {f"t{i}": {"hub", "pal", f"x{i % 40}", f"y{i % 7}", f"once{i}"} for i in range(150)}
    members = spark.createDataFrame([(t, a, 1, 0) for t, held in txs.items() for a in held], "txid string, address string, ins bigint, changes bigint")
    want = Counter(pair for held in txs.values() for pair in itertools.combinations(sorted(held), 2))
    by_tx = defaultdict(set)
    for t, held in txs.items():
        for a in held:
            by_tx[a].add(t)
    for keep in (True, False):
        nodes, twins = graph.twin_members(members, keep)
        got = graph.expand(graph.address_graph(graph.twin_edges(nodes)), twins, twins.select("address"))
        assert Counter({(r.source, r.target): int(r.weight) for r in got.collect()}) == want
    assert {r.address for r in twins.collect()} == set(by_tx)
    edges = graph.twin_edges(nodes)
    assert "Union" in plan(edges) and edges.count() == edges.select("src", "dst").distinct().count()


def test_a_graph_with_and_without_stored_members_is_the_same(spark, folder):
    fx = Fixtures(spark, folder)
    a, b = AddressGraph.build(*fx.kept_sides).stored(), AddressGraph.of(graph.counted_sides(fx.side_rows), keep=False)
    assert rows(a.edges) == rows(b.edges) and rows(a.twins) == rows(b.twins)


def test_owners_keep_the_number_of_tasks(spark, folder):
    fx = Fixtures(spark, folder)
    found = plan(fx.owners)
    assert len(re.findall(r"hashpartitioning\(address#\d+, 4\), REPARTITION_BY_NUM", found)) == 1
    want = {}
    for r in fx.customers.collect():
        want[r.address] = min(want.get(r.address, r.custkey), r.custkey)
    assert {r.address: r.owner for r in fx.owners.collect()} == want
    assert entities.cluster_ids(fx.owners.selectExpr("cast(owner as string) AS component", "address")).count() == len(set(want.values()))


def test_cluster_ids_bring_addresses_near_their_cluster(spark):
    """Short addresses travel, not the sums of lone members; a cluster may be spread over tasks and keeps its id in any order."""
    clusters = spark.createDataFrame([("big" if i % 3 else f"c{i % 5}", f"a{i}") for i in range(600)], "component string, address string")
    ids = entities.cluster_ids(clusters)
    assert "REBALANCE_PARTITIONS_BY_COL" in plan(ids)
    assert rows(ids) == rows(entities.cluster_ids(clusters.repartition(7).unionByName(clusters))) and ids.count() == 6


@pytest.mark.parametrize("name,kept", [("clustering_coefficient", {"graph", "degrees"}), ("address_features", {"lines", "graph", "degrees"})])
def test_features_store_one_graph_and_its_degrees(spark, folder, name, kept):
    """Edges and twins are written by one action, and memberships are not kept."""
    before = set(os.listdir(work_folder(spark)))
    assert catalog.QUERIES[name](spark, folder).count() > 0
    assert {found.split("-")[0] for found in set(os.listdir(work_folder(spark))) - before} == kept


def test_overlaps_read_compressed_columns(spark, folder):
    before = set(os.listdir(work_folder(spark)))
    catalog.QUERIES["merge_overlaps"](spark, folder).count()
    assert any(found.startswith("both-") for found in set(os.listdir(work_folder(spark))) - before)


def test_times_of_both_sides_give_the_same_activity(spark, folder):
    fx = Fixtures(spark, folder)
    now = F.lit(DAY)
    assert rows(graph.moments_activity(fx.kept_moments, now)) == rows(graph.activity(fx.tx_inputs, fx.tx_outputs, now))


def test_a_pair_of_bins_meets_in_one_cell(spark):
    """A bin visits its own cell and one of each two opposite neighbours, 14 of 27."""
    points = spark.createDataFrame([(f"p{i}", float(i % 7), float(i % 11), float(i % 13)) for i in range(300)], "address string, x double, y double, z double")
    seen = []
    real = graph.F.inline
    graph.F.inline = lambda column: seen.append(column) or real(column)
    try:
        got = graph.density_clusters(points, 1.0, columns=["x", "y", "z"]).collect()
    finally:
        graph.F.inline = real
    assert any(str(column).count("xxhash64") == 14 for column in seen) and len(got) > 0


def test_member_hashes_are_those_of_the_sorted_members(spark):
    """Clusters longer than a batch, repeated rows, members in any order, a null label and null members."""
    groups = {"big": [f"a{i * 7919 % 5000}" for i in range(5000)], "one": ["z"], None: ["q", "p"], "né": ["ü", "z", "A"]}
    every = [(c, a) for c, held in groups.items() for a in held + held[:3]] + [("one", None), ("none", None)]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "64")
    try:
        got = {r.component: (r.cluster_id, r.cluster_size) for r in entities.member_hashes(spark.createDataFrame(every, "component string, address string").repartition(5)).collect()}
    finally:
        spark.conf.set(key, old)

    def plain(members, size):
        return hashlib.sha256(",".join(sorted(members)).encode()).hexdigest()[:16], size

    assert got == {c: plain(held, len(held)) for c, held in groups.items() if c != "one"} | {"one": plain(["z"], 2), "none": plain([], 1)}
