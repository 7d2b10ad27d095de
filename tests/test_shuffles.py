"""Rows are dealt once where several steps need the same deal, and shared tables are stored once."""

import datetime
import re

from blockloom.operators import entities, graph
from blockloom.sources.fixtures import Fixtures


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_memberships_deal_rows_once(spark):
    rows = [(f"t{i % 5}", f"a{i}", i, i) for i in range(40)]
    sides = spark.createDataFrame(rows, "txid string, address string, sats bigint, vout int")
    found = plan(graph.memberships(sides, sides))
    assert set(part.split(",")[0].split("#")[0] for part in found.split("hashpartitioning(")[1:]) == {"txid"} and "hashpartitioning(txid#" in found
    assert not any(part.split(")")[0].count("#") > 1 for part in found.split("hashpartitioning(")[1:])


def test_overlaps_deal_rows_by_address(spark):
    clusters = spark.createDataFrame([("c", "a"), ("d", "a"), ("c", "b"), ("d", "b")], "component string, address string")
    found = entities.overlaps(clusters)
    assert re.search(r"hashpartitioning\(component#\d+L?, address#", plan(found)) is None
    assert [tuple(r) for r in found.collect()] == [("c", "d", 2, 1.0)]


def test_block_documents_read_lines_stored_once(spark, tmp_path):
    day = datetime.datetime(1996, 1, 2)
    orders = [(i, i % 3, "F", 10.5 + i, day + datetime.timedelta(days=i), "1-URGENT") for i in range(120)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
                          ).write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(i, i % 7, i % 10, n, 1.0, 5.25 * (n + 1), 0.0, 0.0, "NRA"[n], "F" if n else "O", day) for i in range(120) for n in range(3)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
                          "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    fx = Fixtures(spark, str(tmp_path))
    assert "Window" not in plan(fx.blocks) and fx.blocks.count() == 120
    kept, lazy = fx.kept_sides, (fx.tx_inputs, fx.tx_outputs)
    for a, b in zip(kept, lazy):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.count() > 0
    first = fx.blocks.where("tx[0].txid = 'tx7'").first()["tx"][0]
    assert [(o["n"], str(o["value"]), o["scriptPubKey"]["asm"]) for o in first["vout"]] == [(0, "0.00000525", "a0_0"), (1, "0.00001050", "a0_0"), (2, "0.00001575", "a0_0")]
