import json

import pytest

from blockloom import schemas
from blockloom.functions.columns import seconds, where_height
from blockloom.operators import balances, ledger, market, tables
from blockloom.plans.jobs import Ledger
from blockloom.sources import readers
from blockloom.sources.tables import BucketTable, SnapshotTable, append_new


def out(n, value, **script):
    return {"n": n, "value": value, "scriptPubKey": {"asm": f"asm{n}", "type": "t", **script}}


def body(txid, vin, vout, fee=None):
    doc = {"txid": txid, "size": 10, "weight": 40, "vsize": 10, "vin": vin, "vout": vout}
    return doc if fee is None else {**doc, "fee": fee}


def block(height, *txs):
    return {"hash": f"h{height}", "height": height, "time": 1_700_000_000 + 86_400 * height, "tx": list(txs)}


CHAIN = [
    block(0, body("a", [{}], [out(0, 0.29, address="x"), out(1, 2.0, addresses=["y", "z"])])),
    block(1, body("b", [{"txid": "a", "vout": 0}], [out(0, 0.2, address="x"), out(1, 0.05)], fee=0.04)),
    block(2, body("c", [{"txid": "a", "vout": 1}], [out(0, 1.5, address="w")])),
    block(4, body("d", [{}], [out(0, 9.0, address="w")])),
]


def drop(path, blocks, name="part.json"):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(json.dumps(b) for b in blocks))


@pytest.fixture()
def chain(spark, tmp_path):
    drop(tmp_path / "blocks", CHAIN)
    return readers.read_blocks(spark, str(tmp_path / "blocks"))


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_extraction(chain):
    assert rows(ledger.extract_transactions(chain), "txid", "block_height", "fee") == [("a", 0, 0), ("b", 1, 4_000_000), ("c", 2, 0), ("d", 4, 0)]
    assert rows(ledger.extract_outputs(chain), "txid", "vout", "address", "value")[:4] == [
        ("a", 0, "x", 29_000_000), ("a", 1, "y", 200_000_000), ("b", 0, "x", 20_000_000), ("b", 1, "asm1", 5_000_000)]
    assert rows(ledger.extract_spends(chain), "prev_txid", "prev_vout", "spent_in_txid") == [("a", 0, "b"), ("a", 1, "c")]


def test_repair_skips_broken_and_addressless(spark, chain):
    tx = ledger.attach_price(ledger.extract_transactions(chain), spark.createDataFrame([], "day date, btc_price_usd decimal(10,2)"))
    broken = tx.limit(1).selectExpr("'q' AS txid", "block_height", "timestamp", "fee", "size", "weight", "'{oops' AS raw_tx", "date", "btc_price_usd")
    both = tx.unionByName(broken)
    assert [r[:3] for r in rows(ledger.rebuild_outputs(both), "txid", "vout", "address")] == [
        ("a", 0, "x"), ("a", 1, "y"), ("b", 0, "x"), ("c", 0, "w"), ("d", 0, "w")]
    assert ledger.rebuild_outputs(both, ledger.extract_outputs(chain)).count() == 0
    assert ledger.rebuild_spends(both).count() == 2


def test_balances_add_up(chain):
    outs = ledger.mark_spent(ledger.extract_outputs(chain), ledger.extract_spends(chain))
    tx = ledger.extract_transactions(chain)
    assert dict(rows(balances.balances(outs), "address", "balance")) == {"x": 20_000_000, "asm1": 5_000_000, "w": 1_050_000_000}
    assert dict(rows(balances.balance_at(outs, tx, 0), "address", "balance")) == {"x": 29_000_000, "y": 200_000_000}
    assert dict(rows(balances.balance_at(outs, tx, 1), "address", "balance"))["x"] == 20_000_000
    last = {r.address: r.balance for r in balances.balance_history(outs, tx).orderBy("timestamp").collect()}
    assert last == {"x": 20_000_000, "y": 0, "asm1": 5_000_000, "w": 1_050_000_000}


def test_rollback(spark, chain):
    outs = ledger.mark_spent(ledger.extract_outputs(chain), ledger.extract_spends(chain))
    empty = spark.createDataFrame([], "address string, balance bigint, first_seen bigint, last_seen bigint")
    stored = ledger.upsert_addresses(empty, ledger.received_delta(outs))
    tx, kept, addresses = ledger.rollback_block(ledger.extract_transactions(chain), outs, stored, 1)
    assert "b" not in [r.txid for r in tx.collect()]
    assert rows(kept.where("txid = 'a'"), "vout", "spent", "spent_in_txid") == [(0, False, None), (1, True, "c")]
    assert dict(rows(addresses, "address", "balance")) == {"x": 29_000_000, "y": 200_000_000, "asm1": 0, "w": 1_050_000_000}


def test_sync_stops_at_a_gap_and_resumes(spark, tmp_path, chain):
    store = Ledger(spark, str(tmp_path / "ledger"))
    assert store.sync(chain) == (0, 2)
    assert store.latest() == 2 and store.sync(chain) is None
    drop(tmp_path / "blocks", [block(3, body("e", [{"txid": "c", "vout": 0}], [out(0, 1.0, address="x")]))], "more.json")
    assert store.sync(readers.read_blocks(spark, str(tmp_path / "blocks"))) == (3, 4)
    assert rows(store.table("transactions"), "txid") == [("a",), ("b",), ("c",), ("d",), ("e",)]
    assert dict(rows(balances.balances(store.outputs()), "address", "balance")) == {"x": 120_000_000, "asm1": 5_000_000, "w": 900_000_000}
    received = dict(rows(store.addresses.read(), "address", "balance"))
    assert received == {"x": 149_000_000, "y": 200_000_000, "asm1": 5_000_000, "w": 1_050_000_000}
    plan = where_height(store.table("outputs"), 0, 100)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(height_bucket" in plan


def test_uncommitted_range_is_ignored_and_overwritten(spark, tmp_path, chain):
    store = Ledger(spark, str(tmp_path / "ledger"))
    ledger.extract_outputs(chain).write.parquet(str(tmp_path / "ledger" / "outputs" / "first=0"))
    assert store.latest() == -1
    store.sync(chain)
    assert store.table("outputs").count() == 5


def state(store):
    outs = store.outputs().select("txid", "vout", "address", "value", "block_height", "spent", "spent_in_txid")
    return (rows(outs, *outs.columns), rows(store.table("transactions"), "txid", "block_height"),
            rows(store.received(), "address", "balance", "first_seen", "last_seen"))


def test_a_replaced_end_of_the_chain_equals_a_fresh_load(spark, tmp_path):
    """The last two blocks come again with other transactions; outputs they had spent are unspent, and totals are as if loaded once."""
    def chain_of(name, blocks):
        drop(tmp_path / name, blocks, "all.json")
        return readers.read_blocks(spark, str(tmp_path / name))

    base = [block(h, body(f"c{h}", [], [out(0, 1.0 + h, address=f"m{h}"), out(1, 0.5, address="shared")])) for h in range(5)]
    old = [block(5, body("x", [{"txid": "c1", "vout": 0}, {"txid": "c0", "vout": 1}], [out(0, 2.0, address="gone"), out(1, 1.0, address="m3")])),
           block(6, body("y", [{"txid": "x", "vout": 0}], [out(0, 1.9, address="shared")]))]
    new = [block(5, body("x2", [{"txid": "c2", "vout": 0}], [out(0, 2.5, address="fresh")])), block(6, body("y2", [{"txid": "c0", "vout": 1}], [out(0, 0.4, address="m4")])),
           block(7, body("z2", [{"txid": "x2", "vout": 0}], [out(0, 2.4, address="shared")]))]
    store, fresh = Ledger(spark, str(tmp_path / "a"), buckets=4), Ledger(spark, str(tmp_path / "b"), buckets=4)
    first, second = chain_of("old", base + old), chain_of("new", new)
    assert store.sync(first) == (0, 6) and store.sync(second, redo=2) == (5, 7) and store.latest() == 7
    assert fresh.sync(chain_of("whole", base + new)) == (0, 7)
    assert state(store) == state(fresh)
    assert "gone" not in dict(rows(store.received(), "address", "balance"))
    assert store.sync(second, redo=2) is not None and state(store) == state(fresh)  # heights 6 and 7 once more
    assert store.sync(chain_of("none", base), redo=2) is None and state(store) == state(fresh)  # documents without the end take nothing back
    assert store.retract(2) == 6 and store.latest() == 1 and store.retract(2) == 0
    again = Ledger(spark, str(tmp_path / "c"), buckets=4)
    again.sync(chain_of("short", base[:2]))
    assert state(store) == state(again)
    assert store.sync(chain_of("rest", base[2:] + new)) == (2, 7) and state(store) == state(fresh)


def test_a_merge_writes_only_the_buckets_it_touches(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), "k string, v int", ["k"], 16)
    first = spark.createDataFrame([(f"k{i}", i) for i in range(200)] + [("", -1)], table.schema)
    assert table.read().count() == 0 and table.version() is None

    def files():
        return {p: p.stat().st_mtime_ns for p in (tmp_path / "t" / "data").rglob("*.parquet")}

    def newer(stored, batch):
        return stored.join(batch.select("k"), "k", "left_anti").unionByName(batch)

    assert table.merge(first, newer) == 1 and rows(table.read(), "k", "v") == rows(first, "k", "v")
    before = files()
    batch = spark.createDataFrame([("k7", 700), ("new", 1)], table.schema)
    touched = table.touched(batch)
    assert table.merge(batch, newer) == 2 and len(touched) <= 2
    after = files()
    assert all(after[p] == t for p, t in before.items())  # nothing that was there is rewritten
    assert {int(p.parent.name.split("=")[1]) for p in after if "version=2" in str(p)} == set(touched)
    want = dict(rows(first, "k", "v")) | {"k7": 700, "new": 1}
    assert dict(rows(table.read(), "k", "v")) == want and dict(rows(table.read(before=2), "k", "v")) == dict(rows(first, "k", "v"))
    plan = table.lookup(batch)._jdf.queryExecution().executedPlan().toString()
    assert rows(table.lookup(batch), "k", "v") == [("k7", 700), ("new", 1)] and plan.count("bucket=") <= len(touched)
    gone = spark.createDataFrame([(f"k{i}", 0) for i in range(200)], table.schema)
    table.merge(gone, lambda stored, batch: stored.join(batch.select("k"), "k", "left_anti"))
    assert rows(table.read(), "k", "v") == [("", -1), ("new", 1)]
    spark.createDataFrame([("lost", 9)], table.schema).write.parquet(str(tmp_path / "t" / "data" / "version=4" / "bucket=0"))
    assert table.read().where("k = 'lost'").count() == 0  # no manifest row
    assert table.merge(spark.createDataFrame([], table.schema), newer) == 4 and table.read().count() == 2


def test_snapshot_versions(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"), "k string, v int")
    assert table.read().count() == 0
    assert table.write(spark.createDataFrame([("a", 1)], table.schema)) == 1
    assert table.write(spark.createDataFrame([("b", 2)], table.schema)) == 2
    spark.createDataFrame([("lost", 9)], table.schema).write.parquet(str(tmp_path / "t" / "data" / "version=3"))
    assert rows(table.read(), "k") == [("b",)] and rows(table.read(before=2), "k") == [("a",)]


def test_insert_ignore(spark, tmp_path):
    path, schema = str(tmp_path / "m"), schemas.MACRO
    first = spark.sql("SELECT 'BTC' AS asset_symbol, DATE'2024-01-01' AS date, 1D AS open, 1D AS high, 1D AS low, 1D AS close, double('NaN') AS volume")
    append_new(market.insert_ignore(spark.createDataFrame([], schema), first), path, schema, ["asset_symbol", "date"])
    append_new(first, path, schema, ["asset_symbol", "date"])
    got = spark.read.parquet(path).collect()
    assert len(got) == 1 and got[0].volume is None
    later = spark.sql("SELECT 'BTC' AS asset_symbol, explode(sequence(DATE'2024-01-01', DATE'2024-01-05', INTERVAL 1 DAY)) AS date")
    assert market.increment(later, spark.read.parquet(path), "2024-01-05").count() == 3
    assert tables.insert_ignore(later, later, ["date"]).count() == 0


def test_interval_texts():
    assert [seconds(t) for t in ("1H", "12H", "7D", "4W", "3d", "21 days", "6 months")] == [3600, 43200, 604800, 2419200, 259200, 1814400, 15552000]
    with pytest.raises(ValueError):
        seconds("soon")
