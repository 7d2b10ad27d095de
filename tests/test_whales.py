from datetime import datetime, timedelta

import pytest

from blockloom import schemas
from blockloom.operators import alerts, stats, tables, whales

T0 = datetime(2024, 1, 1)
EXCHANGE = "bc1qxy2kgdygjrsqtzq2n0yrf2493p83kkfjhx0wlh"


def tx(txid, btc, usd, fee, outs):
    return (txid, btc, usd, fee, ["input_addr_1", "input_addr_2"], outs)


def incoming(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.ALERT_INPUT)


def no_alerts(spark):
    return spark.createDataFrame([], schemas.ALERTED_EVENTS)


@pytest.mark.parametrize("row, kind", [
    (tx("t1", 20.0, 1.5e6, 50.0, ["o1", "o2"]), "WHALE_MOVE"),
    (tx("t2", 5.0, 5e6, 1500.0, ["o1"]), "MINER_BRIBE"),
    (tx("t3", 50.0, 3e6, 100.0, [EXCHANGE, "o2"]), "EXCHANGE_FLOW"),
    (tx("t5", 5.0, 5e5, 100.0, ["o1"]), None),
    (tx("t6", 5.0, 2e6, 1500.0, ["o1"]), None),
    (tx("t7", None, 2e6, 100.0, ["o1"]), None),
])
def test_types_and_thresholds(spark, row, kind):
    got = [r.alert_type for r in alerts.classify(incoming(spark, row)).collect()]
    assert got == ([kind] if kind else [])


def test_alert_once_and_history(spark):
    row = tx("t4", 25.0, 2.5e6, 100.0, ["o1"])
    fired = alerts.detect(incoming(spark, row, row), no_alerts(spark), T0)
    assert fired.count() == 1
    stored = alerts.history_rows(fired, T0).first()
    assert (stored.txid, stored.alert_type, stored.amount_btc, stored.amount_usd, stored.fee_rate) == ("t4", "WHALE_MOVE", 25.0, 2.5e6, 100.0)
    assert alerts.detect(incoming(spark, row), alerts.alerted_rows(fired, T0), T0).count() == 0
    message = fired.first().message
    assert "Whale Move Alert" in message and "*25.00 BTC* ($2,500,000.00)" in message and "input_addr_1, input_addr_2..." in message


def test_hash_depends_on_txid(spark):
    df = alerts.with_hash(incoming(spark, tx("a", 1.0, 2e6, 1.0, []), tx("a", 3.0, 2e6, 1.0, []), tx("b", 1.0, 2e6, 1.0, [])))
    hashes = [r.event_hash for r in df.collect()]
    assert hashes[0] == hashes[1] != hashes[2]


def test_fee_of_a_large_transaction(spark):
    outs = spark.createDataFrame([("w", "a", 20.0), ("w", "b", 29.5)], "txid string, address string, value double")
    ins = spark.createDataFrame([("w", "c", 50.0)], "txid string, address string, value double")
    row = whales.fee_rate(ins, outs, spark.createDataFrame([("w", 250)], "txid string, vsize int")).first()
    assert (row.fee_paid, round(row.fee_per_vbyte)) == (0.5, 200000)
    assert whales.whale_filter(outs, 30).count() == 1 and whales.whale_filter(outs, 50).count() == 0


def series(spark, start, step, minutes):
    rows = [(f"t{i}", T0 + timedelta(minutes=minutes * i), float(start + step * i), 5 + 0.5 * i) for i in range(10)]
    stored = spark.createDataFrame(rows, "txid string, timestamp timestamp, total_sent double, fee_per_vbyte double")
    return stored, stored.selectExpr("txid", "'a' AS address")


@pytest.mark.parametrize("start, step, minutes, label", [(150, 50, 60, "Large Transactor"), (50, 1, 59, "Frequent Trader"), (50, 1, 60, "Normal")])
def test_behavior(spark, start, step, minutes, label):
    assert whales.behavior(*series(spark, start, step, minutes)).first().behavior_pattern == label


def test_unknown_address(spark):
    labels = whales.behavior(*series(spark, 150, 50, 60))
    asked = spark.createDataFrame([("a",), ("z",)], "address string")
    got = {r.address: r.behavior_pattern for r in whales.behavior_of(asked, labels).collect()}
    assert got == {"a": "Large Transactor", "z": "Insufficient Data"}


def test_chunked_median_is_exact(spark):
    df = spark.sql("SELECT CAST(id % 3 AS STRING) AS k, pow(id * 7919 % 4001, 1.3) AS x FROM range(9000) UNION ALL SELECT 'e', CAST(id AS DOUBLE) FROM range(10)"
                   " UNION ALL SELECT 'same', 5.0D FROM range(50)")
    sized = df.join(df.groupBy("k").count().withColumnRenamed("count", "n"), "k")
    cold = {r.k: r.m for r in stats.grouped_median(sized, "k", "x", "m", "n").collect()}
    hot = {r.k: r.m for r in stats.grouped_median(sized, "k", "x", "m", "n", hot_rows=0).collect()}
    assert cold == pytest.approx(hot) and hot["e"] == 4.5 and hot["same"] == 5.0


def test_anomalies_take_the_hot_path_too(spark):
    rows = [("a", 1.0 + i % 5, 2.0) for i in range(40)] + [("a", 500.0, 2.0), ("a", 3.0, 90.0)]
    points = spark.createDataFrame(rows, "address string, amount double, rate double")
    plain = whales.anomaly_ratio(points).first().anomaly_ratio
    assert plain == pytest.approx(2 / 42) == whales.anomaly_ratio(points, hot_rows=1).first().anomaly_ratio


def test_whale_addresses_and_snapshot(spark):
    stored = spark.createDataFrame([(f"t{i}", 50.0) for i in range(5)], "txid string, total_sent double")
    ins = spark.createDataFrame([(f"t{i}", a) for i in range(5) for a in ("whale", "regular")], "txid string, address string")
    held = spark.createDataFrame([("whale", 5000 * 10**8), ("regular", 10 * 10**8)], "address string, balance bigint")
    found = whales.whale_addresses(stored, ins, held, min_balance=1000)
    assert [r.address for r in found.collect()] == ["whale"]
    assert whales.snapshot(found, T0, coin=10**8).first().confirmed_balance == 5000.0


def test_upsert_keeps_the_newest(spark):
    schema = "k string, ts int, v string"
    old, new = spark.createDataFrame([("a", 1, "x"), ("b", 5, "y")], schema), spark.createDataFrame([("a", 1, "z"), ("b", 4, "q"), ("c", 1, "n")], schema)
    assert sorted(map(tuple, tables.upsert_latest(old, new, "k", "ts").collect())) == [("a", 1, "z"), ("b", 5, "y"), ("c", 1, "n")]
