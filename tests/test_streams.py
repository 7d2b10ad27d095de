import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from blockloom import schemas
from blockloom.operators import fees
from blockloom.sources.readers import read_table
from blockloom.streaming import streams

T0 = datetime(2024, 1, 1)


def drop(folder, name, docs):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(d) for d in docs))


def poll(minutes, histogram):
    return {"timestamp": (T0 + timedelta(minutes=minutes)).isoformat(), "histogram": json.dumps(histogram)}


def finish(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def test_snapshots_equal_batch(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    drop(src, "a.json", [poll(i, [[20 + i, 400000], [5, 700000]]) for i in range(5)] + [poll(9, [])])
    finish(streams.fee_snapshots(spark, str(src), out, ck))
    drop(src, "b.json", [poll(10 + i, [[9, 100000], [3, 900000]]) for i in range(5)])
    finish(streams.fee_snapshots(spark, str(src), out, ck))
    got = spark.read.parquet(out).select("timestamp", "fast_fee", "medium_fee", "low_fee")
    batch = fees.parse_histogram(spark.read.schema(schemas.FEE_DROP).json(str(src))).where(F.size("histogram") > 0)
    want = fees.fee_percentiles(batch).select("timestamp", "fast_fee", "medium_fee", "low_fee")
    assert got.count() == 10 and got.exceptAll(want).count() == 0


def test_alerts_fire_once(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    doc = {"timestamp": T0.isoformat(), "txid": "t", "sum_btc_sent": 20.0, "sum_usd_sent": 1.5e6, "fee_per_vbyte": 50.0, "tx_in_addr": ["i"], "tx_out_addr": ["o"]}
    drop(src, "a.json", [doc, doc, {"txid": "broken"}])
    finish(streams.transaction_alerts(spark, str(src), out, ck))
    drop(src, "b.json", [doc, {**doc, "txid": "u"}])
    finish(streams.transaction_alerts(spark, str(src), out, ck))
    assert sorted(r.txid for r in spark.read.parquet(out).collect()) == ["t", "u"]


def test_windows_drop_late_rows(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    drop(src, "a.json", [poll(i * 20, [[10 + i, 2000000]]) for i in range(12)])
    finish(streams.store_fee_windows(streams.fee_windows(spark, str(src)), out, ck))
    drop(src, "b.json", [poll(1, [[99, 2000000]]), poll(600, [[7, 2000000]]), poll(900, [[7, 2000000]])])
    query = finish(streams.store_fee_windows(streams.fee_windows(spark, str(src)), out, ck))
    dropped = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    got = {r.start.hour: (r.avg_fast_fee, r.polls) for r in spark.read.parquet(out).collect()}
    assert dropped == 1 and got[0] == (11.0, 3) and got[3] == (20.0, 3)


def test_insights_follow_the_merged_table(spark, tmp_path):
    src, whales, out, ck = tmp_path / "in", str(tmp_path / "w"), str(tmp_path / "out"), str(tmp_path / "ck")

    def doc(txid, minute, sent):
        return {"txid": txid, "timestamp": (T0 + timedelta(minutes=minute)).isoformat(), "size": 1, "vsize": 100, "weight": 4,
                "fee_paid": 0.1, "fee_per_vbyte": 3.0, "total_sent": sent, "btcusd": 1.0}

    drop(src, "a.json", [doc("a", 0, 0.5), doc("b", 0, 20.0)])
    finish(streams.value_insights(spark, str(src), whales, out, ck))
    drop(src, "b.json", [doc("a", 5, 70.0), doc("c", 6, 20.0)])
    finish(streams.value_insights(spark, str(src), whales, out, ck))
    newest = fees.latest_batch(read_table(spark, out, f"{schemas.VALUE_INSIGHTS}, batch int"), "generated_at")
    got = {r.amount_range: r.transaction_count for r in newest.collect()}
    assert got == {"0-1 BTC": 0, "1-10 BTC": 0, "10-50 BTC": 2, "50-100 BTC": 1, ">100 BTC": 0}


def test_bounded_alerts_fire_once_within_the_span(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")

    def doc(txid, hours):
        return {"timestamp": (T0 + timedelta(hours=hours)).isoformat(), "txid": txid, "sum_btc_sent": 20.0, "sum_usd_sent": 1.5e6, "fee_per_vbyte": 50.0,
                "tx_in_addr": ["i"], "tx_out_addr": ["o"]}

    drop(src, "a.json", [doc("t", 0), doc("t", 1), doc("u", 30)])
    finish(streams.recent_alerts(spark, str(src), out, ck))
    drop(src, "b.json", [doc("u", 31), doc("v", 7), doc("late", 1)])  # the watermark is at hour six
    query = finish(streams.recent_alerts(spark, str(src), out, ck))
    assert sorted(r.txid for r in spark.read.parquet(out).collect()) == ["t", "u", "v"]
    assert sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"]) == 1


def test_late_polls_are_counted(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    drop(src, "a.json", [poll(i * 20, [[10 + i, 2000000]]) for i in range(12)])  # up to 3:40, watermark 2:40
    finish(streams.late_polls(spark, str(src), out, ck))
    drop(src, "b.json", [poll(1, [[99, 2000000]]), poll(119, [[9, 1]]), poll(121, [[9, 1]]), poll(600, [[7, 2000000]]), poll(5, [])])
    finish(streams.late_polls(spark, str(src), out, ck))
    drop(src, "c.json", [poll(400, [[9, 1]]), poll(541, [[9, 1]])])  # watermark 9:00
    finish(streams.late_polls(spark, str(src), out, ck))
    got = [(r.batch, r.polls, r.late) for r in read_table(spark, out, "batch int, watermark timestamp, polls bigint, late bigint").orderBy("batch").collect()]
    assert got == [(0, 12, 0), (1, 4, 2), (2, 2, 1)]
