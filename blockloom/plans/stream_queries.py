"""The streaming jobs over drops derived from the given tables: each runs until its drops are read and returns what it stored."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from blockloom import schemas
from blockloom.operators import fees
from blockloom.plans.registry import query
from blockloom.session import stored as kept, work_folder
from blockloom.sources.fixtures import Fixtures
from blockloom.sources.readers import read_table
from blockloom.streaming import streams


def places(fx: Fixtures) -> tuple[str, str, str]:
    """Folders of the drops, the output and the stream's checkpoint."""
    base = f"{work_folder(fx.spark)}/stream-{uuid.uuid4().hex[:12]}"
    return f"{base}/drops", f"{base}/out", f"{base}/checkpoint"


def finish(writer) -> None:
    writer.trigger(availableNow=True).start().awaitTermination()


def fee_drops(fx: Fixtures, folder: str) -> None:
    fx.histograms.select("timestamp", F.to_json("histogram").alias("histogram")).write.json(folder)


@query("stream_fee_snapshots")
def _(fx: Fixtures) -> DataFrame:
    drops, out, checkpoint = places(fx)
    fee_drops(fx, drops)
    finish(streams.fee_snapshots(fx.spark, drops, out, checkpoint))
    stored = read_table(fx.spark, out, f"{schemas.FEE_SNAPSHOTS}, batch int")
    return stored.select("timestamp", "fast_fee", "medium_fee", "low_fee")


@query("stream_alerts")
def _(fx: Fixtures) -> DataFrame:
    """All transactions are dropped twice, in two runs of the stream; an event fires once."""
    drops, out, checkpoint = places(fx)
    columns = ["timestamp", *[c.split(" ")[0] for c in schemas.ALERT_INPUT.split(", ")]]
    rows = kept(fx.alert_input.select(*columns), "alerts")
    for _ in range(2):
        rows.write.mode("append").json(drops, compression="gzip")
        finish(streams.transaction_alerts(fx.spark, drops, out, checkpoint))
    stored = read_table(fx.spark, out, f"{schemas.ALERT_HISTORY}, event_hash string, message string, batch int")
    return stored.select("txid", "alert_type", "event_hash")


@query("stream_alerts_bounded")
def _(fx: Fixtures) -> DataFrame:
    """All transactions are dropped twice; repetitions within the span are known by the state, older ones are too late."""
    drops, out, checkpoint = places(fx)
    columns = ["timestamp", *[c.split(" ")[0] for c in schemas.ALERT_INPUT.split(", ")]]
    rows = kept(fx.alert_input.select(*columns), "alerts")
    for _ in range(2):
        rows.write.mode("append").json(drops, compression="gzip")
        finish(streams.recent_alerts(fx.spark, drops, out, checkpoint, "3 days"))
    stored = read_table(fx.spark, out, f"{schemas.ALERT_HISTORY}, event_hash string, message string, batch int")
    return stored.select("txid", "alert_type", "event_hash")


def late_drops(fx: Fixtures, folder: str, part: int) -> None:
    """Of the polls, first all but those of every sixth hour, then the ones left out, most of them too late."""
    held = F.hour("timestamp") % 6 == 0
    fx.histograms.where(held if part else ~held).select("timestamp", F.to_json("histogram").alias("histogram")).write.mode("append").json(folder)


@query("stream_late_polls")
def _(fx: Fixtures) -> DataFrame:
    drops, out, checkpoint = places(fx)
    for part in range(2):
        late_drops(fx, drops, part)
        finish(streams.late_polls(fx.spark, drops, out, checkpoint, "12 hours", "6 hours"))
    return read_table(fx.spark, out, "batch int, watermark timestamp, polls bigint, late bigint").where("polls > 0")


@query("stream_late_windows")
def _(fx: Fixtures) -> DataFrame:
    """Windows that the watermark has closed, without the polls that came too late for them."""
    drops, out, checkpoint = places(fx)
    for part in range(2):
        late_drops(fx, drops, part)
        finish(streams.store_fee_windows(streams.fee_windows(fx.spark, drops, "12 hours", "6 hours"), out, checkpoint))
    return read_table(fx.spark, out, "start timestamp, end timestamp, avg_fast_fee double, polls bigint")


@query("stream_fee_windows")
def _(fx: Fixtures) -> DataFrame:
    """Windows of six hours; those that end after the watermark are still open and not stored."""
    drops, out, checkpoint = places(fx)
    fee_drops(fx, drops)
    finish(streams.store_fee_windows(streams.fee_windows(fx.spark, drops, "1 hour", "6 hours"), out, checkpoint))
    return read_table(fx.spark, out, "start timestamp, end timestamp, avg_fast_fee double, polls bigint")


@query("stream_value_insights")
def _(fx: Fixtures) -> DataFrame:
    drops, out, checkpoint = places(fx)
    columns = [c.split(" ")[0] for c in schemas.WHALES.split(", ")]
    fx.whales.select(*columns).write.json(drops)
    finish(streams.value_insights(fx.spark, drops, f"{out}-whales", out, checkpoint))
    return fees.latest_batch(read_table(fx.spark, out, f"{schemas.VALUE_INSIGHTS}, batch int"), "generated_at").drop("batch")
