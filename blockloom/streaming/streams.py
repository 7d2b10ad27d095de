"""Streaming forms of the polling jobs over file drops.

Every batch is written under its batch id, so a batch that is replayed after a failure replaces its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from blockloom import schemas
from blockloom.operators import alerts, fees
from blockloom.operators.tables import upsert_latest
from blockloom.sources.readers import read_table, stream_json
from blockloom.sources.tables import BucketTable, bucket_of, write_keyed

#: Hash buckets of the stored alerts.
ALERT_BUCKETS = 32
ALERT_DROP = f"timestamp timestamp, {schemas.ALERT_INPUT}"


def fee_snapshots(spark: SparkSession, drops: str, out: str, checkpoint: str) -> DataStreamWriter:
    """Fee polls to stored snapshots. Empty or unreadable polls are not stored."""
    polls = fees.parse_histogram(stream_json(spark, drops, schemas.FEE_DROP)).where(F.size("histogram") > 0)
    derived = fees.fee_percentiles(polls).withColumn("histogram", F.to_json("histogram"))

    def store(batch: DataFrame, batch_id: int) -> None:
        write_keyed(batch, out, "batch", batch_id)

    return derived.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)


def _alert_rows(fresh: DataFrame) -> DataFrame:
    return alerts.format_alert(fresh, F.col("timestamp")).select(
        "timestamp", "txid", "alert_type", F.col("sum_btc_sent").alias("amount_btc"), F.col("sum_usd_sent").alias("amount_usd"),
        F.col("fee_per_vbyte").alias("fee_rate"), "event_hash", "message")


def transaction_alerts(spark: SparkSession, drops: str, out: str, checkpoint: str) -> DataStreamWriter:
    """Transactions to deduplicated alerts. Typing and hashing are stateless; the stored event keys of earlier
    batches keep an event from firing twice, however long ago it was, without growing stream state.

    Alerts lie in hash buckets of the event, and a batch reads those of its own events only.
    """
    typed = alerts.with_hash(alerts.classify(stream_json(spark, drops, ALERT_DROP)))
    schema = f"{schemas.ALERT_HISTORY}, event_hash string, message string"
    bucket = bucket_of(["event_hash"], ALERT_BUCKETS)

    def store(batch: DataFrame, batch_id: int) -> None:
        touched = [r[0] for r in batch.select(bucket).distinct().collect()]
        earlier = read_table(batch.sparkSession, out, f"{schema}, batch int, bucket int").where(
            (F.col("batch") < batch_id) & F.col("bucket").isin(touched)).drop("bucket")
        rows = _alert_rows(alerts.dedup(batch, earlier))
        write_keyed(rows.withColumn("bucket", bucket), out, "batch", batch_id, "bucket")

    return typed.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)


def recent_alerts(spark: SparkSession, drops: str, out: str, checkpoint: str, late: str = "1 day") -> DataStreamWriter:
    """The bounded form: an event fires once while its repetitions come within ``late`` of the newest time seen.

    The state holds the events of that span only, and rows later than it are dropped; an event that comes again after the span fires again.
    """
    typed = alerts.with_hash(alerts.classify(stream_json(spark, drops, ALERT_DROP)))
    once = typed.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["event_hash"])

    def store(batch: DataFrame, batch_id: int) -> None:
        write_keyed(_alert_rows(batch), out, "batch", batch_id)

    return once.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)


def fee_windows(spark: SparkSession, drops: str, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Mean fast fee and polls per window; rows later than the watermark are dropped and show up in the query
    progress as rows dropped by watermark."""
    polls = fees.parse_histogram(stream_json(spark, drops, schemas.FEE_DROP)).where(F.size("histogram") > 0)
    return (
        fees.fee_percentiles(polls).withWatermark("timestamp", late).groupBy(F.window("timestamp", width))
        .agg(F.avg("fast_fee").alias("avg_fast_fee"), F.count("*").alias("polls"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "avg_fast_fee", "polls")
    )


def store_fee_windows(windows: DataFrame, out: str, checkpoint: str) -> DataStreamWriter:
    return windows.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint)


def late_polls(spark: SparkSession, drops: str, out: str, checkpoint: str, late: str = "1 hour", width: str = "1 hour") -> DataStreamWriter:
    """How many polls of each batch come too late for their window: (batch, watermark, polls, late), a stored row for each batch.

    A poll is late if its window had ended by the watermark, the newest time of the batches before minus ``late``: the rows that ``fee_windows`` over
    the same drops leaves out, batch by batch.
    """
    polls = fees.parse_histogram(stream_json(spark, drops, schemas.FEE_DROP)).where(F.size("histogram") > 0)

    def store(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        earlier = read_table(session, out, "batch int, newest timestamp, watermark timestamp, polls bigint, late bigint").where(F.col("batch") < batch_id)
        mark = (earlier.agg(F.max("newest")).scalar() - F.expr(f"INTERVAL {late}")).cast("timestamp")
        rows = batch.select("timestamp", F.window("timestamp", width).alias("w")).withColumn("mark", mark)
        write_keyed(rows.agg(F.max("timestamp").alias("newest"), F.max("mark").alias("watermark"), F.count("*").alias("polls"),
                             F.count_if(F.col("w.end") <= F.col("mark")).alias("late")), out, "batch", batch_id)

    return polls.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)


def value_insights(spark: SparkSession, drops: str, whales: str, out: str, checkpoint: str) -> DataStreamWriter:
    """Merge new pending transactions into the buckets of the stored table that they touch, and append one batch of value insights over it."""
    stored = BucketTable(spark, whales, schemas.WHALES, ["txid"])

    def store(batch: DataFrame, batch_id: int) -> None:
        stored.merge(batch, lambda old, new: upsert_latest(old, new, "txid", "timestamp"), batch_id + 1)
        table = stored.read()
        insights = fees.value_insights(table, table.select(F.max("timestamp")).scalar())
        write_keyed(insights, out, "batch", batch_id)

    return stream_json(spark, drops, schemas.WHALES).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
