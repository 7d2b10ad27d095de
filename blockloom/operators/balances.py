"""Balances, histories and per-block / per-day indicators over the ledger tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from blockloom.functions.columns import utc_day


def zero() -> Column:
    return F.lit(0).cast("bigint")


def balances(outputs: DataFrame, addresses: DataFrame | None = None) -> DataFrame:
    """Unspent sum per address; asked addresses without coins get zero."""
    held = outputs.where(~F.col("spent")).groupBy("address").agg(F.sum("value").alias("balance"))
    if addresses is None:
        return held
    asked = addresses.select("address").distinct()
    return asked.join(held, "address", "left").withColumn("balance", F.coalesce("balance", zero()))


def lookup(addresses: DataFrame, asked: DataFrame) -> DataFrame:
    """Stored balance by address, zero when the address is unknown."""
    return asked.select("address").distinct().join(addresses.select("address", "balance"), "address", "left").withColumn(
        "balance", F.coalesce("balance", zero()))


def _spender(tx: DataFrame, *columns: Column) -> DataFrame:
    """Spending transactions, one row per id: the ledger may hold a transaction twice."""
    return tx.groupBy(F.col("txid").alias("spent_in_txid")).agg(*columns)


def balance_at(outputs: DataFrame, tx: DataFrame, height: int | Column) -> DataFrame:
    """Balance of every address as of a height: created up to it and not spent up to it.

    Only outputs with a spender look one up; the others would all meet on the null key.
    """
    spent_at = _spender(tx, F.min("block_height").alias("spent_height"))
    columns = ["address", "value", "spent", "spent_in_txid"]
    created = outputs.where(F.col("block_height") <= height).select(*columns)
    looked_up = created.where("spent_in_txid IS NOT NULL").join(spent_at, "spent_in_txid", "left").select(*columns, "spent_height")
    live = looked_up.unionByName(created.where("spent_in_txid IS NULL"), allowMissingColumns=True)
    counts = ~F.col("spent") | (F.col("spent_height") > height)
    return live.groupBy("address").agg(F.coalesce(F.sum(F.when(counts, F.col("value"))), zero()).alias("balance"))


def balance_changes(outputs: DataFrame, tx: DataFrame) -> DataFrame:
    """Credits at creation and debits at spending, one row each."""
    credits = outputs.select("address", "timestamp", "value")
    debits = (
        outputs.where("spent").select("address", "value", "spent_in_txid")
        .join(_spender(tx, F.min("timestamp").alias("timestamp")), "spent_in_txid")
        .select("address", "timestamp", (-F.col("value")).alias("value"))
    )
    return credits.unionByName(debits)


def balance_history(outputs: DataFrame, tx: DataFrame) -> DataFrame:
    """Running balance per address and time. Events of one time share a balance, so they form one row
    with their number.

    Two levels keep a busy address off a single task: net change per day, running sum of the days,
    then the running sum inside each (address, day) on top of the day's opening balance.
    """
    steps = (
        balance_changes(outputs, tx).groupBy("address", "timestamp")
        .agg(F.sum("value").alias("net"), F.count("*").alias("events"))
        .withColumn("day", utc_day(F.col("timestamp")))
    )
    days = steps.groupBy("address", "day").agg(F.sum("net").alias("day_net"))
    by_day = Window.partitionBy("address").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    opening = days.select("address", "day", F.coalesce(F.sum("day_net").over(by_day), zero()).alias("opening"))
    inside = Window.partitionBy("address", "day").orderBy("timestamp").rowsBetween(Window.unboundedPreceding, 0)
    return steps.join(opening, ["address", "day"]).select(
        "address", "timestamp", "day", "events", (F.col("opening") + F.sum("net").over(inside)).alias("balance"))


def balance_daily(outputs: DataFrame, tx: DataFrame) -> DataFrame:
    """Closing balance per address and day with activity (an address has at most one row per calendar day)."""
    days = balance_changes(outputs, tx).groupBy("address", utc_day(F.col("timestamp")).alias("day")).agg(
        F.sum("value").alias("net"))
    running = Window.partitionBy("address").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return days.select("address", "day", F.sum("net").over(running).alias("balance"))


def daily_tx_count(tx: DataFrame) -> DataFrame:
    return tx.groupBy(F.date_format(F.timestamp_seconds("timestamp"), "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("tx_count"))


def block_summary(tx: DataFrame, height: int | None = None) -> DataFrame:
    rows = tx if height is None else tx.where(F.col("block_height") == height)
    return rows.groupBy("block_height").agg(
        F.min("timestamp").alias("block_time"), F.count("*").alias("tx_count"),
        F.sum("fee").alias("total_fees"), F.avg("btc_price_usd").alias("avg_btc_price"))


def address_history(outputs: DataFrame, tx: DataFrame, addresses: DataFrame | None = None) -> DataFrame:
    """Receipts and spends of the asked addresses (all by default), spends with negative value.

    Order by ``timestamp`` descending to read it newest first. Every stored copy of a transaction joins, as
    in a plain inner join.
    """
    outs = outputs if addresses is None else outputs.join(addresses.select("address").distinct(), "address", "left_semi")
    facts = tx.select("txid", "block_height", "timestamp", "fee", "btc_price_usd")
    received = outs.select("txid", "address", "value").join(facts, "txid").withColumn("direction", F.lit("in"))
    sent = (
        outs.where(F.col("spent_in_txid").isNotNull())
        .select(F.col("spent_in_txid").alias("txid"), "address", (-F.col("value")).alias("value"))
        .join(facts, "txid").withColumn("direction", F.lit("out"))
    )
    return received.unionByName(sent)


def backfill_timestamp(child: DataFrame, parent: DataFrame) -> DataFrame:
    """Copy the parent transaction's time to its input or output rows (null without a parent)."""
    times = parent.groupBy("txid").agg(F.max("timestamp").alias("tx_timestamp"))
    return child.drop("tx_timestamp").join(times, "txid", "left")
