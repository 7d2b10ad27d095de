"""Alerts on large transactions: classification, thresholds, deduplication and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from blockloom.functions.columns import AsOf, event_hash, moment

# Alert thresholds in US dollars, the fee rate of a bribe, and address patterns of exchanges.
THRESHOLDS = {"WHALE_MOVE": 1_000_000, "MINER_BRIBE": 5_000_000, "EXCHANGE_FLOW": 2_000_000}
BRIBE_FEE = 1000
EXCHANGE_PATTERNS = [r"bc1q\w{38}", r"1\w{33}", r"3\w{33}"]
SIGNS = {"WHALE_MOVE": "\U0001F433", "MINER_BRIBE": "⛏️", "EXCHANGE_FLOW": "\U0001F3E6"}
REQUIRED = ["txid", "sum_btc_sent", "sum_usd_sent", "fee_per_vbyte", "tx_in_addr", "tx_out_addr"]


def complete() -> Column:
    """Whether a row has all six required fields."""
    ok = F.lit(True)
    for name in REQUIRED:
        ok = ok & F.col(name).isNotNull()
    return ok


def validate(tx: DataFrame) -> DataFrame:
    return tx.where(complete())


def alert_type() -> Column:
    """Bribe by fee rate first, then exchange flow by any receiving address, else a plain move."""
    pattern = "^(" + "|".join(EXCHANGE_PATTERNS) + ")"
    to_exchange = F.exists("tx_out_addr", lambda address: address.rlike(pattern))
    return F.when(F.col("fee_per_vbyte") > BRIBE_FEE, "MINER_BRIBE").when(to_exchange, "EXCHANGE_FLOW").otherwise("WHALE_MOVE")


def classify(tx: DataFrame) -> DataFrame:
    """Valid transactions that reach the threshold of their own type."""
    typed = validate(tx).withColumn("alert_type", alert_type())
    limit = F.lit(None).cast("double")
    for name, usd in THRESHOLDS.items():
        limit = F.when(F.col("alert_type") == name, float(usd)).otherwise(limit)
    return typed.where(F.col("sum_usd_sent") >= limit)


def with_hash(tx: DataFrame) -> DataFrame:
    return tx.withColumn("event_hash", event_hash(F.col("txid"), F.col("sum_usd_sent")))


def dedup(alerts: DataFrame, alerted: DataFrame) -> DataFrame:
    """One alert per event, without events alerted before."""
    return alerts.dropDuplicates(["event_hash"]).join(alerted.select("event_hash"), "event_hash", "left_anti")


def _number(value: Column, digits: int, grouped: bool = False) -> Column:
    text = F.format_number(value, digits)
    return text if grouped else F.replace(text, F.lit(","), F.lit(""))


def format_alert(alerts: DataFrame, as_of: AsOf) -> DataFrame:
    """Message text of each alert."""
    sign = F.lit("")
    for name, mark in SIGNS.items():
        sign = F.when(F.col("alert_type") == name, mark).otherwise(sign)
    title = F.initcap(F.replace(F.col("alert_type"), F.lit("_"), F.lit(" ")))

    def some(column: str) -> Column:
        return F.concat(F.array_join(F.slice(column, 1, 2), ", "), F.lit("..."))

    lines = [
        F.concat(sign, F.lit(" *"), title, F.lit(" Alert!* "), sign),
        F.concat(F.lit("\U0001F4B0 *"), _number(F.col("sum_btc_sent"), 2), F.lit(" BTC* ($"),
                 _number(F.col("sum_usd_sent"), 2, grouped=True), F.lit(")")),
        F.concat(F.lit("⛽ *Fee Rate:* "), _number(F.col("fee_per_vbyte"), 1), F.lit(" sat/vB")),
        F.concat(F.lit("\U0001F4E5 *From:* "), some("tx_in_addr")),
        F.concat(F.lit("\U0001F4E4 *To:* "), some("tx_out_addr")),
        F.concat(F.lit("\U0001F552 *Time:* "), F.date_format(moment(as_of), "yyyy-MM-dd HH:mm:ss")),
        F.concat(F.lit("\U0001F517 [View Transaction](https://mempool.space/tx/"), F.col("txid"), F.lit(")")),
    ]
    return alerts.withColumn("message", F.concat_ws("\n", *lines))


def alerted_rows(alerts: DataFrame, as_of: AsOf) -> DataFrame:
    return alerts.select("event_hash", moment(as_of).alias("timestamp"))


def history_rows(alerts: DataFrame, as_of: AsOf) -> DataFrame:
    return alerts.select(
        moment(as_of).alias("timestamp"), "txid", "alert_type", F.col("sum_btc_sent").alias("amount_btc"),
        F.col("sum_usd_sent").alias("amount_usd"), F.col("fee_per_vbyte").alias("fee_rate"))


def detect(tx: DataFrame, alerted: DataFrame, as_of: AsOf) -> DataFrame:
    """New alerts of a batch of transactions, with hash and message."""
    return format_alert(dedup(with_hash(classify(tx)), alerted), as_of)
