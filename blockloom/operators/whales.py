"""Large pending transactions: detection, inputs, behaviour of addresses and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from blockloom.functions.columns import AsOf, SATOSHI, moment, span
from blockloom.operators.stats import grouped_median
from blockloom.session import cut_lineage

# Fixed values of the behaviour rules.
MIN_TXS = 3
ANOMALY_TXS = 10
ERRATIC_RATIO = 0.3
BUSY_GAP_SECONDS = 3600
BUSY_TXS = 5
LARGE_AMOUNT = 100
# Modified z-score of Iglewicz and Hoaglin (1993).
SCORE_FACTOR = 0.6745
SCORE_LIMIT = 3.5


def unseen(pool: DataFrame, stored: DataFrame) -> DataFrame:
    """Pool transactions that are not stored yet."""
    return pool.select("txid").distinct().join(stored.select("txid"), "txid", "left_anti")


def whale_filter(outputs: DataFrame, threshold: float) -> DataFrame:
    """Transactions sending at least ``threshold`` coins in total."""
    return outputs.groupBy("txid").agg(F.sum("value").alias("total_sent")).where(F.col("total_sent") >= threshold)


def resolve_inputs(spends: DataFrame, outputs: DataFrame) -> DataFrame:
    """Address and value of every input, read from the output it spends."""
    return spends.join(
        outputs.select(F.col("txid").alias("prev_txid"), F.col("vout").alias("prev_vout"), "address", "value"),
        ["prev_txid", "prev_vout"]).select(F.col("spent_in_txid").alias("txid"), "address", "value")


def output_rows(outputs: DataFrame, kept: DataFrame) -> DataFrame:
    return outputs.join(kept.select("txid"), "txid", "left_semi")


def fee_rate(inputs: DataFrame, outputs: DataFrame, tx: DataFrame, value: str = "value", coin: int = SATOSHI) -> DataFrame:
    """Fee (inputs minus outputs) and satoshi per virtual byte; rate 0 without a size.

    ``value`` is an amount column; ``coin`` scales it to satoshi (1 when it already is).
    """
    paid = inputs.groupBy("txid").agg(F.sum(value).alias("input_sum"))
    sent = outputs.groupBy("txid").agg(F.sum(value).alias("total_sent"))
    both = tx.join(sent, "txid").join(paid, "txid", "left")
    fee = F.coalesce("input_sum", F.lit(0)) - F.col("total_sent")
    return both.withColumn("fee_paid", fee).withColumn(
        "fee_per_vbyte", F.when(F.col("vsize") > 0, F.col("fee_paid") * coin / F.col("vsize")).otherwise(0.0))


def evict(table: DataFrame, pool: DataFrame) -> DataFrame:
    """Rows of transactions that are still in the pool (mined ones drop out)."""
    return table.join(pool.select("txid"), "txid", "left_semi")


def address_points(tx: DataFrame, inputs: DataFrame) -> DataFrame:
    """One row per input row of a stored transaction: when, how much and at which fee rate."""
    facts = tx.select("txid", "timestamp", F.col("total_sent").alias("amount"), F.col("fee_per_vbyte").alias("rate"))
    return inputs.select("txid", "address").join(facts, "txid").drop("txid")


def anomaly_ratio(points: DataFrame, **medians) -> DataFrame:
    """Share of outlying (amount, rate) points per address with more than ten points.

    A point is outlying when its modified z-score exceeds 3.5 on either axis. The test multiplies instead of
    dividing, so an address whose points are mostly equal counts every other value. The busy addresses' points are
    materialised before each round of medians, because every median reads them several times.
    """
    busy = points.groupBy("address").agg(F.count("*").alias("n")).where(F.col("n") > ANOMALY_TXS)
    points_of = rows = cut_lineage(points.join(busy, "address").select("address", "n", "amount", "rate"))
    for axis in ("amount", "rate"):
        middle = grouped_median(points_of, "address", axis, f"{axis}_mid", "n", **medians)
        rows = rows.join(middle, "address").withColumn(f"{axis}_off", F.abs(F.col(axis) - F.col(f"{axis}_mid"))).drop(f"{axis}_mid")
    rows = cut_lineage(rows.select("address", "n", "amount_off", "rate_off"))
    base = rows
    for axis in ("amount", "rate"):
        rows = rows.join(grouped_median(base, "address", f"{axis}_off", f"{axis}_mad", "n", **medians), "address")
    outlying = F.lit(False)
    for axis in ("amount", "rate"):
        outlying = outlying | (SCORE_FACTOR * F.col(f"{axis}_off") > SCORE_LIMIT * F.col(f"{axis}_mad"))
    ratio = F.count_if(outlying) / F.count("*")
    return rows.groupBy("address").agg(ratio.alias("anomaly_ratio"))


def behavior(tx: DataFrame, inputs: DataFrame, **medians) -> DataFrame:
    """Behaviour label of every input address.

    The mean gap between consecutive times telescopes to (last - first) / (n - 1), so one aggregate replaces
    the ordered pass over each address.
    """
    points = address_points(tx, inputs)
    shape = points.groupBy("address").agg(
        F.count("*").alias("txs"), F.avg("amount").alias("avg_amount"),
        F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    gap = (F.unix_micros("last") - F.unix_micros("first")) / 1e6 / (F.col("txs") - 1)
    label = (
        F.when(F.col("txs") < MIN_TXS, "Insufficient Data")
        .when(F.coalesce("anomaly_ratio", F.lit(0.0)) > ERRATIC_RATIO, "Erratic")
        .when((F.col("txs") > BUSY_TXS) & (gap < BUSY_GAP_SECONDS), "Frequent Trader")
        .when(F.col("avg_amount") >= LARGE_AMOUNT, "Large Transactor")
        .otherwise("Normal")
    )
    return shape.join(anomaly_ratio(points, **medians), "address", "left").select(
        "address", "txs", label.alias("behavior_pattern"))


def behavior_of(asked: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels of asked addresses; an address without transactions has insufficient data."""
    return asked.select("address").distinct().join(labels, "address", "left").withColumn(
        "behavior_pattern", F.coalesce("behavior_pattern", F.lit("Insufficient Data")))


def whale_addresses(tx: DataFrame, inputs: DataFrame, balances: DataFrame, min_balance: float = 500,
                    coin: float = SATOSHI, min_sent: float = 10, min_rows: int = 3) -> DataFrame:
    """Addresses with more than ``min_rows`` input rows in large transactions and a balance of at least
    ``min_balance`` coins."""
    large = tx.where(F.col("total_sent") > min_sent).select("txid")
    active = inputs.join(large, "txid").groupBy("address").agg(F.count("*").alias("rows")).where(F.col("rows") > min_rows)
    rich = balances.where(F.col("balance") >= F.lit(min_balance * coin))
    return active.join(rich, "address").select("address", "rows", "balance")


def snapshot(balances: DataFrame, as_of: AsOf, coin: float = 1) -> DataFrame:
    """Balance rows to append for addresses that hold something."""
    return balances.where("balance > 0").select(
        "address", moment(as_of).alias("timestamp"), (F.col("balance") / coin).cast("double").alias("confirmed_balance"))


def top_whales(tx: DataFrame, min_btc: float = 10.0, limit: int = 100) -> DataFrame:
    if min_btc < 0:
        raise ValueError("min_btc must not be negative")
    if limit <= 0:
        raise ValueError("limit must be positive")
    columns = ["txid", "timestamp", "size", "vsize", "weight", "fee_paid", "fee_per_vbyte", "total_sent"]
    return tx.where(F.col("total_sent") >= min_btc).select(*columns).orderBy(F.desc("timestamp"), "txid").limit(limit)


def recent_whales(tx: DataFrame, days: int, as_of: AsOf) -> DataFrame:
    """Transactions of the last days with their JSON address lists parsed; if either list is unreadable, both
    come out empty."""
    text = {c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("[]")) for c in ("tx_in_addr", "tx_out_addr")}
    lists = {c: F.from_json(t, "array<string>") for c, t in text.items()}
    readable = lists["tx_in_addr"].isNotNull() & lists["tx_out_addr"].isNotNull()
    empty = F.array().cast("array<string>")
    return tx.where(F.col("timestamp") >= moment(as_of) - span(days * 86400)).withColumns(
        {c: F.when(readable, parsed).otherwise(empty) for c, parsed in lists.items()})


def top_by_value(side: DataFrame, k: int) -> DataFrame:
    return side.groupBy("address").agg(F.sum("value").alias("amount"), F.count("*").alias("rows")).orderBy(
        F.desc("amount"), "address").limit(k)


def recurring_addresses(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Addresses seen on both sides, with their rows on each side."""
    return inputs.groupBy("address").agg(F.count("*").alias("as_sender")).join(
        outputs.groupBy("address").agg(F.count("*").alias("as_receiver")), "address")


def activity_by_hour(tx: DataFrame) -> DataFrame:
    return tx.groupBy(F.hour("timestamp").alias("hour")).agg(F.count("*").alias("transactions"), F.sum("total_sent").alias("amount"))


def activity_report(tx: DataFrame, inputs: DataFrame, outputs: DataFrame, k: int = 10) -> DataFrame:
    """The whole report as (section, name, amount, rows)."""
    def part(section: str, df: DataFrame, name: str, amount, rows) -> DataFrame:
        return df.select(F.lit(section).alias("section"), F.col(name).cast("string").alias("name"),
                         amount.cast("double").alias("amount"), rows.cast("bigint").alias("rows"))

    both = recurring_addresses(inputs, outputs)
    return (
        part("top_senders", top_by_value(inputs, k), "address", F.col("amount"), F.col("rows"))
        .unionByName(part("top_receivers", top_by_value(outputs, k), "address", F.col("amount"), F.col("rows")))
        .unionByName(part("recurring", both, "address", F.lit(None), F.col("as_sender") + F.col("as_receiver")))
        .unionByName(part("by_hour", activity_by_hour(tx), "hour", F.col("amount"), F.col("transactions"))))
