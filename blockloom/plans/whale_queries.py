"""Queries over large pending transactions, alerts and market series."""

from pyspark.sql import DataFrame, functions as F

from blockloom.functions.columns import newest
from blockloom.operators import alerts, balances, market, tables, whales
from blockloom.operators.tables import insert_ignore
from blockloom.plans.registry import query
from blockloom.sources.fixtures import SATS_PER_UNIT, Fixtures

WHALE_COLUMNS = ["txid", "timestamp", "size", "vsize", "weight", "fee_paid", "fee_per_vbyte", "total_sent", "btcusd"]
THRESHOLD = 50
MIN_BTC = 10


def kept(fx: Fixtures) -> DataFrame:
    return whales.whale_filter(fx.tx_outputs, THRESHOLD)


@query("unseen_txids")
def _(fx: Fixtures) -> DataFrame:
    return whales.unseen(fx.pool, kept(fx))


@query("whale_filter")
def _(fx: Fixtures) -> DataFrame:
    return kept(fx)


@query("resolve_inputs")
def _(fx: Fixtures) -> DataFrame:
    return whales.resolve_inputs(fx.spends, fx.tx_outputs)


@query("whale_output_rows")
def _(fx: Fixtures) -> DataFrame:
    return whales.output_rows(fx.tx_outputs, kept(fx)).select("txid", "address", "value")


@query("tx_fee_rate")
def _(fx: Fixtures) -> DataFrame:
    return whales.fee_rate(fx.tx_inputs, fx.tx_outputs, fx.whales.select("txid", "vsize"), value="sats", coin=1).select(
        "txid", "vsize", "fee_paid", "fee_per_vbyte")


@query("whale_upsert")
def _(fx: Fixtures) -> DataFrame:
    """Open transactions are polled again a minute later at a higher fee."""
    stored = fx.whales.select(*WHALE_COLUMNS)
    again = fx.whales.where("status = 'O'").select(*WHALE_COLUMNS).withColumns({
        "timestamp": F.col("timestamp") + F.expr("INTERVAL 1 MINUTE"), "fee_paid": F.col("fee_paid") + 1})
    return tables.upsert_latest(stored, again, "txid", "timestamp").select(
        "txid", "timestamp", "size", F.round(F.col("fee_paid") * 1e8).cast("bigint").alias("fee_sats"), "total_sent")


@query("evict_mined")
def _(fx: Fixtures) -> DataFrame:
    parts = {"whales": fx.whales, "inputs": fx.tx_inputs, "outputs": fx.tx_outputs}
    left = [whales.evict(t, fx.pool).groupBy("txid").agg(F.count("*").alias("rows")).withColumn("part", F.lit(name))
            for name, t in parts.items()]
    return left[0].unionByName(left[1]).unionByName(left[2])


@query("whale_behavior")
def _(fx: Fixtures) -> DataFrame:
    return whales.behavior(fx.whales, fx.tx_inputs)


@query("tx_anomaly_ratio")
def _(fx: Fixtures) -> DataFrame:
    return whales.anomaly_ratio(whales.address_points(fx.whales, fx.tx_inputs))


@query("whale_addresses")
def _(fx: Fixtures) -> DataFrame:
    return whales.whale_addresses(fx.whales, fx.tx_inputs, balances.balances(fx.outputs), min_balance=1, coin=SATS_PER_UNIT)


@query("whale_balance_snapshot")
def _(fx: Fixtures) -> DataFrame:
    return whales.snapshot(balances.balances(fx.outputs), newest(fx.whales), coin=SATS_PER_UNIT)


@query("whale_transactions_top")
def _(fx: Fixtures) -> DataFrame:
    return whales.top_whales(fx.whales, MIN_BTC, 1000).withColumn("fee_paid", F.round(F.col("fee_paid") * 1e8).cast("bigint"))


@query("recent_whales_parsed")
def _(fx: Fixtures) -> DataFrame:
    """Address lists as stored JSON; transactions without inputs hold an unreadable list."""
    stored = fx.alert_input.select(
        "txid", "timestamp", "sum_btc_sent",
        F.when(F.size("tx_in_addr") == 0, "[broken").otherwise(F.to_json("tx_in_addr")).alias("tx_in_addr"),
        F.to_json("tx_out_addr").alias("tx_out_addr"))
    return whales.recent_whales(stored, 30, newest(stored))


@query("whale_activity_report")
def _(fx: Fixtures) -> DataFrame:
    return whales.activity_report(fx.whales, fx.tx_inputs, fx.tx_outputs)


@query("alert_classify")
def _(fx: Fixtures) -> DataFrame:
    return alerts.classify(fx.alert_input).select("txid", "alert_type", "sum_usd_sent", "fee_per_vbyte")


@query("alert_validate")
def _(fx: Fixtures) -> DataFrame:
    return fx.alert_input.groupBy(alerts.complete().alias("valid")).agg(F.count("*").alias("rows"))


@query("alert_event_hash")
def _(fx: Fixtures) -> DataFrame:
    return alerts.with_hash(fx.alert_input).select("txid", "event_hash")


@query("alert_dedup")
def _(fx: Fixtures) -> DataFrame:
    """Every transaction arrives twice; open ones were alerted before."""
    typed = alerts.with_hash(alerts.classify(fx.alert_input))
    before = alerts.with_hash(fx.alert_input).join(fx.whales.where("status = 'O'").select("txid"), "txid", "left_semi")
    return alerts.dedup(typed.unionByName(typed), before).select("txid", "alert_type", "event_hash")


@query("alert_message")
def _(fx: Fixtures) -> DataFrame:
    return alerts.format_alert(alerts.classify(fx.alert_input), newest(fx.alert_input)).select("txid", "message")


@query("market_latest_date")
def _(fx: Fixtures) -> DataFrame:
    return market.latest_date(fx.macro)


def stored_market(fx: Fixtures) -> DataFrame:
    """What an earlier load left: all assets but one, up to the end of 1999."""
    return fx.macro.where("date <= DATE'1999-12-31' AND asset_symbol <> '5-LOW'")


@query("market_increment")
def _(fx: Fixtures) -> DataFrame:
    return market.increment(fx.macro, stored_market(fx), newest(fx.transactions, "date")).select("asset_symbol", "date", "close")


@query("market_insert_ignore")
def _(fx: Fixtures) -> DataFrame:
    return market.insert_ignore(stored_market(fx), fx.macro)


@query("behavior_upsert")
def _(fx: Fixtures) -> DataFrame:
    """Newest label per key, with event types as labels of users: views are stored, the rest is new."""
    labels = fx.table("events").select(
        F.col("user_id").cast("string").alias("address"), F.col("event_type").alias("behavior_pattern"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("last_updated"))
    is_view = F.col("behavior_pattern") == "view"
    return tables.upsert_latest(labels.where(is_view), labels.where(~is_view), "address", "last_updated")


@query("alert_history")
def _(fx: Fixtures) -> DataFrame:
    """The history after an append: all alerts are offered while those of filled orders are stored."""
    offered = alerts.history_rows(alerts.classify(fx.alert_input), newest(fx.whales))
    stored = offered.join(fx.whales.where("status = 'F'").select("txid"), "txid", "left_semi").select(*offered.columns)
    return stored.unionByName(insert_ignore(stored, offered, ["txid", "alert_type"]))
