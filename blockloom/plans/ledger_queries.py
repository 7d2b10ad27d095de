"""Queries over the ledger tables."""

from uuid import uuid4

from pyspark.sql import DataFrame, Window, functions as F

from blockloom import schemas
from blockloom.operators import balances, ledger
from blockloom.plans.jobs import Ledger
from blockloom.plans.registry import query
from blockloom.session import cut_lineage, work_folder
from blockloom.sources.fixtures import Fixtures

TX = ["txid", "block_height", "timestamp", "fee", "size", "weight", "date"]
OUT = ["txid", "vout", "address", "value", "block_height", "spent", "timestamp", "output_type"]
# Heights of the fixture are day numbers times 144; this one is the last day of 1997.
SPLIT_HEIGHT = 157_680
AT_HEIGHT = 172_800


@query("ledger_transactions")
def _(fx: Fixtures) -> DataFrame:
    """Rows with what their raw document parses back to."""
    body = F.from_json("raw_tx", schemas.TX_BODY)
    return ledger.extract_transactions(fx.blocks).withColumn("body", body).select(
        *TX, F.col("body.txid").alias("raw_txid"), F.size("body.vin").alias("raw_inputs"), F.size("body.vout").alias("raw_outputs"))


@query("ledger_outputs")
def _(fx: Fixtures) -> DataFrame:
    return ledger.extract_outputs(fx.blocks).select(*OUT)


@query("ledger_spends")
def _(fx: Fixtures) -> DataFrame:
    return ledger.extract_spends(fx.blocks)


@query("output_address")
def _(fx: Fixtures) -> DataFrame:
    return ledger.extract_outputs(fx.blocks).groupBy("output_type", "address").agg(F.count("*").alias("outputs"))


@query("address_received_delta")
def _(fx: Fixtures) -> DataFrame:
    return ledger.received_delta(fx.fresh_outputs)


@query("mark_spent")
def _(fx: Fixtures) -> DataFrame:
    return ledger.mark_spent(fx.fresh_outputs, fx.spends).select("txid", "vout", "value", "spent", "spent_in_txid")


@query("upsert_addresses")
def _(fx: Fixtures) -> DataFrame:
    deltas = ledger.received_delta(fx.fresh_outputs)
    stored = deltas.where(F.col("block_height") <= SPLIT_HEIGHT).groupBy("address").agg(
        F.sum("delta").alias("balance"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))
    return ledger.upsert_addresses(stored, deltas.where(F.col("block_height") > SPLIT_HEIGHT))


@query("price_by_day")
def _(fx: Fixtures) -> DataFrame:
    return ledger.attach_price(fx.transactions.select("txid", "timestamp"), fx.prices)


@query("outputs_from_raw")
def _(fx: Fixtures) -> DataFrame:
    return ledger.rebuild_outputs(fx.raw_transactions)


@query("spends_from_raw")
def _(fx: Fixtures) -> DataFrame:
    return ledger.rebuild_spends(fx.raw_transactions)


@query("rebuild_balances")
def _(fx: Fixtures) -> DataFrame:
    return ledger.rebuild_balances(fx.outputs)


@query("duplicate_txids")
def _(fx: Fixtures) -> DataFrame:
    return ledger.duplicate_txids(fx.outputs.select("txid"))


@query("rollback_block")
def _(fx: Fixtures) -> DataFrame:
    stored = ledger.upsert_addresses(
        fx.outputs.sparkSession.createDataFrame([], "address string, balance bigint, first_seen bigint, last_seen bigint"),
        ledger.received_delta(fx.outputs))
    newest = fx.transactions.agg(F.max("block_height")).scalar()
    tx, outs, addresses = ledger.rollback_block(fx.transactions, fx.outputs, stored, newest)
    return (
        tx.select(F.lit("tx").alias("part"), F.col("txid").alias("key"), F.col("fee").alias("value"))
        .unionByName(outs.select(F.lit("output").alias("part"), F.concat_ws(":", "txid", "vout").alias("key"),
                                 F.col("spent").cast("bigint").alias("value")))
        .unionByName(addresses.select(F.lit("address").alias("part"), F.col("address").alias("key"),
                                      F.col("balance").alias("value"))))


@query("latest_block")
def _(fx: Fixtures) -> DataFrame:
    return ledger.latest_block(fx.transactions)


@query("sync_range")
def _(fx: Fixtures) -> DataFrame:
    days = fx.blocks.select((F.col("height") / 144).cast("int").alias("height"))
    return ledger.contiguous_heights(days, latest=-1)


@query("ledger_resync")
def _(fx: Fixtures) -> DataFrame:
    """The chain is stored, its last two blocks are replaced by ones without the transactions of odd orders, and the store is brought up to date:
    received totals and spent outputs of every address."""
    days = fx.blocks.select("height").distinct().withColumn("day", F.row_number().over(Window.orderBy("height")) - 1)  # one row for each day
    blocks = cut_lineage(fx.blocks.join(days, "height").withColumn("height", F.col("day").cast("int")).drop("day"))
    last = blocks.agg(F.max("height")).first()[0]
    odd = F.filter("tx", lambda t: F.substring(t["txid"], 3, 20).cast("bigint") % 2 == 0)
    replaced = blocks.where(F.col("height") >= last - 1).withColumn("tx", odd)
    store = Ledger(fx.spark, f"{work_folder(fx.spark)}/ledger-{uuid4().hex}")
    store.sync(blocks)
    store.sync(replaced, redo=2)
    outputs = store.outputs().groupBy("address").agg(F.count("*").alias("outputs"), F.count_if("spent").alias("spent"))
    return store.received().select("address", "balance", "first_seen", "last_seen").join(outputs, "address", "left")


@query("address_balance")
def _(fx: Fixtures) -> DataFrame:
    return balances.balances(fx.outputs, fx.outputs.select("address"))


@query("address_balance_lookup")
def _(fx: Fixtures) -> DataFrame:
    return balances.lookup(ledger.rebuild_balances(fx.outputs), fx.outputs)


@query("balance_at_height")
def _(fx: Fixtures) -> DataFrame:
    return balances.balance_at(fx.outputs, fx.transactions, AT_HEIGHT)


@query("balance_history")
def _(fx: Fixtures) -> DataFrame:
    return balances.balance_history(fx.outputs, fx.transactions).select("address", "timestamp", "events", "balance")


@query("balance_history_daily")
def _(fx: Fixtures) -> DataFrame:
    return balances.balance_daily(fx.outputs, fx.transactions)


@query("daily_tx_count")
def _(fx: Fixtures) -> DataFrame:
    return balances.daily_tx_count(fx.transactions)


@query("block_summary")
def _(fx: Fixtures) -> DataFrame:
    return balances.block_summary(fx.transactions).withColumn("avg_btc_price", F.round("avg_btc_price", 4))


@query("address_history")
def _(fx: Fixtures) -> DataFrame:
    return balances.address_history(fx.outputs, fx.transactions).select(
        "address", "txid", "block_height", "timestamp", "direction", "value", "fee", "btc_price_usd")


@query("backfill_tx_timestamp")
def _(fx: Fixtures) -> DataFrame:
    return balances.backfill_timestamp(fx.tx_inputs.select("txid", "address", "sats"), fx.whales)
