"""Block documents to ledger tables, and the repair path over stored raw documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from blockloom import schemas
from blockloom.functions.columns import listed_address, output_address, to_satoshi, utc_day


def _exploded(blocks: DataFrame) -> DataFrame:
    return blocks.select("height", "time", F.explode("tx").alias("tx"))


def extract_transactions(blocks: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """One row per transaction of a block document; a missing fee counts as zero."""
    tx = _exploded(blocks).select(
        F.col("tx.txid").alias("txid"),
        F.col("height").alias("block_height"),
        F.col("time").alias("timestamp"),
        F.coalesce(to_satoshi(F.col("tx.fee")), F.lit(0)).cast("bigint").alias("fee"),
        F.col("tx.size").alias("size"),
        F.col("tx.weight").alias("weight"),
        F.to_json("tx").alias("raw_tx"),
        F.timestamp_seconds("time").alias("date"),
    )
    return attach_price(tx, prices) if prices is not None else tx


def extract_outputs(blocks: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """One row per output, unspent as loaded."""
    rows = _exploded(blocks).select("height", "time", F.col("tx.txid").alias("txid"), F.explode("tx.vout").alias("o"))
    outs = rows.select(
        "txid",
        F.col("o.n").alias("vout"),
        output_address(F.col("o.scriptPubKey")).alias("address"),
        to_satoshi(F.col("o.value")).alias("value"),
        F.col("height").alias("block_height"),
        F.lit(False).alias("spent"),
        F.col("time").alias("timestamp"),
        F.col("o.scriptPubKey.type").alias("output_type"),
        F.timestamp_seconds("time").alias("date"),
        F.lit(None).cast("string").alias("spent_in_txid"),
    )
    return attach_price(outs, prices) if prices is not None else outs


def extract_spends(blocks: DataFrame, with_height: bool = False) -> DataFrame:
    """One row per input that names a previous output; newly minted coins have none. Optionally with the height of the spending block."""
    kept = [F.col("height").alias("block_height")] if with_height else []
    rows = _exploded(blocks).select(F.col("tx.txid").alias("spent_in_txid"), *kept, F.explode("tx.vin").alias("i"))
    return _spends(rows, ["block_height"] if with_height else [])


def _spends(inputs: DataFrame, kept: list[str] | None = None) -> DataFrame:
    named = F.col("i.txid").isNotNull() & F.col("i.vout").isNotNull()
    return inputs.where(named).select(
        F.col("i.txid").alias("prev_txid"), F.col("i.vout").alias("prev_vout"), "spent_in_txid", *(kept or []))


def received_delta(outputs: DataFrame) -> DataFrame:
    """Value received per block and address, with the block time."""
    return outputs.groupBy("block_height", "address").agg(
        F.sum("value").alias("delta"), F.min("timestamp").alias("timestamp"))


def mark_spent(outputs: DataFrame, spends: DataFrame) -> DataFrame:
    """Set the spent state of outputs named by spends; earlier spent states stay.

    Spends are reduced to one row per output first, so a repeated spend never multiplies outputs.
    """
    once = spends.groupBy(F.col("prev_txid").alias("txid"), F.col("prev_vout").alias("vout")).agg(
        F.max("spent_in_txid").alias("new_spender"))
    return (
        outputs.join(once, ["txid", "vout"], "left")
        .withColumn("spent", F.col("spent") | F.col("new_spender").isNotNull())
        .withColumn("spent_in_txid", F.coalesce("new_spender", "spent_in_txid"))
        .drop("new_spender").select(*outputs.columns)
    )


def upsert_addresses(current: DataFrame, deltas: DataFrame) -> DataFrame:
    """New address snapshot: received totals add up, first_seen stays, last_seen is the newest block.

    A stored null first_seen takes the new one. One aggregate over old and new rows replaces the row-level merge.
    """
    rows = current.select("address", "balance", "first_seen", "last_seen").unionByName(
        deltas.select("address", F.col("delta").alias("balance"), F.col("timestamp").alias("first_seen"),
                      F.col("timestamp").alias("last_seen")))
    return rows.groupBy("address").agg(
        F.sum("balance").alias("balance"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
    ).withColumn("date_first_seen", F.timestamp_seconds("first_seen")).withColumn(
        "date_last_seen", F.timestamp_seconds("last_seen"))


def attach_price(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """Daily price of each block time, zero when the day has none.

    No broadcast is forced: the price table has a row per day, and the planner broadcasts it by its measured size.
    """
    return (
        rows.withColumn("day", utc_day(F.col("timestamp"))).join(prices.select("day", "btc_price_usd"), "day", "left")
        .withColumn("btc_price_usd", F.coalesce("btc_price_usd", F.lit(0).cast("decimal(10,2)"))).drop("day")
    )


def _parsed(tx: DataFrame) -> DataFrame:
    """Stored raw documents as structs; unreadable JSON gives a null body and drops out."""
    return tx.withColumn("body", F.from_json("raw_tx", schemas.TX_BODY, {"mode": "PERMISSIVE"})).where(
        F.col("body.txid").isNotNull())


def rebuild_outputs(tx: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Outputs read back from raw documents: list position as vout, rows without address skipped,
    outputs that are already stored (or repeated) ignored."""
    rows = _parsed(tx).select("txid", "block_height", "timestamp", "btc_price_usd", F.posexplode("body.vout").alias("vout", "o"))
    outs = rows.select(
        "txid", "vout", listed_address(F.col("o.scriptPubKey")).alias("address"),
        to_satoshi(F.col("o.value")).alias("value"), "block_height", "timestamp", "btc_price_usd",
    ).where("address IS NOT NULL").dropDuplicates(["txid", "vout"])
    return outs if stored is None else outs.join(stored.select("txid", "vout"), ["txid", "vout"], "left_anti")


def rebuild_spends(tx: DataFrame) -> DataFrame:
    return _spends(_parsed(tx).select(F.col("txid").alias("spent_in_txid"), F.explode("body.vin").alias("i")))


def rebuild_balances(outputs: DataFrame) -> DataFrame:
    """Balance and last activity of every address that still holds coins, in one aggregate."""
    unspent = F.when(~F.col("spent"), F.col("value"))
    return (
        outputs.groupBy("address").agg(
            F.sum(unspent).alias("balance"), F.count(unspent).alias("held"), F.max("timestamp").alias("last_seen"))
        .where("held > 0").drop("held")
    )


def duplicate_txids(tx: DataFrame, k: int = 10) -> DataFrame:
    """The k transaction ids stored most often, more than once each."""
    return tx.groupBy("txid").agg(F.count("*").alias("cnt")).where("cnt > 1").orderBy(F.desc("cnt"), "txid").limit(k)


def rollback_block(tx: DataFrame, outputs: DataFrame, addresses: DataFrame, height: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables without one height: received value is taken back and its spends are undone."""
    gone = tx.where(F.col("block_height") == height).select(F.col("txid").alias("spent_in_txid")).distinct()
    undone = gone.withColumn("undo", F.lit(True))
    rest = outputs.where(F.col("block_height") != height)
    # Outputs without a spender have nothing to undo and would all meet on the null key.
    spent = (
        rest.where("spent_in_txid IS NOT NULL").join(undone, "spent_in_txid", "left")
        .withColumn("spent", F.col("spent") & F.col("undo").isNull())
        .withColumn("spent_in_txid", F.when(F.col("undo").isNull(), F.col("spent_in_txid")))
        .drop("undo").select(*outputs.columns)
    )
    kept = spent.unionByName(rest.where("spent_in_txid IS NULL"))
    back = outputs.where(F.col("block_height") == height).groupBy("address").agg((-F.sum("value")).alias("delta"))
    balances = addresses.join(back, "address", "left").withColumn(
        "balance", F.col("balance") + F.coalesce("delta", F.lit(0))).drop("delta")
    return tx.where(F.col("block_height") != height), kept, balances


def latest_block(tx: DataFrame) -> DataFrame:
    return tx.agg(F.coalesce(F.max("block_height"), F.lit(0)).alias("latest_block"))


def contiguous_heights(blocks: DataFrame, latest: int, end: int | None = None) -> DataFrame:
    """Heights that can be stored after ``latest``: the unbroken run that starts at ``latest + 1``.

    An unbroken run is exactly the heights below the first missing one. A height h is the last of a run
    when h + 1 is absent, which an equi-join on the height set finds without a global sort.
    """
    heights = blocks.select("height").where(F.col("height") > latest)
    if end is not None:
        heights = heights.where(F.col("height") <= end)
    heights = heights.distinct()
    follows = heights.select((F.col("height") - 1).alias("height"))
    last = heights.join(follows, "height", "left_anti").agg(F.min("height")).scalar()
    first = heights.agg(F.min("height")).scalar()
    return heights.where((first == latest + 1) & (F.col("height") <= last))
