"""Domain tables derived lazily from the generated order, line item and event tables.

Every method returns a plan over the whole input; nothing is sampled or cut.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from blockloom.operators import fees
from blockloom.session import dealt, stored

SATS_PER_UNIT = 500_000.0


class Fixtures:
    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # ---- ledger -------------------------------------------------------------

    @cached_property
    def transactions(self) -> DataFrame:
        ok, date = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
        vsize = (150 + ok % 600).cast("int")
        return self.table("orders").select(
            F.concat(F.lit("tx"), ok).alias("txid"),
            ok.alias("ok"),
            F.col("o_custkey").alias("custkey"),
            F.col("o_orderstatus").alias("status"),
            self._height(date).alias("block_height"),
            F.unix_timestamp(date).alias("timestamp"),
            date.alias("date"),
            (F.round(F.col("o_totalprice") * 100).cast("bigint") % 100000).alias("fee"),
            (200 + ok % 800).cast("int").alias("size"),
            vsize.alias("vsize"),
            (4 * vsize).alias("weight"),
            self._price(F.col("o_custkey")).alias("btc_price_usd"),
        )

    @staticmethod
    def _height(date: Column) -> Column:
        return (F.datediff(date, F.lit("1995-01-01")) * 144).cast("int")

    @staticmethod
    def _price(customer: Column) -> Column:
        return (20000 + customer % 50000).cast("decimal(10,2)")

    @cached_property
    def _keyed_lines(self) -> DataFrame:
        """Line items as numbers; ids and addresses are spelled out where they are used."""
        order = Window.partitionBy("ok").orderBy(
            "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
            "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus",
        )
        key = F.col("ok")
        # Lines are numbered under the name that later joins use, so these need no other deal.
        return self.table("lineitem").withColumnRenamed("l_orderkey", "ok").select(
            "ok", F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"),
            (F.row_number().over(order) - 1).cast("int").alias("vout"),
            F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("value"),
            F.lower("l_returnflag").alias("flag"),
            F.when(F.col("l_linestatus") == "F", key + 1 + F.col("l_partkey") % 97).alias("spender"),
        )

    def _spelled(self, lines: DataFrame) -> DataFrame:
        key = F.col("ok")
        address = F.when(
            F.col("supp") % 5 == 0,
            F.concat(F.lit("w"), F.col("supp"), F.lit("_"), F.floor(key / 500).cast("bigint")),
        ).otherwise(F.concat(F.lit("a"), F.col("part"), F.lit("_"), F.floor(key / 8).cast("bigint")))
        return lines.withColumns({
            "txid": F.concat(F.lit("tx"), key), "address": address, "output_type": F.concat(F.lit("script_"), F.col("flag")),
        }).drop("part", "supp", "flag")

    @cached_property
    def _lines(self) -> DataFrame:
        return self._spelled(self._keyed_lines).select("ok", "txid", "vout", "address", "value", "output_type", "spender")

    @property
    def _placed_lines(self) -> DataFrame:
        """Outputs with their block and, where there is one, the time of their spender, as numbers."""
        tx = self.transactions
        block = tx.select("ok", "custkey", F.unix_micros("date").alias("at"))
        later = tx.select(F.col("ok").alias("spender"), F.col("timestamp").alias("spent_time"))
        placed = self._keyed_lines.join(block, "ok")
        # Lines without a spender stay out of the lookup: they would all meet on the null key.
        return placed.where("spender IS NOT NULL").join(later, "spender", "left").unionByName(
            placed.where("spender IS NULL"), allowMissingColumns=True)

    def _spent(self, placed: DataFrame) -> DataFrame:
        lines = self._spelled(placed).withColumn("date", F.timestamp_micros("at")).withColumns({
            "block_height": self._height(F.col("date")), "timestamp": F.unix_timestamp("date"),
        })
        if "custkey" in placed.columns:
            lines = lines.withColumn("btc_price_usd", self._price(F.col("custkey")))
        real = F.col("spent_time") > F.col("timestamp")
        return lines.withColumn("spent", F.coalesce(real, F.lit(False))).withColumn(
            "spent_in_txid", F.when(real, F.concat(F.lit("tx"), F.col("spender")))
        )

    @cached_property
    def _spent_lines(self) -> DataFrame:
        """Outputs with their block and, where spent, their spender (a later order)."""
        return self._spent(self._placed_lines)

    @cached_property
    def _kept_lines(self) -> DataFrame:
        """The same without customer and price, stored once for readers of both sides of a transaction."""
        return self._spent(stored(self._placed_lines.drop("custkey"), "lines"))

    @cached_property
    def outputs(self) -> DataFrame:
        """Stored outputs with their spent state."""
        return self._spent_lines.select(
            "txid", "vout", "address", "value", "block_height", "spent", "timestamp",
            "btc_price_usd", "output_type", "date", "spent_in_txid",
        )

    @cached_property
    def fresh_outputs(self) -> DataFrame:
        """Outputs as loaded, before any spend is applied."""
        return self.outputs.withColumn("spent", F.lit(False)).withColumn("spent_in_txid", F.lit(None).cast("string"))

    @cached_property
    def spends(self) -> DataFrame:
        return self.outputs.where("spent").select(
            F.col("txid").alias("prev_txid"), F.col("vout").alias("prev_vout"), "spent_in_txid"
        )

    @cached_property
    def bodies(self) -> DataFrame:
        """One transaction document per order (nested arrays are bounded by the size of one transaction).

        Lists are gathered as short rows under the number of their order and written out afterwards.
        """
        def output(o: Column) -> Column:
            script = F.struct(
                F.when(o["type"] == "script_n", o["address"]).alias("address"),
                F.when(o["type"] == "script_r", F.array(o["address"])).alias("addresses"),
                o["address"].alias("asm"),
                o["type"].alias("type"),
            )
            amount = (o["value"].cast("decimal(20,0)") / F.lit(10**8).cast("decimal(10,0)")).cast("decimal(16,8)")
            return F.struct(o["n"].alias("n"), amount.alias("value"), script.alias("scriptPubKey"))

        def spend(i: Column) -> Column:
            return F.struct(F.concat(F.lit("tx"), i["ok"]).alias("txid"), i["vout"].alias("vout"))

        rows = F.struct(F.col("vout").alias("n"), "value", "address", F.col("output_type").alias("type"))
        outs = self._kept_lines.groupBy("ok").agg(F.transform(F.sort_array(F.collect_list(rows)), output).alias("vout"))
        ins = self._kept_lines.where("spent").groupBy(F.col("spender").alias("ok")).agg(
            F.sort_array(F.transform(F.collect_list(F.struct("ok", "vout")), spend)).alias("vin"))
        coinbase = F.array(F.struct(F.lit(None).cast("string").alias("txid"), F.lit(None).cast("int").alias("vout")))
        fee = (F.col("fee").cast("decimal(20,0)") / F.lit(10**8).cast("decimal(10,0)")).cast("decimal(16,8)")
        return (
            self.transactions.join(outs, "ok", "left").join(ins, "ok", "left")
            .select(
                "block_height", "timestamp", "btc_price_usd", "status", "txid",
                F.struct(
                    "txid", F.when(F.col("status") != "P", fee).alias("fee"), "size", "weight", "vsize",
                    F.coalesce("vin", coinbase).alias("vin"),
                    F.coalesce("vout", F.expr("array()").cast(
                        "array<struct<n:int,value:decimal(16,8),scriptPubKey:struct<address:string,"
                        "addresses:array<string>,asm:string,type:string>>>")).alias("vout"),
                ).alias("tx"),
            )
        )

    @cached_property
    def blocks(self) -> DataFrame:
        """Block documents, delivered in parts: a height may arrive as several documents."""
        return self.bodies.select(
            F.sha2(F.col("block_height").cast("string"), 256).alias("hash"),
            F.col("block_height").alias("height"),
            F.col("timestamp").alias("time"),
            F.array("tx").alias("tx"),
        )

    @cached_property
    def raw_transactions(self) -> DataFrame:
        """Stored transactions with their raw JSON; documents of partly filled orders are damaged."""
        text = F.to_json("tx")
        return self.bodies.select(
            "txid", "block_height", "timestamp", "btc_price_usd",
            F.when(F.col("status") == "P", F.concat(F.lit("{broken "), text)).otherwise(text).alias("raw_tx"),
        )

    @cached_property
    def prices(self) -> DataFrame:
        """Daily prices for the days on which an urgent order closed."""
        return (
            self.table("orders").where("o_orderpriority = '1-URGENT'")
            .groupBy(F.to_date("o_orderdate").alias("day"))
            .agg(F.max(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"))
            .select("day", (F.col("cents") / 100).cast("decimal(10,2)").alias("btc_price_usd"))
        )

    # ---- pending pool -------------------------------------------------------

    @cached_property
    def pool(self) -> DataFrame:
        """Unconfirmed transaction ids: every order that is not filled."""
        return self.transactions.where("status <> 'F'").select("txid")

    def _pool_time(self, day: Column, key: Column) -> Column:
        return F.timestamp_seconds(F.unix_timestamp(day) + key % 86400)

    @cached_property
    def whales(self) -> DataFrame:
        sent = self._lines.groupBy("ok").agg(F.sum("value").alias("sent"))
        return self.transactions.join(sent, "ok").select(
            "txid", "ok", "custkey", "status",
            self._pool_time(F.col("date"), F.col("ok")).alias("timestamp"),
            "size", "vsize", "weight",
            (F.col("fee") / 1e8).alias("fee_paid"),
            (F.col("fee") / F.col("vsize")).alias("fee_per_vbyte"),
            (F.col("sent") / SATS_PER_UNIT).alias("total_sent"),
            F.col("btc_price_usd").cast("double").alias("btcusd"),
        )

    @staticmethod
    def _inputs(lines: DataFrame) -> DataFrame:
        return lines.where("spent").select(
            F.col("spent_in_txid").alias("txid"), "address", (F.col("value") / SATS_PER_UNIT).alias("value"),
            F.col("value").alias("sats"), F.col("txid").alias("prev_txid"), F.col("vout").alias("prev_vout"),
            F.timestamp_seconds(F.col("spent_time") + F.col("spender") % 86400).alias("tx_timestamp"),
        )

    @staticmethod
    def _outputs(lines: DataFrame) -> DataFrame:
        return lines.select(
            "txid", "vout", "address", (F.col("value") / SATS_PER_UNIT).alias("value"), F.col("value").alias("sats"),
            F.timestamp_seconds(F.col("timestamp") + F.col("ok") % 86400).alias("tx_timestamp"),
        )

    @cached_property
    def tx_inputs(self) -> DataFrame:
        """Input rows of pending transactions, already resolved to the address they spend."""
        return self._inputs(self._spent_lines)

    @cached_property
    def tx_outputs(self) -> DataFrame:
        return self._outputs(self._spent_lines)

    @cached_property
    def kept_sides(self) -> tuple[DataFrame, DataFrame]:
        """``tx_inputs`` and ``tx_outputs`` over lines stored once, for the graph, which reads both with their places."""
        return self._inputs(self._kept_lines), self._outputs(self._kept_lines)

    @staticmethod
    def _sides(lines: DataFrame) -> DataFrame:
        """Rows of both sides for ``graph.counted_sides``, from one pass over the lines; transactions go by the number of their order."""
        given = F.struct(F.col("ok").alias("txid"), "address", F.lit(0).alias("i"), F.col("value").alias("sats"), "vout")
        taken = F.struct(F.col("spender").alias("txid"), "address", F.lit(1).alias("i"), F.lit(None).cast("bigint").alias("sats"), F.lit(None).cast("int").alias("vout"))
        return lines.select(F.inline(F.when(F.col("spent"), F.array(given, taken)).otherwise(F.array(given))))

    @property
    def side_rows(self) -> DataFrame:
        return self._sides(self._spent_lines)

    @property
    def kept_side_rows(self) -> DataFrame:
        return self._sides(self._kept_lines)

    @property
    def kept_moments(self) -> DataFrame:
        """Address and time of the rows of both sides, from one pass over stored lines, so that both rows of a line are counted before they travel."""
        given = F.timestamp_seconds(F.col("timestamp") + F.col("ok") % 86400)
        taken = F.timestamp_seconds(F.col("spent_time") + F.col("spender") % 86400)
        times = F.when(F.col("spent"), F.array(given, taken)).otherwise(F.array(given))
        return self._kept_lines.select("address", F.explode(times).alias("tx_timestamp"))

    @cached_property
    def alert_input(self) -> DataFrame:
        """Transactions with both address lists; lists are bounded by the size of one transaction."""
        def side(key: str, name: str, rows: DataFrame) -> DataFrame:
            return rows.groupBy(F.col(key).alias("ok")).agg(F.sort_array(F.collect_list("address")).alias(name))

        exchange = F.concat(F.lit("bc1q"), F.lpad(F.col("ok").cast("string"), 38, "0"))
        return (
            self.whales.join(side("ok", "outs", self._spent_lines), "ok", "left")
            .join(side("spender", "tx_in_addr", self._spent_lines.where("spent")), "ok", "left")
            .select(
                "txid", "timestamp", F.col("total_sent").alias("sum_btc_sent"),
                (F.col("total_sent") * 50000).alias("sum_usd_sent"),
                F.when(F.col("custkey") != 7, F.col("fee_per_vbyte")).alias("fee_per_vbyte"),
                F.coalesce("tx_in_addr", F.array().cast("array<string>")).alias("tx_in_addr"),
                F.when(F.col("ok") % 7 == 0, F.concat(F.array(exchange), F.col("outs")))
                .otherwise(F.col("outs")).alias("tx_out_addr"),
            )
        )

    # ---- fees ---------------------------------------------------------------

    def _levels(self, unit: str) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        return (
            self.table("events")
            .groupBy(F.date_trunc(unit, F.col("ts").cast("timestamp")).alias("timestamp"),
                     F.floor("value").cast("double").alias("fee"))
            .agg(F.sum((k + 1) * 5000).cast("double").alias("vsize"))
        )

    def _histograms(self, unit: str) -> DataFrame:
        """One histogram per poll, highest fee first (a poll has at most a few hundred fee levels)."""
        return self._levels(unit).groupBy("timestamp").agg(
            F.sort_array(F.collect_list(F.array("fee", "vsize")), asc=False).alias("histogram")
        )

    @cached_property
    def histograms(self) -> DataFrame:
        return self._histograms("hour")

    @cached_property
    def fee_history(self) -> DataFrame:
        """Hourly fees over all years of orders: highest, mean and lowest price of the orders of an hour, scaled."""
        cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
        hour = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"))
        return self.table("orders").groupBy(hour.alias("timestamp")).agg(
            (F.max(cents) / 500_000).alias("fast_fee"), (F.sum(cents).cast("double") / F.count("*") / 500_000).alias("medium_fee"),
            (F.min(cents) / 500_000).alias("low_fee"))

    @property
    def last_hour(self) -> Column:
        """Time of the newest hourly snapshot, read from the event times alone."""
        return self.table("events").select(F.date_trunc("hour", F.max(F.col("ts")).cast("timestamp"))).scalar()

    @cached_property
    def snapshots(self) -> DataFrame:
        """Stored snapshots: histogram as JSON text plus the derived fees."""
        return fees.fee_percentiles(self.histograms).withColumn("histogram", F.to_json("histogram"))

    @cached_property
    def polls(self) -> DataFrame:
        """One poll a minute over the whole event range; minutes without events are failed polls."""
        bounds = self.table("events").select(F.col("ts").cast("timestamp").alias("ts")).agg(
            F.date_trunc("minute", F.min("ts")).alias("a"), F.date_trunc("minute", F.max("ts")).alias("b"))
        ticks = bounds.select(F.explode(F.expr("sequence(a, b, INTERVAL 1 MINUTE)")).alias("timestamp"))
        return ticks.join(self._histograms("minute"), "timestamp", "left")

    @cached_property
    def predictions(self) -> DataFrame:
        """Prediction batches: one generation per day, one model per event type."""
        hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
        return (
            self.table("events")
            .groupBy(hour.alias("prediction_time"), F.col("event_type").alias("model_name"))
            .agg(F.max("value").alias("fast_fee"), F.min("value").alias("low_fee"),
                 F.max_by("value", "event_id").alias("last_fee"))
            .select("prediction_time", "model_name", "fast_fee",
                    F.when(F.col("last_fee") < 100, F.col("last_fee")).alias("medium_fee"), "low_fee",
                    F.date_trunc("day", "prediction_time").alias("generated_at"))
        )

    @cached_property
    def model_log(self) -> DataFrame:
        """When each model of each fee was last trained."""
        fee = F.element_at(F.array(F.lit("fast_fee"), F.lit("medium_fee"), F.lit("low_fee")),
                           (F.col("user_id") % 3 + 1).cast("int"))
        return (
            self.table("events").groupBy(F.col("event_type").alias("model_name"), fee.alias("fee_type"))
            .agg(F.max(F.col("ts").cast("timestamp")).alias("trained_at"))
        )

    # ---- entities and market ------------------------------------------------

    @cached_property
    def customers(self) -> DataFrame:
        """Address and customer of every output."""
        lines = dealt(self._keyed_lines.select("ok", "part", "supp", "flag"), "ok")
        return self._spelled(lines.join(self.transactions.select("ok", "custkey"), "ok")).select("address", "custkey")

    @cached_property
    def owners(self) -> DataFrame:
        """Address -> lowest customer that ever used it: a cheap stand-in for stored clusters."""
        return dealt(self.customers, "address").groupBy("address").agg(F.min("custkey").alias("owner"))

    @cached_property
    def macro(self) -> DataFrame:
        price = F.round(F.col("o_totalprice") * 100).cast("bigint")
        return (
            self.table("orders")
            .groupBy(F.col("o_orderpriority").alias("asset_symbol"), F.to_date("o_orderdate").alias("date"))
            .agg(F.min_by(price, F.col("o_orderkey")).alias("o"), F.max(price).alias("h"), F.min(price).alias("l"),
                 F.max_by(price, F.col("o_orderkey")).alias("c"), F.count("*").alias("n"))
            .select("asset_symbol", "date", *[(F.col(a) / 100).alias(b) for a, b in
                                              (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"))],
                    F.when(F.col("n") > 1, F.col("n").cast("double")).otherwise(F.lit(float("nan"))).alias("volume"))
        )
