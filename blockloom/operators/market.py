"""Daily market series per asset: increments and insert-if-new."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from blockloom.functions.columns import AsOf, moment
from blockloom.operators.tables import insert_ignore as insert_new

# Asset symbols and the ticker each is quoted under.
ASSETS = {"BTC": "BTC-USD", "DXY": "DX-Y.NYB", "SPX": "^SPX", "VIX": "^VIX", "GOLD": "GC=F", "US10Y": "^TNX"}


def latest_date(macro: DataFrame) -> DataFrame:
    return macro.groupBy("asset_symbol").agg(F.max("date").alias("latest_date"))


def increment(offered: DataFrame, stored: DataFrame, as_of: AsOf) -> DataFrame:
    """Offered rows to load: everything for an unknown asset, else the days after the last stored one, before
    the day of ``as_of`` (an end date that is itself excluded)."""
    known = offered.join(latest_date(stored), "asset_symbol", "left")
    fresh = (F.col("date") > F.col("latest_date")) & (F.col("date") < F.to_date(moment(as_of)))
    return known.where(F.col("latest_date").isNull() | fresh).drop("latest_date")


def insert_ignore(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Rows to append: new (asset, date) pairs only, with an undefined volume stored as null."""
    clean = new.withColumn("volume", F.when(~F.isnan("volume"), F.col("volume")))
    return insert_new(stored, clean, ["asset_symbol", "date"])
