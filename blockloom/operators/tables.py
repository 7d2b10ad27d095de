"""Key-based merges of old and new rows, shared by the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def upsert_latest(current: DataFrame, new: DataFrame, key: str, ts: str) -> DataFrame:
    """Newest row per key over old and new rows.

    ``max_by`` is a partial aggregate, so a key with very many versions is reduced before the shuffle.
    """
    rest = [c for c in current.columns if c != key]
    both = current.withColumn("__new", F.lit(0)).unionByName(new.select(*current.columns).withColumn("__new", F.lit(1)))
    row, order = F.struct(*rest), F.struct(F.col(ts), F.col("__new"))
    return both.groupBy(key).agg(F.max_by(row, order).alias("__row")).select(key, "__row.*").select(*current.columns)


def insert_ignore(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The new rows whose key is not stored yet, one per key (to be appended)."""
    return new.dropDuplicates(keys).join(current.select(*keys), keys, "left_anti")
