"""Exact grouped statistics that keep a very large group off a single task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

HOT_ROWS = 1_000_000
CHUNKS = 256


def grouped_median(rows: DataFrame, key: str, column: str, out: str, size: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Exact median of ``column`` (no nulls) per key; ``size`` names a column with the row count of the key.

    Small groups use the built-in percentile. A group with more than ``hot_rows`` rows is cut into value
    chunks at mergeable approximate quantiles; chunk counts locate the middle ranks, and only the one or two
    chunks that hold them are ordered. The approximation only places the cuts, the result is exact.
    """
    sized = rows.select(key, column, F.col(size).alias("__n"))
    small = sized.where(F.col("__n") <= hot_rows).groupBy(key).agg(F.percentile(column, 0.5).alias(out))
    return small.unionByName(_chunked_median(sized.where(F.col("__n") > hot_rows), key, column, out))


def _chunked_median(rows: DataFrame, key: str, column: str, out: str) -> DataFrame:
    points = F.array(*[F.lit(i / CHUNKS) for i in range(1, CHUNKS)])
    cuts = rows.groupBy(key).agg(F.approx_percentile(column, points, F.lit(CHUNKS * 20)).alias("__cuts"))
    values = rows.groupBy(key, column).agg(F.count("*").alias("__c"), F.max("__n").alias("__n"))
    placed = values.join(cuts, key).withColumn(
        "__chunk", F.size(F.filter("__cuts", lambda cut: cut < F.col(column)))).drop("__cuts")
    low, high = F.floor((F.col("__n") - 1) / 2), F.ceil((F.col("__n") - 1) / 2)
    counts = placed.groupBy(key, "__chunk").agg(F.sum("__c").alias("__size"), F.max("__n").alias("__n"))
    earlier = Window.partitionBy(key).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    middle = (
        counts.withColumn("__before", F.coalesce(F.sum("__size").over(earlier), F.lit(0)))
        .where((F.col("__before") <= high) & (F.col("__before") + F.col("__size") > low))
        .select(key, "__chunk", "__before")
    )
    inside = Window.partitionBy(key, "__chunk").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.join(middle, [key, "__chunk"]).withColumn(
        "__start", F.col("__before") + F.coalesce(F.sum("__c").over(inside), F.lit(0)))

    def holds(rank):
        return (F.col("__start") <= rank) & (F.col("__start") + F.col("__c") > rank)

    return ranked.groupBy(key).agg(
        ((F.max(F.when(holds(low), F.col(column))) + F.max(F.when(holds(high), F.col(column)))) / 2).alias(out))
