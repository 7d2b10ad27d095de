"""Fee snapshots of the pending pool: derived fees, congestion, projected blocks, heatmap and value ranges.

A snapshot holds its whole histogram as ``array<array<double>>`` (``[fee, vsize]`` levels), so everything
that looks at one snapshot is a projection with higher-order functions: no shuffle, no window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from blockloom import schemas
from blockloom.functions.columns import AsOf, SHORT_DAYS, moment, newest, pick_name, span, sunday_first

BLOCK_LIMIT = 1_000_000
HIGH_CONGESTION = 5_000_000
# Shares of a block at which the fast, medium and low fee are read, and the fees used
# when there has never been a snapshot.
FEE_SHARES = {"fast_fee": 0.25, "medium_fee": 0.50, "low_fee": 0.75}
DEFAULT_FEES = {"fast_fee": 10.0, "medium_fee": 5.0, "low_fee": 1.0}
# Amount ranges in coins, lower bound included, upper bound not.
AMOUNT_RANGES = [
    ("0-1 BTC", 0, 1),
    ("1-10 BTC", 1, 10),
    ("10-50 BTC", 10, 50),
    ("50-100 BTC", 50, 100),
    (">100 BTC", 100, None),
]


def zero() -> Column:
    return F.lit(0.0)


def parse_histogram(df: DataFrame, column: str = "histogram") -> DataFrame:
    return df.withColumn(column, F.from_json(column, schemas.HISTOGRAM))


def total_vsize(histogram: Column) -> Column:
    return F.aggregate(histogram, zero(), lambda acc, level: acc + level[1])


def fee_percentiles(snapshots: DataFrame, limit: int = BLOCK_LIMIT) -> DataFrame:
    """Fee of the first level, in the given order, where the running vsize reaches each share of a block.

    A share that is never reached, or reached at fee 0, gives fee 1.
    """
    unset = F.lit(None).cast("double")

    def walk(acc: Column, level: Column) -> Column:
        total = acc["total"] + level[1]
        reached = [
            F.coalesce(acc[name], F.when(total >= limit * share, level[0])).alias(name) for name, share in FEE_SHARES.items()
        ]
        return F.struct(total.alias("total"), *reached)

    start = F.struct(zero().alias("total"), *[unset.alias(name) for name in FEE_SHARES])
    walked = snapshots.withColumn("walked", F.aggregate("histogram", start, walk))
    fees = {
        name: F.when(F.coalesce(F.col("walked")[name], zero()) == 0, 1.0).otherwise(F.col("walked")[name])
        for name in FEE_SHARES
    }
    return walked.withColumns(fees).drop("walked")


def with_fallback(polls: DataFrame, limit: int = BLOCK_LIMIT) -> DataFrame:
    """Polls in time order: an empty or failed poll repeats the last good one, or the defaults before any.

    The carry runs in two levels, inside each day and across days on a table with one row per day, so no
    window spans the whole history.
    """
    good = F.size("histogram") > 0
    row = F.struct("histogram", *FEE_SHARES)
    marked = fee_percentiles(polls, limit).withColumn("seen", F.when(good, row)).withColumn("day", F.to_date("timestamp"))
    inside = Window.partitionBy("day").orderBy("timestamp").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    closing = marked.groupBy("day").agg(F.max_by("seen", F.when(F.col("seen").isNotNull(), F.col("timestamp"))).alias("last"))
    opening = closing.select("day", F.last("last", ignorenulls=True).over(earlier).alias("opening"))
    filled = marked.withColumn("carried", F.last("seen", ignorenulls=True).over(inside)).join(opening, "day", "left")
    known = F.coalesce("carried", "opening")
    return filled.select(
        "timestamp",
        F.coalesce(known["histogram"], F.array().cast("array<array<double>>")).alias("histogram"),
        *[F.coalesce(known[name], F.lit(value)).alias(name) for name, value in DEFAULT_FEES.items()],
        F.coalesce(good, F.lit(False)).alias("fresh"),
    )


def latest(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """The newest row (a top-1, never a full sort)."""
    return df.orderBy(F.desc(ts)).limit(1)


def latest_histogram(df: DataFrame) -> DataFrame:
    """Levels of the newest stored histogram in stored order."""
    levels = parse_histogram(latest(df.select("timestamp", "histogram")))
    return levels.select("timestamp", F.posexplode("histogram").alias("pos", "level")).select(
        "timestamp", "pos", F.col("level")[0].alias("fee"), F.col("level")[1].alias("vsize"))


def congestion(snapshots: DataFrame) -> DataFrame:
    total = total_vsize(F.col("histogram"))
    return snapshots.select("timestamp", total.cast("bigint").alias("total_vsize")).withColumn(
        "congestion_status", F.when(F.col("total_vsize") > HIGH_CONGESTION, "High").otherwise("Low"))


def historical(df: DataFrame, hours: int, as_of: AsOf, ts: str = "timestamp", columns: list[str] | None = None) -> DataFrame:
    """Rows of the last ``hours`` up to ``as_of``; order by time descending to read it."""
    if hours <= 0:
        raise ValueError("hours must be positive")
    kept = df.where(F.col(ts) >= moment(as_of) - span(hours * 3600))
    return kept.select(*columns) if columns else kept


def weekly_means(df: DataFrame, secs: int, as_of: AsOf) -> DataFrame:
    """Mean fast fee by weekday (Sunday = 0) and hour over the last ``secs`` seconds."""
    return (
        df.where(F.col("timestamp") >= moment(as_of) - span(secs))
        .groupBy(sunday_first(F.col("timestamp")).alias("day_of_week_num"), F.hour("timestamp").alias("hour_of_day"))
        .agg(F.avg("fast_fee").cast("decimal(10,1)").alias("avg_fee"))
    )


def fee_heatmap(df: DataFrame, days: int, as_of: AsOf) -> DataFrame:
    if days <= 0:
        raise ValueError("days must be positive")
    cells = weekly_means(df, days * 86400, as_of)
    return cells.select(
        pick_name(SHORT_DAYS, F.col("day_of_week_num")).alias("day"), "day_of_week_num",
        F.col("hour_of_day").alias("hour"), "avg_fee")


def heatmap_stats(cells: DataFrame) -> DataFrame:
    paid = cells.where("avg_fee > 0")
    return paid.agg(F.min("avg_fee").alias("min_fee"), F.max("avg_fee").alias("max_fee"),
                    F.avg(F.col("avg_fee").cast("double")).alias("mean_fee"))


def projected_blocks(snapshots: DataFrame, limit: int = BLOCK_LIMIT) -> DataFrame:
    """Pack fee levels, highest fee first, into blocks. A level is never split; a block closes when the next
    level would overflow it and it already holds something."""
    block = "struct<vsize:double,max_fee:double,min_fee:double>"
    empty = F.struct(zero().alias("vsize"), F.lit(None).cast("double").alias("max_fee"), F.lit(None).cast("double").alias("min_fee"))
    start = F.struct(F.array().cast(f"array<{block}>").alias("closed"), empty.alias("open"))

    def pack(acc: Column, level: Column) -> Column:
        current = acc["open"]
        full = (current["vsize"] + level[1] > limit) & (current["vsize"] > 0)
        alone = F.struct(level[1].alias("vsize"), level[0].alias("max_fee"), level[0].alias("min_fee"))
        grown = F.struct(
            (current["vsize"] + level[1]).alias("vsize"),
            F.greatest(current["max_fee"], level[0]).alias("max_fee"), F.least(current["min_fee"], level[0]).alias("min_fee"))
        return F.struct(
            F.when(full, F.concat(acc["closed"], F.array(current))).otherwise(acc["closed"]).alias("closed"),
            F.when(full, alone).otherwise(grown).alias("open"))

    def finish(acc: Column) -> Column:
        return F.when(acc["open"]["vsize"] > 0, F.concat(acc["closed"], F.array(acc["open"]))).otherwise(acc["closed"])

    ordered = F.sort_array("histogram", asc=False)
    blocks = snapshots.select("timestamp", F.posexplode(F.aggregate(ordered, start, pack, finish)).alias("block", "b"))
    return blocks.select(
        "timestamp", "block", F.col("b.vsize").cast("bigint").alias("vsize"), F.col("b.min_fee").alias("min_fee"),
        F.col("b.max_fee").alias("max_fee"),
        F.least(F.col("b.vsize") * 100 / limit, F.lit(100.0)).alias("fill_percent"))


def histogram_share(snapshots: DataFrame) -> DataFrame:
    """Non-empty levels with their percentage of the snapshot."""
    kept = snapshots.select("timestamp", F.filter("histogram", lambda level: level[1] > 0).alias("levels"))
    return kept.withColumn("total", total_vsize(F.col("levels"))).select(
        "timestamp", "total", F.explode("levels").alias("level")
    ).select("timestamp", F.col("level")[0].alias("fee"), F.col("level")[1].cast("bigint").alias("vsize"),
             (F.col("level")[1] * 100 / F.col("total")).alias("percent"))


def value_insights(tx: DataFrame, generated_at: Column) -> DataFrame:
    """vsize, mean fee rate and count per amount range; a batch always has all five ranges.

    Conditional sums keep each batch a single aggregate row (partial sums before the shuffle); the rows of the
    ranges are unfolded afterwards, so empty ranges need no join.
    """
    sent = F.col("total_sent")
    sums, rows = [], []
    for i, (name, low, high) in enumerate(AMOUNT_RANGES):
        inside = (sent >= low) if high is None else (sent >= low) & (sent < high)
        sums += [
            F.coalesce(F.sum(F.when(inside, F.col("vsize").cast("bigint"))), F.lit(0)).cast("bigint").alias(f"v{i}"),
            F.coalesce(F.avg(F.when(inside, F.col("fee_per_vbyte"))), zero()).alias(f"f{i}"),
            F.count_if(inside).alias(f"n{i}"),
        ]
        rows.append(F.struct(
            F.lit(name).alias("amount_range"), F.col(f"v{i}").alias("total_vsize_bytes"),
            F.col(f"f{i}").alias("avg_fee_per_vbyte"), F.col(f"n{i}").alias("transaction_count")))
    return tx.groupBy(generated_at.alias("generated_at")).agg(*sums).select("generated_at", F.inline(F.array(*rows)))


def latest_batch(df: DataFrame, ts: str) -> DataFrame:
    """Rows of the newest batch; the batch time is a scalar subquery, so partitioned tables prune to it."""
    return df.where(F.col(ts) == newest(df, ts))


def range_rank(column: str = "amount_range") -> Column:
    """Display order of the amount ranges; unknown texts come last."""
    names = F.array(*[F.lit(name) for name, _, _ in AMOUNT_RANGES])
    return F.coalesce(F.nullif(F.array_position(names, F.col(column)), F.lit(0)), F.lit(len(AMOUNT_RANGES) + 1))


def insight_totals(batch: DataFrame) -> DataFrame:
    return batch.agg(F.sum("total_vsize_bytes").alias("total_vsize"), F.sum("transaction_count").alias("total_transactions"))
