"""Queries over fee snapshots, value insights and weekly patterns."""

from uuid import uuid4

from pyspark.sql import DataFrame, Window, functions as F

from blockloom.functions.columns import newest
from blockloom.operators import fees, patterns
from blockloom.operators.tables import insert_ignore
from blockloom.plans.models import PatternStore
from blockloom.plans.registry import query
from blockloom.session import cut_lineage, work_folder
from blockloom.sources.fixtures import Fixtures

HOURS = 72
DAYS = 14
INTERVAL = "21 days"


@query("fee_percentiles")
def _(fx: Fixtures) -> DataFrame:
    return fees.fee_percentiles(fx.histograms).drop("histogram")


@query("fee_fallback")
def _(fx: Fixtures) -> DataFrame:
    return fees.with_fallback(fx.polls).select(
        "timestamp", "fresh", *fees.DEFAULT_FEES, F.size("histogram").alias("levels"),
        fees.total_vsize(F.col("histogram")).alias("total_vsize"))


@query("fee_estimation_latest")
def _(fx: Fixtures) -> DataFrame:
    return fees.latest(fx.snapshots).drop("histogram")


@query("fee_histogram_latest")
def _(fx: Fixtures) -> DataFrame:
    return fees.latest_histogram(fx.snapshots)


@query("mempool_congestion")
def _(fx: Fixtures) -> DataFrame:
    return fees.congestion(fx.histograms)


@query("historical_fees")
def _(fx: Fixtures) -> DataFrame:
    return fees.historical(fx.snapshots, HOURS, fx.last_hour, columns=["timestamp", *fees.FEE_SHARES])


@query("historical_histograms")
def _(fx: Fixtures) -> DataFrame:
    kept = fees.historical(fx.snapshots, HOURS, fx.last_hour, columns=["timestamp", "histogram"])
    return fees.parse_histogram(kept).select(
        "timestamp", F.size("histogram").alias("levels"), fees.total_vsize(F.col("histogram")).alias("total_vsize"))


@query("historical_predictions")
def _(fx: Fixtures) -> DataFrame:
    return fees.historical(fx.predictions, HOURS, newest(fx.predictions, "prediction_time"), ts="prediction_time", columns=[
        "prediction_time", "model_name", *fees.FEE_SHARES])


def heatmap(fx: Fixtures) -> DataFrame:
    return fees.fee_heatmap(fx.snapshots, DAYS, fx.last_hour)


@query("fee_heatmap")
def _(fx: Fixtures) -> DataFrame:
    return heatmap(fx).drop("day_of_week_num")


@query("heatmap_stats")
def _(fx: Fixtures) -> DataFrame:
    return fees.heatmap_stats(heatmap(fx))


@query("projected_blocks")
def _(fx: Fixtures) -> DataFrame:
    return fees.projected_blocks(fx.histograms)


@query("histogram_share")
def _(fx: Fixtures) -> DataFrame:
    return fees.histogram_share(fx.histograms)


@query("value_insights")
def _(fx: Fixtures) -> DataFrame:
    return fees.value_insights(fx.whales, newest(fx.whales))


def insight_batches(fx: Fixtures) -> DataFrame:
    return fees.value_insights(fx.whales, F.date_trunc("month", "timestamp"))


@query("latest_batch_insights")
def _(fx: Fixtures) -> DataFrame:
    return fees.latest_batch(insight_batches(fx), "generated_at").withColumn("display_order", fees.range_rank()).orderBy("display_order")


@query("insight_totals")
def _(fx: Fixtures) -> DataFrame:
    return fees.insight_totals(fees.latest_batch(insight_batches(fx), "generated_at"))


def slots(fx: Fixtures) -> DataFrame:
    return patterns.slot_grid(fx.snapshots, INTERVAL, fx.last_hour)


def tiled(fx: Fixtures) -> DataFrame:
    """Slots with thirds of the fee order standing in for cluster labels, so results have an exact SQL form."""
    order = Window.orderBy("avg_fee", "day_of_week_num", "hour_of_day")
    return slots(fx).withColumn("cluster_label", F.ntile(3).over(order))


def named(fx: Fixtures) -> DataFrame:
    return patterns.name_clusters(tiled(fx), 3)


@query("slot_grid")
def _(fx: Fixtures) -> DataFrame:
    return slots(fx)


@query("cyclical_features")
def _(fx: Fixtures) -> DataFrame:
    return patterns.cyclical_features(slots(fx))


@query("standardize")
def _(fx: Fixtures) -> DataFrame:
    return patterns.standardize(patterns.cyclical_features(slots(fx)), patterns.FEATURES).select(
        "time_slot_id", *patterns.FEATURES)


@query("slot_clusters")
def _(fx: Fixtures) -> DataFrame:
    grid = cut_lineage(slots(fx))
    return patterns.kmeans_slots(grid).assign(grid)


@query("slot_cluster_checks")
def _(fx: Fixtures) -> DataFrame:
    """The labels are a k-means solution, and the category asked for a slot is the one of its cluster."""
    grid = cut_lineage(slots(fx))
    model = patterns.kmeans_slots(grid)
    own = model.assign(grid).join(model.names.select("cluster_label", F.col("fee_category").alias("own")), "cluster_label")
    asked = patterns.predict_slots(model, grid, grid.select("day_of_week_num", "hour_of_day"))
    other = asked.join(own.select("day_of_week_num", "hour_of_day", "own"), ["day_of_week_num", "hour_of_day"]).where("fee_category <> own").agg(F.count("*"))
    return patterns.cluster_checks(model, grid).withColumn("other_category", other.scalar())


@query("pattern_model_io")
def _(fx: Fixtures) -> DataFrame:
    """The model stored and read back: slots, and those that the two label or name differently."""
    grid = cut_lineage(slots(fx))
    store = PatternStore(fx.spark, f"{work_folder(fx.spark)}/patterns-{uuid4().hex}")
    model = patterns.kmeans_slots(grid)
    store.save(model, fx.last_hour)
    columns = ["day_of_week_num", "hour_of_day", "cluster_label", "fee_category"]
    first, second = (m.assign(grid).join(m.names, "cluster_label").select(*columns) for m in (model, store.load()))
    rows = first.withColumn("x", F.lit(1)).unionByName(second.withColumn("x", F.lit(-1))).groupBy(*columns).agg(F.sum("x").alias("x"), F.count_if(F.col("x") > 0).alias("n"))
    return rows.agg(F.sum("n").alias("slots"), F.sum(F.abs("x")).alias("differing"))


@query("cluster_categories")
def _(fx: Fixtures) -> DataFrame:
    return named(fx).select("time_slot_id", "cluster_label", "fee_category", "avg_fee_for_category")


@query("hour_blocks")
def _(fx: Fixtures) -> DataFrame:
    return patterns.hour_blocks(named(fx))


@query("fee_pattern_latest")
def _(fx: Fixtures) -> DataFrame:
    now = fx.last_hour
    batches = patterns.fee_pattern(named(fx), now - F.expr("INTERVAL 7 DAYS")).unionByName(patterns.fee_pattern(named(fx), now))
    return fees.latest_batch(batches, "analysis_timestamp")


@query("predict_slot_category")
def _(fx: Fixtures) -> DataFrame:
    grid = cut_lineage(slots(fx))
    model = patterns.kmeans_slots(grid)
    asked = fx.snapshots.select((F.dayofweek("timestamp") - 1).alias("day_of_week_num"), F.hour("timestamp").alias("hour_of_day"))
    return patterns.predict_slots(model, grid, asked.distinct()).select("day_of_week_num", "hour_of_day", "fee_category")


@query("low_fee_recommendations")
def _(fx: Fixtures) -> DataFrame:
    return patterns.recommend(named(fx), fx.last_hour, 24)


@query("pattern_text")
def _(fx: Fixtures) -> DataFrame:
    return patterns.pattern_text(named(fx))


@query("pattern_summary")
def _(fx: Fixtures) -> DataFrame:
    return patterns.pattern_summary(patterns.fee_pattern(named(fx), fx.last_hour))


@query("fee_snapshot_append")
def _(fx: Fixtures) -> DataFrame:
    """The stored table after an append: all polls are offered while those before the newest day are stored."""
    offered = fx.snapshots
    stored = offered.where(F.col("timestamp") < F.date_trunc("day", fx.last_hour))
    table = stored.unionByName(insert_ignore(stored, offered, ["timestamp"]))
    return fees.parse_histogram(table).select("timestamp", *fees.FEE_SHARES, F.size("histogram").alias("levels"))


@query("value_insights_append")
def _(fx: Fixtures) -> DataFrame:
    """All monthly batches are offered while all but the newest are stored."""
    offered = insight_batches(fx)
    newest_month = F.date_trunc("month", newest(fx.whales))
    stored = offered.where(F.col("generated_at") < newest_month)
    return insert_ignore(stored, offered, ["generated_at", "amount_range"])


@query("fee_pattern_append")
def _(fx: Fixtures) -> DataFrame:
    return patterns.fee_pattern(named(fx), fx.last_hour)
