"""Weekly fee patterns: 168 weekday-hour slots, their clusters and readable summaries.

The slot table has a fixed size (7 x 24), whatever the history behind it.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window, functions as F

from blockloom.functions.columns import AsOf, DAY_NAMES, moment, pick_name, seconds
from blockloom.operators.fees import weekly_means
from blockloom.session import cut_lineage

FEATURES = ["avg_fee", "hour_sin", "hour_cos", "day_sin", "day_cos"]
# Category names, lowest mean fee first.
CATEGORY_NAMES = {2: ["Low Fee", "High Fee"], 3: ["Low Fee", "Medium Fee", "High Fee"]}


def slot_grid(df: DataFrame, interval: str, as_of: AsOf) -> DataFrame:
    """All 168 slots with their mean fast fee over the interval, 0 where nothing was seen."""
    slots = df.sparkSession.range(0, 168, 1, 1).select(
        F.floor(F.col("id") / 24).cast("int").alias("day_of_week_num"), (F.col("id") % 24).cast("int").alias("hour_of_day"))
    seen = weekly_means(df, seconds(interval), as_of)
    return slots.join(seen, ["day_of_week_num", "hour_of_day"], "left").select(
        "day_of_week_num", "hour_of_day",
        F.coalesce(F.col("avg_fee"), F.lit(0)).cast("decimal(10,1)").alias("avg_fee"),
        F.concat_ws("-", "day_of_week_num", "hour_of_day").alias("time_slot_id"))


def cyclical_features(df: DataFrame) -> DataFrame:
    hour = F.col("hour_of_day") * (2 * math.pi / 24)
    day = F.col("day_of_week_num") * (2 * math.pi / 7)
    return df.withColumns({
        "hour_sin": F.sin(hour), "hour_cos": F.cos(hour), "day_sin": F.sin(day), "day_cos": F.cos(day)})


def _scale(columns: list[str]) -> tuple[list[Column], callable]:
    stats = [f(F.col(c).cast("double")).alias(f"{c}__{n}") for c in columns for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))]

    def scaled(c: str, source: Column) -> Column:
        spread = source[f"{c}__s"]
        return F.when(spread > 0, (F.col(c).cast("double") - source[f"{c}__m"]) / spread).otherwise(0.0)

    return stats, scaled


def standardize(df: DataFrame, columns: list[str], prefix: str = "") -> DataFrame:
    """Zero mean and unit population deviation; a constant column becomes 0.

    The moments are one aggregate row, read back as a scalar subquery.
    """
    stats, scaled = _scale(columns)
    moments = df.agg(F.struct(*stats).alias("m")).scalar()
    return df.withColumn("__m", moments).withColumns({prefix + c: scaled(c, F.col("__m")) for c in columns}).drop("__m")


class PatternModel:
    """Scaling moments, k-means centres and category names of the weekly slots."""

    def __init__(self, kmeans: KMeansModel, moments: DataFrame, names: DataFrame):
        self.kmeans, self.moments, self.names = kmeans, moments, names

    def scaled(self, slots: DataFrame) -> DataFrame:
        """Slots with their features scaled by the moments of the training data, as ``z_`` columns."""
        _, scaled = _scale(FEATURES)
        source = cyclical_features(slots).withColumn("__m", self.moments.scalar())
        return source.withColumns({f"z_{c}": scaled(c, F.col("__m")) for c in FEATURES}).drop("__m")

    def assign(self, slots: DataFrame) -> DataFrame:
        """Cluster of each slot, scaled with the moments of the training data."""
        ready = VectorAssembler(inputCols=[f"z_{c}" for c in FEATURES], outputCol="features").transform(self.scaled(slots))
        labels = self.kmeans.transform(ready).withColumnRenamed("prediction", "cluster_label")
        return labels.select(*slots.columns, "cluster_label")

    def save(self, path: str) -> None:
        self.kmeans.write().overwrite().save(f"{path}/kmeans")
        self.moments.write.mode("overwrite").parquet(f"{path}/moments")
        self.names.write.mode("overwrite").parquet(f"{path}/names")

    @staticmethod
    def load(spark, path: str) -> "PatternModel":
        return PatternModel(
            KMeansModel.load(f"{path}/kmeans"), spark.read.parquet(f"{path}/moments"), spark.read.parquet(f"{path}/names"))


def kmeans_slots(slots: DataFrame, k: int = 3, seed: int = 42, starts: int = 10) -> PatternModel:
    """k-means over the scaled slots, the best of several starts.

    The 168 slots are put in one sorted partition: the size is fixed by the calendar, and the order makes
    seeded runs repeatable.
    """
    stats, scaled = _scale(FEATURES)
    featured = cut_lineage(cyclical_features(slots).coalesce(1).sortWithinPartitions("day_of_week_num", "hour_of_day"))
    moments = cut_lineage(featured.agg(F.struct(*stats).alias("m")))
    rows = featured.withColumn("__m", moments.scalar()).withColumns({f"z_{c}": scaled(c, F.col("__m")) for c in FEATURES})
    ready = VectorAssembler(inputCols=[f"z_{c}" for c in FEATURES], outputCol="features").transform(rows.drop("__m")).persist()
    ready.count()
    with ThreadPoolExecutor(min(starts, 8)) as pool:
        models = list(pool.map(lambda i: KMeans(k=k, seed=seed + i, maxIter=300, tol=1e-4).fit(ready), range(starts)))
    best = min(models, key=lambda m: m.summary.trainingCost)
    labelled = best.transform(ready).withColumnRenamed("prediction", "cluster_label")
    names = cut_lineage(category_names(labelled, k))
    ready.unpersist()
    return PatternModel(best, moments, names)


def cluster_checks(model: PatternModel, slots: DataFrame, near: float = 1e-3) -> DataFrame:
    """What makes labels a k-means solution: slots, those with a centre nearer than their own, and centres that are not the mean of their slots."""
    centres = [[float(v) for v in centre] for centre in model.kmeans.clusterCenters()]
    z = [f"z_{c}" for c in FEATURES]
    rows = model.scaled(model.assign(slots))
    gaps = F.array(*[sum(((F.col(c) - v) ** 2 for c, v in zip(z[1:], centre[1:])), (F.col(z[0]) - centre[0]) ** 2) for centre in centres])
    misplaced = rows.agg(F.count("*").alias("slots"), F.count_if(F.get(gaps, F.col("cluster_label")) > F.array_min(gaps) + 1e-9).alias("misplaced"))
    means = rows.groupBy("cluster_label").agg(*[F.avg(c).alias(c) for c in z])
    off = [F.abs(F.col(c) - F.get(F.array(*[F.lit(centre[i]) for centre in centres]), F.col("cluster_label"))) for i, c in enumerate(z)]
    moved = means.agg(F.count("*").alias("clusters"), F.count_if(F.greatest(*off) > near).alias("moved"))
    return misplaced.withColumn("m", moved.agg(F.first(F.struct("clusters", "moved"))).scalar()).select("slots", "misplaced", "m.clusters", "m.moved")


def _names(k: int) -> list[str]:
    return CATEGORY_NAMES.get(k, [f"Fee Category {i + 1}" if k > 3 else f"Category {i + 1}" for i in range(k)])


def category_names(labelled: DataFrame, k: int) -> DataFrame:
    """Name per cluster, by rising mean fee (k rows)."""
    return name_clusters(labelled, k).select("cluster_label", "avg_fee_for_category", "fee_category").distinct()


def name_clusters(labelled: DataFrame, k: int) -> DataFrame:
    """Slots with the name and mean fee of their cluster. The windows run over the 168 slots."""
    same = Window.partitionBy("cluster_label")
    ranked = labelled.withColumns({
        "avg_fee_for_category": F.avg("avg_fee").over(same).cast("decimal(10,2)"),
        "mean_fee": F.avg(F.col("avg_fee").cast("double")).over(same)})
    rank = F.dense_rank().over(Window.orderBy("mean_fee", "cluster_label"))
    return ranked.withColumn("fee_category", pick_name(_names(k), rank - 1)).drop("mean_fee")


def hour_blocks(slots: DataFrame) -> DataFrame:
    """Runs of consecutive hours per category and day as ``[start_hour, end_hour)``."""
    order = Window.partitionBy("fee_category", "day_of_week_num").orderBy("hour_of_day")
    runs = slots.withColumn("run", F.col("hour_of_day") - F.row_number().over(order))
    return runs.groupBy("fee_category", "day_of_week_num", "avg_fee_for_category", "run").agg(
        F.min("hour_of_day").alias("start_hour"), (F.max("hour_of_day") + 1).alias("end_hour")).drop("run")


def fee_pattern(slots: DataFrame, as_of: AsOf) -> DataFrame:
    """Pattern rows to store for one analysis."""
    return hour_blocks(slots).select(
        moment(as_of).alias("analysis_timestamp"), "fee_category", "day_of_week_num", "start_hour", "end_hour",
        "avg_fee_for_category")


def predict_slots(model: PatternModel, slots: DataFrame, asked: DataFrame) -> DataFrame:
    """Category of asked (day, hour) pairs: the slot's historic mean fee decides, the global mean if absent."""
    overall = slots.agg(F.avg("avg_fee")).scalar()
    known = asked.join(slots.select("day_of_week_num", "hour_of_day", "avg_fee"), ["day_of_week_num", "hour_of_day"], "left")
    filled = known.withColumn("avg_fee", F.coalesce(F.col("avg_fee"), overall))
    return model.assign(filled).join(model.names.select("cluster_label", "fee_category"), "cluster_label", "left").withColumn(
        "fee_category", F.coalesce("fee_category", F.lit("Unknown")))


def hours_ahead(as_of: AsOf, df: DataFrame, hours: int) -> DataFrame:
    """The next ``hours`` hour marks from ``as_of`` on; ``df`` only provides the session."""
    start = moment(as_of)
    return df.sparkSession.range(1).select(F.explode(
        F.sequence(start, start + F.expr(f"INTERVAL {hours - 1} HOURS"), F.expr("INTERVAL 1 HOUR"))).alias("at"))


def recommend(slots: DataFrame, as_of: AsOf, hours: int = 24) -> DataFrame:
    """Coming hours whose slot is cheap, with a readable line each."""
    cheap = slots.where("fee_category = 'Low Fee'").select("day_of_week_num", "hour_of_day", "avg_fee")
    times = hours_ahead(as_of, slots, hours).select(
        "at", (F.dayofweek("at") - 1).alias("day_of_week_num"), F.hour("at").alias("hour_of_day"))
    text = F.format_string(
        "%s %02d:00 UTC (Avg Fee: %.1f sat/vB)", pick_name(DAY_NAMES, F.col("day_of_week_num")), F.col("hour_of_day"),
        F.col("avg_fee").cast("double"))
    return times.join(cheap, ["day_of_week_num", "hour_of_day"]).select("at", text.alias("recommendation"))


def _hours_text(start: Column, last: Column, end: Column, suffix: str) -> Column:
    return F.when(start == last, F.format_string(f"%02d:00{suffix}", start)).otherwise(
        F.format_string(f"%02d:00-%02d:00{suffix}", start, end))


def pattern_text(slots: DataFrame) -> DataFrame:
    """Per category and day: the hour ranges as text (at most 12 ranges a day), with the category's mean fee."""
    text = _hours_text(F.col("start_hour"), F.col("end_hour") - 1, F.col("end_hour"), " UTC")
    ranges = F.transform(F.sort_array(F.collect_list(F.struct("start_hour", text.alias("t")))), lambda r: r["t"])
    return hour_blocks(slots).groupBy("fee_category", "avg_fee_for_category", "day_of_week_num").agg(
        F.array_join(ranges, ", ").alias("hours")
    ).select(
        "fee_category", F.format_string("Average Fee: %.2f sat/vB", F.col("avg_fee_for_category").cast("double")).alias("headline"),
        "day_of_week_num", F.format_string("  - %s: %s", pick_name(DAY_NAMES, F.col("day_of_week_num")), F.col("hours")).alias("line"))


def category_key(text: Column) -> Column:
    name = F.lower(text)
    return F.when(name.contains("low"), "low").when(name.contains("medium"), "medium").when(
        name.contains("high"), "high").otherwise("unknown")


def pattern_summary(pattern: DataFrame) -> DataFrame:
    """Reader's summary of a stored pattern: unweighted mean over range rows, and runs of start hours per day
    with an inclusive end label. Unknown categories are left out."""
    rows = pattern.withColumn("category", category_key(F.col("fee_category"))).where("category <> 'unknown'")
    means = rows.groupBy("category").agg(F.avg("avg_fee_for_category").cast("decimal(10,2)").alias("avg_fee"))
    starts = rows.select("category", "day_of_week_num", "start_hour").distinct()
    order = Window.partitionBy("category", "day_of_week_num").orderBy("start_hour")
    runs = starts.withColumn("run", F.col("start_hour") - F.row_number().over(order)).groupBy(
        "category", "day_of_week_num", "run").agg(F.min("start_hour").alias("a"), F.max("start_hour").alias("b"))
    text = _hours_text(F.col("a"), F.col("b"), F.col("b"), "")
    ranges = F.transform(F.sort_array(F.collect_list(F.struct("a", text.alias("t")))), lambda r: r["t"])
    days = runs.groupBy("category", "day_of_week_num").agg(F.array_join(ranges, ", ").alias("hours"))
    return days.join(means, "category").select(
        "category", "avg_fee", "day_of_week_num",
        F.format_string("%s: %s UTC", pick_name(DAY_NAMES, F.col("day_of_week_num")), F.col("hours")).alias("times"))
