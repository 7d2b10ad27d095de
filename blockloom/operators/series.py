"""Fee series: features, splits, ordering and storage of predictions, the hour-of-day mean and the gate of retraining."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from blockloom.functions.columns import AsOf, moment, newest, seconds, span

FEES = ["fast_fee", "medium_fee", "low_fee"]
TIME_FEATURES = ["hour", "dayofweek", "month", "year"]
HORIZON_HOURS = 48
HOUR = 3600
DAY = 86400


# ---- data -------------------------------------------------------------------


def time_features(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    return df.withColumns({
        "hour": F.hour(ts), "dayofweek": F.weekday(F.col(ts)), "month": F.month(ts), "year": F.year(ts)})


def clean_targets(df: DataFrame, fees: list[str] = FEES) -> DataFrame:
    """Fees as numbers (unreadable ones null); rows without any fee drop out."""
    return df.withColumns({fee: F.col(fee).try_cast("double") for fee in fees}).dropna(how="all", subset=fees)


def chrono_split(df: DataFrame, share: float = 0.8, ts: str = "timestamp", ties: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """First ``share`` of the rows by time, and the rest.

    The cut is found without a global sort: rows are counted per time, times are accumulated per day and days
    across the (short) day table. Only rows that share the one time the cut falls into are ranked, by ``ties`` and then by all columns, so
    both parts agree whenever they are computed.
    The cut itself is one row, read once, so both parts are plain time filters that reach the scan.
    """
    times = df.groupBy(ts).agg(F.count("*").alias("n")).withColumn("day", F.to_date(ts))
    days = times.groupBy("day").agg(F.sum("n").alias("n"))
    earlier = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    opening = days.select("day", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("opening"))
    inside = Window.partitionBy("day").orderBy(ts).rowsBetween(Window.unboundedPreceding, -1)
    placed = times.join(opening, "day").withColumn("before", F.col("opening") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    wanted = F.floor(df.agg(F.count("*")).scalar() * F.lit(share))
    row = placed.where(F.col("before") + F.col("n") > wanted).agg(F.min_by(
        F.struct(F.unix_micros(ts).alias("at"), (wanted - F.col("before")).cast("bigint").alias("first")), ts).alias("cut")).first()
    if row is None or row.cut is None:
        return df, df.where(F.lit(False))
    at = F.timestamp_micros(F.lit(row.cut.at))
    rank = F.row_number().over(Window.partitionBy(ts).orderBy(*(ties or []), *df.columns))
    on_cut = df.where(F.col(ts) == at).withColumn("__rank", rank)
    columns = df.columns

    def ranked(keep: Column) -> DataFrame:
        return on_cut.where(keep).select(*columns)

    train = df.where(F.col(ts) < at).unionByName(ranked(F.col("__rank") <= row.cut.first))
    test = df.where(F.col(ts) > at).unionByName(ranked(F.col("__rank") > row.cut.first))
    return train, test


def lookback(df: DataFrame, interval: str, ts: str = "timestamp") -> DataFrame:
    """Rows within an interval of the newest time of the same rows."""
    return df.where(F.col(ts) >= newest(df, ts) - span(seconds(interval)))


def horizon(df: DataFrame, as_of: AsOf, hours: int = HORIZON_HOURS) -> DataFrame:
    """Hourly times from the next full hour on; ``df`` only provides the session."""
    start = F.date_trunc("hour", moment(as_of)) + F.expr("INTERVAL 1 HOUR")
    return df.sparkSession.range(1).select(F.explode(F.sequence(
        start, start + F.expr(f"INTERVAL {hours - 1} HOURS"), F.expr("INTERVAL 1 HOUR"))).alias("prediction_time"))


# ---- ordering and storage ---------------------------------------------------


def order_fees(df: DataFrame, mode: str = "sort") -> DataFrame:
    """Predictions with low <= medium <= fast and none below zero; a row with a missing fee loses all three.

    ``sort`` reorders the three values. ``clamp`` lowers low to the minimum first and then bounds the others,
    so a low prediction above both others is forgotten.
    """
    fast, medium, low = (F.col(fee) for fee in FEES)
    known = fast.isNotNull() & medium.isNotNull() & low.isNotNull()
    if mode == "sort":
        ranked = F.sort_array(F.array(fast, medium, low))
        values = {"low_fee": F.get(ranked, F.lit(0)), "medium_fee": F.get(ranked, F.lit(1)), "fast_fee": F.get(ranked, F.lit(2))}
    elif mode == "clamp":
        floor = F.least(low, medium, fast)
        top = F.greatest(floor, medium, fast)
        values = {"low_fee": floor, "fast_fee": top, "medium_fee": F.greatest(floor, F.least(medium, top))}
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return df.withColumns({fee: F.when(known, F.greatest(value, F.lit(0.0))) for fee, value in values.items()})


def prediction_rows(predictions: DataFrame, model_name: str | Column, generated_at: AsOf) -> DataFrame:
    """Rows to store: complete predictions with model name and batch time."""
    name = model_name if isinstance(model_name, Column) else F.lit(model_name)
    return predictions.dropna("any", subset=FEES).select(
        "prediction_time", name.alias("model_name"), *FEES, moment(generated_at).alias("generated_at"))


def prediction_view(batch: DataFrame, model: str | None = None) -> DataFrame:
    """Series of one model of a batch with its next point marked: the asked model if present, else ``hourly``,
    else the first by name."""
    wanted = [F.max(F.when(F.col("model_name") == name, F.col("model_name"))) for name in (model, "hourly") if name]
    chosen = batch.agg(F.coalesce(*wanted, F.min("model_name"))).scalar()
    series = batch.where(F.col("model_name") == chosen)
    return series.withColumn("is_next", F.col("prediction_time") == newest_first(series))


def newest_first(series: DataFrame) -> Column:
    return series.select(F.min("prediction_time")).scalar()


# ---- naive predictor --------------------------------------------------------


def naive_mse(train: DataFrame, test: DataFrame, fees: list[str] = FEES) -> DataFrame:
    """Mean squared error of the hour-of-day mean of the training part: the bar a model has to beat."""
    means = train.groupBy(F.hour("timestamp").alias("hour")).agg(*[F.avg(fee).alias(f"m_{fee}") for fee in fees])
    scored = test.withColumn("hour", F.hour("timestamp")).join(means, "hour")
    return scored.agg(F.array(*[
        F.struct(F.lit(fee).alias("fee_type"), F.avg(F.pow(F.col(fee) - F.col(f"m_{fee}"), 2)).alias("mse")) for fee in fees
    ]).alias("e")).select(F.inline("e"))


def naive_rolling_cv(df: DataFrame, fee: str = "fast_fee", initial_days: float = 60, period_days: float = 15,
               horizon_hours: float = HORIZON_HOURS) -> DataFrame:
    """Mean absolute percentage error of the hour-of-day mean per cutoff (cutoff, points, mape).

    Cutoffs run back from the end minus the horizon in steps of the period, while the initial span is left.
    Rows are binned between cutoffs once and the bins accumulated, so a training row is never repeated per
    cutoff; a test row meets only the cutoffs whose horizon covers it.
    """
    initial, period, ahead = (int(v) for v in (initial_days * DAY, period_days * DAY, horizon_hours * HOUR))
    rows = df.select(F.unix_timestamp("timestamp").alias("t"), F.hour("timestamp").alias("hour"), F.col(fee).alias("y"))
    bounds = rows.agg(F.struct(F.min("t").alias("a"), F.max("t").alias("b")))
    room = F.col("w.b") - ahead - F.col("w.a") - initial
    frame = bounds.select(F.col(bounds.columns[0]).alias("w")).select(
        F.struct((F.floor(room / period) + 1).cast("bigint").alias("n"),
                 (F.col("w.b") - ahead - F.floor(room / period) * period).cast("bigint").alias("first")).alias("p"))
    plan = frame.scalar()
    placed = rows.withColumn("p", plan).where("p.n > 0").withColumn("n", F.col("p.n")).withColumn("first", F.col("p.first")).drop("p")
    after = F.ceil((F.col("t") - F.col("first")) / period).cast("bigint")
    binned = placed.withColumn("i", F.greatest(after, F.lit(0))).where("i < n").groupBy("i", "hour").agg(F.sum("y").alias("s"), F.count("y").alias("c"))
    grid = frame.where("p.n > 0").select(F.explode(F.sequence(F.lit(0), F.col("p.n") - 1)).alias("i")).select(
        "i", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    upto = Window.partitionBy("hour").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    means = grid.join(binned, ["i", "hour"], "left").select(
        "i", "hour", (F.sum("s").over(upto) / F.nullif(F.sum("c").over(upto), F.lit(0))).alias("guess")).where("guess IS NOT NULL")
    low = F.greatest(F.ceil((F.col("t") - ahead - F.col("first")) / period), F.lit(0)).cast("bigint")
    high = F.least(after - 1, F.col("n") - 1)
    tested = placed.withColumn("low", low).withColumn("high", high).where("low <= high AND y <> 0").select(
        "t", "hour", "y", "first", F.explode(F.sequence("low", "high")).alias("i"))
    return tested.join(means, ["i", "hour"]).groupBy("i", "first").agg(
        F.count("*").alias("points"), F.avg(F.abs((F.col("y") - F.col("guess")) / F.col("y"))).alias("mape")
    ).select(F.timestamp_seconds(F.col("first") + F.col("i") * period).alias("cutoff"), "points", "mape")


# ---- retraining -------------------------------------------------------------


def needs_retrain(log: DataFrame, as_of: AsOf, hours: int = 24, fees: list[str] = FEES) -> DataFrame:
    """Per model set: when it was trained, whether all fees have a model, and whether it must be trained again
    (incomplete, or not trained within the last ``hours``)."""
    have = [F.max(F.when(F.col("fee_type") == fee, 1).otherwise(0)) for fee in fees]
    complete = reduce(lambda a, b: a + b, have) == len(fees)
    return log.groupBy("model_name").agg(F.max("trained_at").alias("trained_at"), complete.alias("complete")).withColumn(
        "retrain", ~F.col("complete") | (moment(as_of) - F.col("trained_at") >= F.expr(f"INTERVAL {hours} HOURS")))
