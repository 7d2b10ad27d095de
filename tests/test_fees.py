from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from blockloom import schemas
from blockloom.operators import fees, forecast, patterns

# A sample histogram and the fees it must give.
HISTOGRAM = [[255, 2205], [127, 3494], [63, 14443], [31, 45798], [15, 143348], [7, 807188], [3, 4436537], [1, 2274202], [0, 0]]
T0 = datetime(2024, 1, 1)


def polls(spark, rows):
    return spark.createDataFrame(rows, "timestamp timestamp, histogram array<array<double>>")


def floats(levels):
    return [[float(a), float(b)] for a, b in levels]


def test_sample_histogram(spark):
    df = polls(spark, [(T0, floats(HISTOGRAM))])
    row = fees.fee_percentiles(df).first()
    assert (row.fast_fee, row.medium_fee, row.low_fee) == (7, 7, 7)
    state = fees.congestion(df).first()
    assert (state.total_vsize, state.congestion_status) == (7727215, "High")


def test_given_order_and_zero_fee(spark):
    row = fees.fee_percentiles(polls(spark, [(T0, floats([[1, 300000], [50, 300000], [0, 400000]]))])).first()
    assert (row.fast_fee, row.medium_fee, row.low_fee) == (1, 50, 1)


def test_fallback(spark):
    rows = [(T0 + timedelta(hours=12 * i), h) for i, h in enumerate([None, [], floats(HISTOGRAM), None, None, [], None])]
    got = fees.with_fallback(polls(spark, rows)).orderBy("timestamp").collect()
    assert [r.fast_fee for r in got] == [10, 10, 7, 7, 7, 7, 7]
    assert [len(r.histogram) for r in got] == [0, 0, 9, 9, 9, 9, 9]
    assert [r.low_fee for r in got][:2] == [1, 1]


def test_blocks_keep_every_byte_and_never_split_a_level(spark):
    df = polls(spark, [(T0, floats(HISTOGRAM))])
    got = fees.projected_blocks(df).orderBy("block").collect()
    assert sum(b.vsize for b in got) == sum(v for _, v in HISTOGRAM)
    assert [b.vsize for b in got] == [209288, 807188, 4436537, 2274202]
    assert got[2].fill_percent == 100 and (got[0].min_fee, got[0].max_fee) == (15, 255)


def test_hours_are_checked(spark):
    df = polls(spark, [(T0 - timedelta(hours=h), []) for h in (0, 100, 160, 200)])
    with pytest.raises(ValueError):
        fees.historical(df, 0, T0)
    assert fees.historical(df, 150, T0).count() == 2 and fees.historical(df, 500, T0).count() == 4


def test_insights_keep_empty_ranges(spark):
    tx = spark.createDataFrame([(100, 2.0, 0.5), (200, 4.0, 0.9), (300, 8.0, 100.0)], "vsize int, fee_per_vbyte double, total_sent double")
    got = {r.amount_range: r for r in fees.value_insights(tx, F.lit(T0)).collect()}
    assert len(got) == 5 and got["0-1 BTC"].avg_fee_per_vbyte == 3 and got[">100 BTC"].transaction_count == 1
    assert got["10-50 BTC"].transaction_count == 0 and got["10-50 BTC"].avg_fee_per_vbyte == 0


def slots(spark):
    rows = [(d, h, 1.0 if h < 8 else 5.0 if h < 16 else 20.0) for d in range(7) for h in range(24)]
    return spark.createDataFrame(rows, "day_of_week_num int, hour_of_day int, avg_fee double")


def test_pattern_model_roundtrip(spark, tmp_path):
    grid = slots(spark)
    model = patterns.kmeans_slots(grid, starts=3)
    named = model.assign(grid).join(model.names, "cluster_label")
    assert named.count() == 168 and named.select("fee_category").distinct().count() == 3
    order = {r.fee_category: r.avg_fee_for_category for r in model.names.collect()}
    assert order["Low Fee"] < order["Medium Fee"] < order["High Fee"]
    model.save(str(tmp_path / "m"))
    again = patterns.PatternModel.load(spark, str(tmp_path / "m"))
    key = ["day_of_week_num", "hour_of_day"]
    assert again.assign(grid).select(*key, "cluster_label").exceptAll(model.assign(grid).select(*key, "cluster_label")).count() == 0
    asked = spark.createDataFrame([(0, 3), (6, 23)], "day_of_week_num int, hour_of_day int")
    assert patterns.predict_slots(model, grid, asked).where("fee_category <> 'Unknown'").count() == 2


def test_order_rules(spark):
    raw = spark.createDataFrame([(1.0, 2.0, 9.0), (-1.0, -2.0, -3.0), (1.0, None, 2.0)], "fast_fee double, medium_fee double, low_fee double")
    sort = forecast.order_fees(raw, "sort").collect()
    clamp = forecast.order_fees(raw, "clamp").collect()
    assert tuple(sort[0]) == (9, 2, 1) and tuple(clamp[0]) == (2, 2, 1)
    assert tuple(sort[1]) == (0, 0, 0) and tuple(sort[2]) == (None, None, None) == tuple(clamp[2])


def fee_history(spark, days):
    rows = [(T0 + timedelta(hours=h), 20.0 + 10 * (h % 24 >= 12), 10.0 + 5 * (h % 24 >= 12), 5.0) for h in range(24 * days)]
    return spark.createDataFrame(rows, "timestamp timestamp, fast_fee double, medium_fee double, low_fee double")


def test_split_is_exact_with_ties(spark):
    rows = [(T0 + timedelta(hours=i // 4), i) for i in range(101)]
    df = spark.createDataFrame(rows, "timestamp timestamp, i int")
    train, test = forecast.chrono_split(df, 0.8, ties=["i"])
    assert sorted(r.i for r in train.collect()) == list(range(80))
    assert sorted(r.i for r in test.collect()) == list(range(80, 101))


def test_forests_beat_the_hour_mean_by_definition_of_daily_data(spark):
    train, test = forecast.chrono_split(fee_history(spark, 20), 0.8)
    settings = {("weekly", "fast_fee"): forecast.Forest(trees=20, depth=5, features=1.0)}
    models = forecast.train_forests(train, {"weekly": "4W"}, settings, ["fast_fee"])
    assert forecast.evaluate(models, test).first().mse < 1.0
    assert forecast.predict_forests(models, forecast.horizon(train, T0), "weekly").where("fast_fee IS NULL").count() == 48


def test_seasonal_model_follows_the_day(spark):
    df = fee_history(spark, 30)
    models = forecast.train_seasonal(df, {"weekly": "365d"})
    got = forecast.forecast_seasonal(models, forecast.horizon(df, T0 + timedelta(days=30)), T0).collect()
    assert len(got) == 48 and all(r.fast_fee >= r.medium_fee >= r.low_fee >= 0 for r in got)
    high = [r.fast_fee for r in got if 14 <= r.prediction_time.hour <= 20]
    low = [r.fast_fee for r in got if 2 <= r.prediction_time.hour <= 8]
    assert min(high) > max(low)


def test_short_history_keeps_the_default_settings(spark):
    best, scores = forecast.search_seasonal(fee_history(spark, 5), "weekly")
    assert best == forecast.Seasonal() and scores == []
    assert len(forecast.grid_points(forecast.SEASONAL_GRID)) == 400


def test_min_points():
    assert forecast.min_points() == 336 and forecast.min_points(forecast.Seasonal(yearly=True)) == 17520
    assert forecast.min_points(forecast.Seasonal(weekly=False, daily=False), 5) == 30


def test_schema_texts_parse(spark):
    for text in (schemas.BLOCK, schemas.TRANSACTIONS, schemas.OUTPUTS, schemas.WHALES, schemas.MACRO, schemas.FEE_PATTERN):
        assert spark.createDataFrame([], text).columns
