"""Queries of the forecasting operators."""

from uuid import uuid4

from pyspark.sql import DataFrame, functions as F

from blockloom.functions.columns import newest
from blockloom.operators import fees, forecast
from blockloom.operators.tables import insert_ignore
from blockloom.plans.models import ModelStore
from blockloom.plans.registry import query
from blockloom.session import cut_lineage, work_folder
from blockloom.sources.fixtures import Fixtures

# The event tables span thirty days, so the rolling evaluation of the hour mean starts after fifteen and steps by five.
ROLLING = {"initial_days": 15, "period_days": 5}
LOOKBACK = "7D"


def history(fx: Fixtures) -> DataFrame:
    return fx.snapshots.drop("histogram")


def stored(fx: Fixtures) -> DataFrame:
    """Snapshots materialised once for the iterative fits of one query."""
    return cut_lineage(history(fx))


@query("time_features")
def _(fx: Fixtures) -> DataFrame:
    return forecast.time_features(history(fx).select("timestamp"))


@query("clean_targets")
def _(fx: Fixtures) -> DataFrame:
    texts = fx.predictions.select("prediction_time", "model_name", *[
        F.when(F.col(fee) < limit, F.concat(F.col(fee).cast("string"), F.lit(" sat"))).otherwise(F.col(fee).cast("string")).alias(fee)
        for fee, limit in (("fast_fee", 20), ("medium_fee", 30), ("low_fee", 10))])
    return forecast.clean_targets(texts)


@query("chrono_split")
def _(fx: Fixtures) -> DataFrame:
    train, test = forecast.chrono_split(history(fx), 0.8)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query("lookback_window")
def _(fx: Fixtures) -> DataFrame:
    return forecast.lookback(forecast.chrono_split(history(fx), 0.8)[0], LOOKBACK)


@query("forecast_forest")
def _(fx: Fixtures) -> DataFrame:
    rows = stored(fx)
    models = cut_lineage(forecast.train_forests(forecast.chrono_split(rows, 0.8)[0]))
    times = forecast.horizon(rows, newest(rows))
    return forecast.forecast_forests(models, times, newest(rows))


@query("forest_eval_mse")
def _(fx: Fixtures) -> DataFrame:
    train, test = forecast.chrono_split(stored(fx), 0.8)
    return forecast.evaluate(cut_lineage(forecast.train_forests(train)), test)


@query("forecast_eval_mse")
def _(fx: Fixtures) -> DataFrame:
    """The hour-of-day mean, and a forest that is the same by its settings: one whole tree over the hour alone."""
    train, test = (cut_lineage(part) for part in forecast.chrono_split(history(fx), 0.8))
    tree = forecast.Forest(trees=1, features=1.0, bootstrap=False)
    models = forecast.train_forests(train, {"hour_tree": "36500d"}, {("hour_tree", fee): tree for fee in forecast.FEES}, columns=["hour"])
    means = forecast.naive_mse(train, test).withColumn("model_name", F.lit("hour_mean"))
    return means.unionByName(forecast.evaluate(cut_lineage(models), test, columns=["hour"]))


@query("forest_fold_cells")
def _(fx: Fixtures) -> DataFrame:
    return forecast.fold_cells(fx.fee_history, forecast.FOREST_LOOKBACKS)


@query("forecast_horizon")
def _(fx: Fixtures) -> DataFrame:
    return forecast.horizon(fx.histograms, fx.last_hour)


@query("order_fees_clamp")
def _(fx: Fixtures) -> DataFrame:
    raw = fx.predictions.withColumns({"fast_fee": F.col("low_fee"), "low_fee": F.col("fast_fee") - 20})
    return forecast.order_fees(raw, "clamp").drop("generated_at")


@query("order_fees_sort")
def _(fx: Fixtures) -> DataFrame:
    raw = fx.predictions.withColumns({"fast_fee": F.col("low_fee"), "low_fee": F.col("fast_fee") - 20})
    return forecast.order_fees(raw, "sort").drop("generated_at")


@query("predictions_latest")
def _(fx: Fixtures) -> DataFrame:
    return fees.latest_batch(fx.predictions, "generated_at").orderBy("prediction_time", "model_name")


@query("prediction_view")
def _(fx: Fixtures) -> DataFrame:
    return forecast.prediction_view(fees.latest_batch(fx.predictions, "generated_at"))


@query("forest_search")
def _(fx: Fixtures) -> DataFrame:
    return forecast.search_forest(stored(fx))


@query("seasonal_trend_model")
def _(fx: Fixtures) -> DataFrame:
    """Forecasts of the models trained with the settings that the search of their lookback finds."""
    rows = cut_lineage(fx.fee_history)
    settings = {name: best for name, (best, _) in forecast.search_lookbacks(rows).items()}
    models = forecast.train_seasonal(rows, settings=settings)
    return forecast.forecast_seasonal(models, forecast.horizon(rows, newest(rows)), newest(rows))


@query("data_sufficiency")
def _(fx: Fixtures) -> DataFrame:
    return forecast.data_sufficiency(history(fx))


@query("naive_rolling_cv")
def _(fx: Fixtures) -> DataFrame:
    return forecast.naive_rolling_cv(history(fx), **ROLLING)


@query("rolling_origin_cv")
def _(fx: Fixtures) -> DataFrame:
    """A straight trend at every cutoff of the whole history, which SQL can fit as well."""
    return forecast.rolling_cv(cut_lineage(fx.fee_history), settings={"straight": forecast.STRAIGHT})


@query("seasonal_rolling_cv")
def _(fx: Fixtures) -> DataFrame:
    settings = {"default": forecast.Seasonal(), "multiplicative": forecast.Seasonal(mode="multiplicative"), "yearly": forecast.Seasonal(yearly=True)}
    return forecast.rolling_cv(cut_lineage(fx.fee_history), settings=settings)


@query("seasonal_grid_search")
def _(fx: Fixtures) -> DataFrame:
    rows = cut_lineage(fx.fee_history)
    found = [(name, s.changepoint_prior_scale, s.seasonality_prior_scale, s.daily, s.weekly, s.yearly, s.mode, score, s == best)
             for name, (best, scored) in forecast.search_lookbacks(rows).items() for s, score in (scored or [(best, None)])]
    return rows.sparkSession.createDataFrame(
        found, "model_name string, changepoint_prior_scale double, seasonality_prior_scale double, daily boolean, weekly boolean, "
        "yearly boolean, mode string, mape double, best boolean")


def differing(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of each model in both tables, and how many of them are not equal in all columns."""
    both = first.withColumn("x", F.lit(1)).unionByName(second.withColumn("x", F.lit(-1)))
    rows = both.groupBy(*first.columns).agg(F.sum("x").alias("x"), F.count_if(F.col("x") > 0).alias("n"))
    return rows.groupBy(*keys).agg(F.sum("n").alias("rows"), F.sum(F.abs("x")).alias("differing"))


@query("model_reload")
def _(fx: Fixtures) -> DataFrame:
    """Both model sets trained, stored, and taken from the store by the gate: rows forecast, and rows that differ from those of the trained models."""
    rows, out = cut_lineage(fx.fee_history), []
    now, store = newest(rows), ModelStore(fx.spark, f"{work_folder(fx.spark)}/models-{uuid4().hex}")
    times = cut_lineage(forecast.horizon(rows, now))
    for kind, train, predict in (("forest", forecast.train_forests, forecast.forecast_forests), ("seasonal", forecast.train_seasonal, forecast.forecast_seasonal)):
        trained = cut_lineage(train(rows))
        store.save(kind, trained, now)
        again, fresh = store.current(kind, lambda: trained, now, names=[])
        out.append(differing(predict(trained, times, now), predict(again, times, now), ["model_name"]).select(
            F.lit(kind).alias("kind"), "model_name", "rows", "differing", F.lit(fresh).alias("trained_again")))
    return out[0].unionByName(out[1])


@query("retrain_gate")
def _(fx: Fixtures) -> DataFrame:
    return forecast.needs_retrain(fx.model_log, newest(fx.model_log, "trained_at"), hours=1)


@query("store_predictions")
def _(fx: Fixtures) -> DataFrame:
    """The stored predictions after a run: complete, ordered and stamped rows are offered while those of purchases are stored."""
    offered = forecast.prediction_rows(forecast.order_fees(fx.predictions, "sort"), F.col("model_name"), fx.last_hour)
    stored = offered.where("model_name = 'purchase'")
    return stored.unionByName(insert_ignore(stored, offered, ["prediction_time", "model_name", "generated_at"]))
