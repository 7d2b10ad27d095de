"""Oracles of the forecasting queries."""

PRED = "strftime(prediction_time, '%Y-%m-%d %H:%M:%S') AS prediction_time"
RANKED = "(SELECT *, row_number() OVER (ORDER BY timestamp) AS rn, count(*) OVER () AS n FROM fx_fee)"
RAW = "(SELECT prediction_time, model_name, low_fee AS f, medium_fee AS m, fast_fee - 20 AS l FROM fx_pred)"
LATEST = "(SELECT * FROM fx_pred WHERE generated_at = (SELECT max(generated_at) FROM fx_pred))"

SQL = {
    "time_features": """
SELECT strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, hour(fx_fee.timestamp) AS hour, isodow(fx_fee.timestamp) - 1 AS dayofweek,
       month(fx_fee.timestamp) AS month, year(fx_fee.timestamp) AS year FROM fx_fee""",
    "clean_targets": f"""
SELECT {PRED}, model_name, CASE WHEN fast_fee >= 20 THEN fast_fee END AS fast_fee, CASE WHEN medium_fee >= 30 THEN medium_fee END AS medium_fee,
       CASE WHEN low_fee >= 10 THEN low_fee END AS low_fee
FROM fx_pred WHERE fast_fee >= 20 OR medium_fee >= 30 OR low_fee >= 10""",
    "chrono_split": f"""
SELECT strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, fast_fee, medium_fee, low_fee,
       CASE WHEN rn <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS part FROM {RANKED}""",
    "lookback_window": f"""
WITH train AS (SELECT * FROM {RANKED} WHERE rn <= floor(n * 0.8))
SELECT strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, fast_fee, medium_fee, low_fee
FROM train WHERE train.timestamp >= (SELECT max(timestamp) FROM train) - INTERVAL 7 DAY""",
    "forecast_eval_mse": f"""
WITH r AS (SELECT *, hour(timestamp) AS h, rn <= floor(n * 0.8) AS tr FROM {RANKED}),
m AS (SELECT h, avg(fast_fee) AS f, avg(medium_fee) AS m, avg(low_fee) AS l FROM r WHERE tr GROUP BY h),
e AS (SELECT avg(pow(fast_fee - f, 2)) AS f, avg(pow(medium_fee - m, 2)) AS m, avg(pow(low_fee - l, 2)) AS l FROM r JOIN m USING (h) WHERE NOT tr),
x AS (SELECT 'fast_fee' AS fee_type, round(f, 6) AS mse FROM e UNION ALL SELECT 'medium_fee', round(m, 6) FROM e UNION ALL SELECT 'low_fee', round(l, 6) FROM e)
SELECT model_name, x.* FROM x, (VALUES ('hour_mean'), ('hour_tree')) v(model_name)""",
    "forest_fold_cells": """
WITH l AS (SELECT * FROM (VALUES ('very_short', 1), ('hourly', 12), ('daily', 168), ('weekly', 672)) v(model_name, hours)),
e AS (SELECT max(timestamp) AS t FROM fx_long),
u AS (SELECT timestamp, 'fast_fee' AS fee_type, fast_fee AS y FROM fx_long UNION ALL SELECT timestamp, 'medium_fee', medium_fee FROM fx_long
      UNION ALL SELECT timestamp, 'low_fee', low_fee FROM fx_long),
r AS (SELECT model_name, fee_type, timestamp, y, row_number() OVER (PARTITION BY model_name, fee_type ORDER BY timestamp) - 1 AS rank,
             count(*) OVER (PARTITION BY model_name, fee_type) AS n FROM u, l, e WHERE timestamp >= t - to_hours(CAST(hours AS BIGINT))),
k AS (SELECT *, least(5, n) AS k FROM r),
f AS (SELECT *, CASE WHEN rank < (n % k) * (n // k + 1) THEN rank // (n // k + 1) ELSE (n % k) + (rank - (n % k) * (n // k + 1)) // (n // k) END AS fold FROM k)
SELECT model_name, fee_type, fold, hour(f.timestamp) AS hour, isodow(f.timestamp) - 1 AS dayofweek, month(f.timestamp) AS month, year(f.timestamp) AS year,
       count(*) AS n, round(sum(y), 6) AS s, round(sum(y * y), 6) AS q FROM f GROUP BY ALL""",
    "model_reload": """
WITH e AS (SELECT max(timestamp) AS t, count(*) AS total FROM fx_long),
s AS (SELECT name, count(f.timestamp) AS points FROM (VALUES ('very_short', 3), ('hourly', 21), ('daily', 180), ('weekly', 365)) v(name, days), e
      JOIN fx_long f ON f.timestamp >= e.t - to_days(days) GROUP BY name)
SELECT 'forest' AS kind, name AS model_name, CAST(48 AS BIGINT) AS rows, CAST(0 AS BIGINT) AS differing, false AS trained_again
FROM (VALUES ('very_short'), ('hourly'), ('daily'), ('weekly')) v(name)
UNION ALL SELECT 'seasonal', name, 48, 0, false FROM s, e WHERE points >= 336 AND total >= 100""",
    "forecast_horizon": """
SELECT strftime(date_trunc('hour', (SELECT max(timestamp) FROM fx_fee)) + to_hours(CAST(i + 1 AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS prediction_time
FROM range(48) r(i)""",
    "order_fees_clamp": f"""
SELECT {PRED}, model_name, CASE WHEN ok THEN round(greatest(greatest(least(l, m, f), m, f), 0), 6) END AS fast_fee,
       CASE WHEN ok THEN round(greatest(greatest(least(l, m, f), least(m, greatest(least(l, m, f), m, f))), 0), 6) END AS medium_fee,
       CASE WHEN ok THEN round(greatest(least(l, m, f), 0), 6) END AS low_fee
FROM (SELECT *, m IS NOT NULL AND f IS NOT NULL AND l IS NOT NULL AS ok FROM {RAW})""",
    "order_fees_sort": f"""
SELECT {PRED}, model_name, CASE WHEN ok THEN round(greatest(s[3], 0), 6) END AS fast_fee,
       CASE WHEN ok THEN round(greatest(s[2], 0), 6) END AS medium_fee, CASE WHEN ok THEN round(greatest(s[1], 0), 6) END AS low_fee
FROM (SELECT *, m IS NOT NULL AND f IS NOT NULL AND l IS NOT NULL AS ok, list_sort([f, m, l]) AS s FROM {RAW})""",
    "predictions_latest": f"""
SELECT {PRED}, model_name, fast_fee, medium_fee, low_fee, strftime(generated_at, '%Y-%m-%d %H:%M:%S') AS generated_at FROM {LATEST}""",
    "prediction_view": f"""
WITH b AS {LATEST}, c AS (SELECT coalesce(max(CASE WHEN model_name = 'hourly' THEN model_name END), min(model_name)) AS name FROM b),
s AS (SELECT b.* FROM b, c WHERE model_name = name)
SELECT {PRED}, model_name, fast_fee, medium_fee, low_fee, strftime(generated_at, '%Y-%m-%d %H:%M:%S') AS generated_at,
       s.prediction_time = (SELECT min(prediction_time) FROM s) AS is_next FROM s""",
    "data_sufficiency": """
WITH e AS (SELECT max(timestamp) AS t, count(*) AS total FROM fx_fee),
l AS (SELECT * FROM (VALUES ('very_short', 3), ('hourly', 21), ('daily', 180), ('weekly', 365)) v(name, days))
SELECT name AS model_name, count(f.timestamp) AS points, CAST(336 AS BIGINT) AS required,
       count(f.timestamp) >= 336 AND max(e.total) >= 100 AS sufficient
FROM l, e LEFT JOIN fx_fee f ON f.timestamp >= e.t - to_days(l.days) GROUP BY name""",
    "rolling_origin_cv": """
WITH w AS (SELECT min(timestamp) AS a, max(timestamp) AS b FROM fx_long),
c AS (SELECT b - INTERVAL 2 DAY - to_days(CAST(15 * i AS INTEGER)) AS cutoff FROM w, range(100000) r(i)
      WHERE b - INTERVAL 2 DAY - to_days(CAST(15 * i AS INTEGER)) >= a + INTERVAL 60 DAY),
p AS (SELECT timestamp, date_diff('hour', (SELECT a FROM w), timestamp) / 24.0::DOUBLE AS x, fast_fee AS y FROM fx_long),
m AS (SELECT cutoff, regr_slope(y, x) AS slope, regr_intercept(y, x) AS level FROM c JOIN p ON p.timestamp <= cutoff GROUP BY cutoff)
SELECT 'straight' AS model_name, strftime(m.cutoff, '%Y-%m-%d %H:%M:%S') AS cutoff, count(*) AS points, round(avg(abs((y - level - slope * x) / y)), 6) AS mape
FROM m JOIN p ON p.timestamp > m.cutoff AND p.timestamp <= m.cutoff + INTERVAL 48 HOUR WHERE y <> 0 GROUP BY m.cutoff""",
    "naive_rolling_cv": """
WITH w AS (SELECT min(timestamp) AS a, max(timestamp) AS b FROM fx_fee),
c AS (SELECT b - INTERVAL 2 DAY - to_days(CAST(5 * i AS INTEGER)) AS cutoff FROM w, range(1000) r(i)
      WHERE b - INTERVAL 2 DAY - to_days(CAST(5 * i AS INTEGER)) >= a + INTERVAL 15 DAY),
m AS (SELECT cutoff, hour(timestamp) AS h, avg(fast_fee) AS guess FROM c JOIN fx_fee ON timestamp <= cutoff GROUP BY ALL)
SELECT strftime(c.cutoff, '%Y-%m-%d %H:%M:%S') AS cutoff, count(*) AS points, round(avg(abs((f.fast_fee - m.guess) / f.fast_fee)), 6) AS mape
FROM c JOIN fx_fee f ON f.timestamp > c.cutoff AND f.timestamp <= c.cutoff + INTERVAL 48 HOUR
JOIN m ON m.cutoff = c.cutoff AND m.h = hour(f.timestamp) WHERE f.fast_fee <> 0 GROUP BY c.cutoff""",
    "retrain_gate": """
WITH g AS (SELECT event_type AS model_name, user_id % 3 AS fee, max(ts) AS trained FROM events GROUP BY ALL)
SELECT model_name, strftime(max(trained), '%Y-%m-%d %H:%M:%S') AS trained_at, count(DISTINCT fee) = 3 AS complete,
       NOT (count(DISTINCT fee) = 3) OR (SELECT max(trained) FROM g) - max(trained) >= INTERVAL 1 HOUR AS retrain
FROM g GROUP BY model_name""",
}

SQL["store_predictions"] = f"""
SELECT {PRED}, model_name, round(greatest(s[3], 0), 6) AS fast_fee, round(greatest(s[2], 0), 6) AS medium_fee, round(greatest(s[1], 0), 6) AS low_fee,
       strftime((SELECT max(timestamp) FROM fx_fee), '%Y-%m-%d %H:%M:%S') AS generated_at
FROM (SELECT *, list_sort([fast_fee, medium_fee, low_fee]) AS s FROM fx_pred WHERE medium_fee IS NOT NULL)"""
