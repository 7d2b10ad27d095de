"""Oracles of the fee and pattern queries."""

STAMP = "strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp"
NEWEST = "(SELECT max(timestamp) FROM fx_fee)"

SQL = {
    "slot_cluster_checks": """
SELECT count(*) AS slots, CAST(0 AS BIGINT) AS misplaced, CAST(least(3, count(DISTINCT avg_fee || d || h)) AS BIGINT) AS clusters, CAST(0 AS BIGINT) AS moved,
       CAST(0 AS BIGINT) AS other_category FROM fx_slot""",
    "pattern_model_io": "SELECT count(*) AS slots, CAST(0 AS BIGINT) AS differing FROM fx_slot",
    "fee_percentiles": f"SELECT {STAMP}, fast_fee, medium_fee, low_fee FROM fx_fee",
    "fee_fallback": f"""
WITH lv AS (
  SELECT date_trunc('minute', ts) AS timestamp, floor(value) AS fee,
         CAST(sum((CAST(json_extract_string(props, '$.k') AS BIGINT) + 1) * 5000) AS BIGINT) AS vsize FROM events GROUP BY ALL),
run AS (SELECT *, sum(vsize) OVER (PARTITION BY timestamp ORDER BY fee DESC) AS cum FROM lv),
polled AS (
  SELECT timestamp, count(*) AS levels, CAST(sum(vsize) AS DOUBLE) AS total,
         coalesce(nullif(max(fee) FILTER (WHERE cum >= 250000), 0), 1) AS f,
         coalesce(nullif(max(fee) FILTER (WHERE cum >= 500000), 0), 1) AS m,
         coalesce(nullif(max(fee) FILTER (WHERE cum >= 750000), 0), 1) AS l FROM run GROUP BY timestamp),
ticks AS (SELECT unnest(generate_series((SELECT min(timestamp) FROM lv), (SELECT max(timestamp) FROM lv), INTERVAL 1 MINUTE)) AS timestamp),
joined AS (SELECT t.timestamp, p.levels, p.total, p.f, p.m, p.l FROM ticks t LEFT JOIN polled p ON p.timestamp = t.timestamp)
SELECT {STAMP}, levels IS NOT NULL AS fresh,
       coalesce(last_value(f IGNORE NULLS) OVER w, 10) AS fast_fee, coalesce(last_value(m IGNORE NULLS) OVER w, 5) AS medium_fee,
       coalesce(last_value(l IGNORE NULLS) OVER w, 1) AS low_fee, coalesce(last_value(levels IGNORE NULLS) OVER w, 0) AS levels,
       coalesce(last_value(total IGNORE NULLS) OVER w, 0) AS total_vsize
FROM joined WINDOW w AS (ORDER BY joined.timestamp)""",
    "fee_estimation_latest": f"SELECT {STAMP}, fast_fee, medium_fee, low_fee FROM fx_fee ORDER BY fx_fee.timestamp DESC LIMIT 1",
    "fee_histogram_latest": f"""
SELECT {STAMP}, row_number() OVER (ORDER BY fee DESC) - 1 AS pos, fee, CAST(vsize AS DOUBLE) AS vsize
FROM fx_level WHERE timestamp = {NEWEST}""",
    "mempool_congestion": f"""
SELECT {STAMP}, total_vsize, CASE WHEN total_vsize > 5000000 THEN 'High' ELSE 'Low' END AS congestion_status FROM fx_fee""",
    "historical_fees": f"""
SELECT {STAMP}, fast_fee, medium_fee, low_fee FROM fx_fee WHERE fx_fee.timestamp >= {NEWEST} - INTERVAL 72 HOUR""",
    "historical_histograms": f"""
SELECT {STAMP}, levels, CAST(total_vsize AS DOUBLE) AS total_vsize FROM fx_fee WHERE fx_fee.timestamp >= {NEWEST} - INTERVAL 72 HOUR""",
    "historical_predictions": """
SELECT strftime(prediction_time, '%Y-%m-%d %H:%M:%S') AS prediction_time, model_name, fast_fee, medium_fee, low_fee
FROM fx_pred WHERE fx_pred.prediction_time >= (SELECT max(prediction_time) FROM fx_pred) - INTERVAL 72 HOUR""",
    "fee_heatmap": "SELECT short AS day, h AS hour, CAST(avg_fee AS DOUBLE) AS avg_fee FROM fx_heat JOIN fx_day USING (d)",
    "heatmap_stats": """
SELECT CAST(min(avg_fee) AS DOUBLE) AS min_fee, CAST(max(avg_fee) AS DOUBLE) AS max_fee,
       round(avg(CAST(avg_fee AS DOUBLE)), 6) AS mean_fee FROM fx_heat WHERE avg_fee > 0""",
    "projected_blocks": f"""
WITH lv AS (SELECT timestamp, fee, vsize, row_number() OVER (PARTITION BY timestamp ORDER BY fee DESC) AS rn FROM fx_level),
walk AS (
  SELECT timestamp, rn, fee, vsize, vsize AS fill, 0 AS block FROM lv WHERE rn = 1
  UNION ALL
  SELECT l.timestamp, l.rn, l.fee, l.vsize,
         CASE WHEN w.fill + l.vsize > 1000000 AND w.fill > 0 THEN l.vsize ELSE w.fill + l.vsize END,
         CASE WHEN w.fill + l.vsize > 1000000 AND w.fill > 0 THEN w.block + 1 ELSE w.block END
  FROM walk w JOIN lv l ON l.timestamp = w.timestamp AND l.rn = w.rn + 1)
SELECT {STAMP}, CAST(block AS BIGINT) AS block, CAST(sum(vsize) AS BIGINT) AS vsize, min(fee) AS min_fee, max(fee) AS max_fee,
       round(least(CAST(sum(vsize) AS DOUBLE) * 100 / 1000000, 100), 6) AS fill_percent
FROM walk GROUP BY walk.timestamp, block""",
    "histogram_share": f"""
SELECT {STAMP}, fee, vsize, round(vsize * 100 / CAST(sum(vsize) OVER (PARTITION BY fx_level.timestamp) AS DOUBLE), 6) AS percent
FROM fx_level WHERE vsize > 0""",
    "value_insights": """
SELECT strftime((SELECT max(timestamp) FROM fx_whale), '%Y-%m-%d %H:%M:%S') AS generated_at, r.name AS amount_range,
       CAST(coalesce(sum(w.vsize), 0) AS BIGINT) AS total_vsize_bytes,
       round(coalesce(avg(w.fee_per_vbyte), 0), 6) AS avg_fee_per_vbyte, count(w.txid) AS transaction_count
FROM fx_range r LEFT JOIN fx_whale w ON w.total_sent >= r.lo AND w.total_sent < r.hi GROUP BY r.name""",
    "latest_batch_insights": """
WITH b AS (SELECT * FROM fx_whale WHERE date_trunc('month', timestamp) = (SELECT date_trunc('month', max(timestamp)) FROM fx_whale))
SELECT strftime((SELECT date_trunc('month', max(timestamp)) FROM b), '%Y-%m-%d %H:%M:%S') AS generated_at, r.name AS amount_range,
       CAST(coalesce(sum(w.vsize), 0) AS BIGINT) AS total_vsize_bytes,
       round(coalesce(avg(w.fee_per_vbyte), 0), 6) AS avg_fee_per_vbyte, count(w.txid) AS transaction_count,
       CAST(r.pos AS BIGINT) AS display_order
FROM fx_range r LEFT JOIN b w ON w.total_sent >= r.lo AND w.total_sent < r.hi GROUP BY r.name, r.pos""",
    "insight_totals": """
SELECT CAST(sum(vsize) AS BIGINT) AS total_vsize, count(*) AS total_transactions
FROM fx_whale WHERE date_trunc('month', timestamp) = (SELECT date_trunc('month', max(timestamp)) FROM fx_whale)""",
    "slot_grid": """
SELECT d AS day_of_week_num, h AS hour_of_day, CAST(avg_fee AS DOUBLE) AS avg_fee, d || '-' || h AS time_slot_id FROM fx_slot""",
    "cyclical_features": """
SELECT d AS day_of_week_num, h AS hour_of_day, CAST(avg_fee AS DOUBLE) AS avg_fee, d || '-' || h AS time_slot_id,
       round(sin(2 * pi() * h / 24), 6) + 0 AS hour_sin, round(cos(2 * pi() * h / 24), 6) + 0 AS hour_cos,
       round(sin(2 * pi() * d / 7), 6) + 0 AS day_sin, round(cos(2 * pi() * d / 7), 6) + 0 AS day_cos FROM fx_slot""",
    "standardize": """
WITH f AS (SELECT d || '-' || h AS time_slot_id, CAST(avg_fee AS DOUBLE) AS a, sin(2 * pi() * h / 24) AS hs, cos(2 * pi() * h / 24) AS hc,
                  sin(2 * pi() * d / 7) AS ds, cos(2 * pi() * d / 7) AS dc FROM fx_slot),
m AS (SELECT avg(a) AS am, stddev_pop(a) AS asd, avg(hs) AS hsm, stddev_pop(hs) AS hss, avg(hc) AS hcm, stddev_pop(hc) AS hcs,
             avg(ds) AS dsm, stddev_pop(ds) AS dss, avg(dc) AS dcm, stddev_pop(dc) AS dcs FROM f)
SELECT time_slot_id, round((a - am) / asd, 6) + 0 AS avg_fee, round((hs - hsm) / hss, 6) + 0 AS hour_sin,
       round((hc - hcm) / hcs, 6) + 0 AS hour_cos, round((ds - dsm) / dss, 6) + 0 AS day_sin, round((dc - dcm) / dcs, 6) + 0 AS day_cos
FROM f, m""",
    "cluster_categories": """
SELECT d || '-' || h AS time_slot_id, CAST(label AS BIGINT) AS cluster_label, name AS fee_category, mean AS avg_fee_for_category FROM fx_named""",
    "hour_blocks": """
SELECT name AS fee_category, d AS day_of_week_num, mean AS avg_fee_for_category, a AS start_hour, b AS end_hour FROM fx_run""",
    "fee_pattern_latest": f"""
SELECT strftime({NEWEST}, '%Y-%m-%d %H:%M:%S') AS analysis_timestamp, name AS fee_category, d AS day_of_week_num,
       a AS start_hour, b AS end_hour, mean AS avg_fee_for_category FROM fx_run""",
    "low_fee_recommendations": f"""
WITH t AS (SELECT {NEWEST} + to_hours(CAST(i AS INTEGER)) AS at FROM range(24) r(i))
SELECT strftime(t.at, '%Y-%m-%d %H:%M:%S') AS at,
       fx_day.long || ' ' || lpad(CAST(hour(t.at) AS VARCHAR), 2, '0') || ':00 UTC (Avg Fee: ' || CAST(n.avg_fee AS VARCHAR) || ' sat/vB)' AS recommendation
FROM t JOIN fx_named n ON n.d = dayofweek(t.at) AND n.h = hour(t.at) JOIN fx_day ON fx_day.d = n.d WHERE n.name = 'Low Fee'""",
    "pattern_text": """
SELECT name AS fee_category, 'Average Fee: ' || printf('%.2f', mean) || ' sat/vB' AS headline, r.d AS day_of_week_num,
       '  - ' || y.long || ': ' || string_agg(CASE WHEN b = a + 1 THEN printf('%02d:00 UTC', a) ELSE printf('%02d:00-%02d:00 UTC', a, b) END, ', ' ORDER BY a) AS line
FROM fx_run r JOIN fx_day y ON y.d = r.d GROUP BY name, mean, r.d, y.long""",
    "pattern_summary": """
WITH m AS (SELECT name, ((2 * CAST(sum(round(mean * 100)) AS BIGINT) + count(*)) // (2 * count(*))) / 100.0::DOUBLE AS fee FROM fx_run GROUP BY name),
s AS (SELECT DISTINCT name, d, a FROM fx_run),
g AS (SELECT name, d, a, a - row_number() OVER (PARTITION BY name, d ORDER BY a) AS run FROM s),
z AS (SELECT name, d, min(a) AS a, max(a) AS b FROM g GROUP BY name, d, run)
SELECT CASE z.name WHEN 'Low Fee' THEN 'low' WHEN 'Medium Fee' THEN 'medium' ELSE 'high' END AS category, m.fee AS avg_fee,
       z.d AS day_of_week_num,
       y.long || ': ' || string_agg(CASE WHEN b = a THEN printf('%02d:00', a) ELSE printf('%02d:00-%02d:00', a, b) END, ', ' ORDER BY a) || ' UTC' AS times
FROM z JOIN m ON m.name = z.name JOIN fx_day y ON y.d = z.d GROUP BY z.name, m.fee, z.d, y.long""",
}

SQL["fee_snapshot_append"] = f"SELECT {STAMP}, fast_fee, medium_fee, low_fee, levels FROM fx_fee"
SQL["value_insights_append"] = f"SELECT * EXCLUDE (display_order) FROM ({SQL['latest_batch_insights']})"
SQL["fee_pattern_append"] = SQL["fee_pattern_latest"]
SQL["stream_fee_snapshots"] = SQL["fee_percentiles"]
SQL["stream_fee_windows"] = """
WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, timestamp, TIMESTAMP '1970-01-01') AS s, avg(fast_fee) AS fee, count(*) AS polls FROM fx_fee GROUP BY 1)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, strftime(s + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS "end", round(fee, 6) AS avg_fast_fee, polls
FROM w WHERE s + INTERVAL 6 HOUR <= (SELECT max(timestamp) - INTERVAL 1 HOUR FROM fx_fee)"""
SQL["stream_value_insights"] = SQL["value_insights"]
POLLS = """
p AS (SELECT timestamp, fast_fee, hour(timestamp) % 6 = 0 AS held, time_bucket(INTERVAL 6 HOUR, timestamp, TIMESTAMP '1970-01-01') AS s FROM fx_fee),
m AS (SELECT max(timestamp) FILTER (WHERE NOT held) - INTERVAL 12 HOUR AS wm, max(timestamp) - INTERVAL 12 HOUR AS last FROM p)"""
SQL["stream_late_polls"] = f"""
WITH {POLLS}
SELECT CAST(0 AS BIGINT) AS batch, CAST(NULL AS VARCHAR) AS watermark, count(*) AS polls, CAST(0 AS BIGINT) AS late FROM p WHERE NOT held
UNION ALL SELECT 1, strftime(wm, '%Y-%m-%d %H:%M:%S'), count(*), CAST(count_if(s + INTERVAL 6 HOUR <= wm) AS BIGINT) FROM p, m WHERE held GROUP BY wm"""
SQL["stream_late_windows"] = f"""
WITH {POLLS}
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, strftime(s + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS "end", round(avg(fast_fee), 6) AS avg_fast_fee, count(*) AS polls
FROM p, m WHERE s + INTERVAL 6 HOUR <= last AND (NOT held OR s + INTERVAL 6 HOUR > wm) GROUP BY s"""
