"""Common table expressions behind the oracles."""

TABLES = {
    "fx_tx": """
SELECT 'tx' || o_orderkey AS txid, o_orderkey AS ok, o_custkey AS custkey, o_orderstatus AS status,
       CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) * 144 AS BIGINT) AS block_height,
       CAST(epoch(o_orderdate) AS BIGINT) AS timestamp, o_orderdate AS date,
       CAST(round(o_totalprice * 100) AS BIGINT) % 100000 AS fee,
       CAST(200 + o_orderkey % 800 AS BIGINT) AS size, CAST(150 + o_orderkey % 600 AS BIGINT) AS vsize,
       CAST(4 * (150 + o_orderkey % 600) AS BIGINT) AS weight,
       CAST(20000 + o_custkey % 50000 AS BIGINT) AS btc_price_usd
FROM orders""",
    "fx_line": """
SELECT l_orderkey AS ok, 'tx' || l_orderkey AS txid,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice,
            l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) - 1 AS BIGINT) AS vout,
       CASE WHEN l_suppkey % 5 = 0 THEN 'w' || l_suppkey || '_' || (l_orderkey // 500)
            ELSE 'a' || l_partkey || '_' || (l_orderkey // 8) END AS address,
       CAST(round(l_extendedprice * 100) AS BIGINT) AS value, 'script_' || lower(l_returnflag) AS output_type,
       CASE WHEN l_linestatus = 'F' THEN l_orderkey + 1 + l_partkey % 97 END AS spender
FROM lineitem""",
    "fx_utxo": """
SELECT l.txid, l.ok, l.vout, l.address, l.value, c.block_height, c.timestamp, c.btc_price_usd, l.output_type, c.date,
       s.txid IS NOT NULL AS spent, s.txid AS spent_in_txid, s.ok AS spender, s.timestamp AS spent_time,
       s.block_height AS spent_height
FROM fx_line l JOIN fx_tx c ON c.ok = l.ok LEFT JOIN fx_tx s ON s.ok = l.spender AND s.timestamp > c.timestamp""",
    "fx_spend": "SELECT txid AS prev_txid, vout AS prev_vout, spent_in_txid FROM fx_utxo WHERE spent",
    "fx_change": """
SELECT address, timestamp, value FROM fx_utxo UNION ALL SELECT address, spent_time, -value FROM fx_utxo WHERE spent""",
    "fx_whale": """
SELECT t.txid, t.ok, t.custkey, t.status, to_timestamp(epoch(t.date) + t.ok % 86400)::TIMESTAMP AS timestamp,
       t.size, t.vsize, t.weight, t.fee, t.fee / 1e8 AS fee_paid, t.fee / t.vsize AS fee_per_vbyte,
       s.sent / 500000.0::DOUBLE AS total_sent, t.btc_price_usd AS btcusd
FROM fx_tx t JOIN (SELECT ok, CAST(sum(value) AS BIGINT) AS sent FROM fx_line GROUP BY ok) s ON s.ok = t.ok""",
    "fx_input": """
SELECT spent_in_txid AS txid, address, value AS sats, value / 500000.0::DOUBLE AS value, txid AS prev_txid, vout AS prev_vout,
       to_timestamp(spent_time + spender % 86400)::TIMESTAMP AS tx_timestamp
FROM fx_utxo WHERE spent""",
    "fx_output": """
SELECT txid, vout, address, value AS sats, value / 500000.0::DOUBLE AS value,
       to_timestamp(timestamp + ok % 86400)::TIMESTAMP AS tx_timestamp FROM fx_utxo""",
    "fx_level": """
SELECT date_trunc('hour', ts) AS timestamp, floor(value) AS fee,
       CAST(sum((CAST(json_extract_string(props, '$.k') AS BIGINT) + 1) * 5000) AS BIGINT) AS vsize
FROM events GROUP BY ALL""",
    "fx_running": """
SELECT timestamp, fee, vsize, CAST(sum(vsize) OVER (PARTITION BY timestamp ORDER BY fee DESC) AS BIGINT) AS cum FROM fx_level""",
    "fx_fee": """
SELECT timestamp, count(*) AS levels, CAST(sum(vsize) AS BIGINT) AS total_vsize,
       coalesce(nullif(max(fee) FILTER (WHERE cum >= 250000), 0), 1) AS fast_fee,
       coalesce(nullif(max(fee) FILTER (WHERE cum >= 500000), 0), 1) AS medium_fee,
       coalesce(nullif(max(fee) FILTER (WHERE cum >= 750000), 0), 1) AS low_fee
FROM fx_running GROUP BY timestamp""",
    "fx_long": """
SELECT o_orderdate + to_hours(CAST(o_orderkey % 24 AS BIGINT)) AS timestamp, max(c) / 500000.0::DOUBLE AS fast_fee,
       CAST(sum(c) AS DOUBLE) / count(*) / 500000 AS medium_fee, min(c) / 500000.0::DOUBLE AS low_fee
FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders) GROUP BY 1""",
    "fx_heat": """
SELECT CAST(dayofweek(timestamp) AS BIGINT) AS d, CAST(hour(timestamp) AS BIGINT) AS h,
       CAST(avg(fast_fee) AS DECIMAL(10,1)) AS avg_fee
FROM fx_fee WHERE timestamp >= (SELECT max(timestamp) FROM fx_fee) - INTERVAL 14 DAY GROUP BY ALL""",
    "fx_slot": """
SELECT g.d, g.h, coalesce(m.avg_fee, 0)::DECIMAL(10,1) AS avg_fee
FROM (SELECT i // 24 AS d, i % 24 AS h FROM range(168) r(i)) g LEFT JOIN
     (SELECT dayofweek(timestamp) AS d, hour(timestamp) AS h, CAST(avg(fast_fee) AS DECIMAL(10,1)) AS avg_fee
      FROM fx_fee WHERE timestamp >= (SELECT max(timestamp) FROM fx_fee) - INTERVAL 21 DAY GROUP BY ALL) m
     ON m.d = g.d AND m.h = g.h""",
    "fx_tile": "SELECT d, h, avg_fee, ntile(3) OVER (ORDER BY avg_fee, d, h) AS label FROM fx_slot",
    "fx_named": """
SELECT t.d, t.h, t.avg_fee, t.label, c.name, c.mean
FROM fx_tile t JOIN (
  SELECT label, ['Low Fee', 'Medium Fee', 'High Fee'][row_number() OVER (ORDER BY avg(avg_fee), label)] AS name,
         ((20 * CAST(sum(avg_fee * 10) AS BIGINT) + count(*)) // (2 * count(*))) / 100.0::DOUBLE AS mean
  FROM fx_tile GROUP BY label) c ON c.label = t.label""",
    "fx_run": """
SELECT name, mean, d, min(h) AS a, max(h) + 1 AS b
FROM (SELECT *, h - row_number() OVER (PARTITION BY name, d ORDER BY h) AS run FROM fx_named)
GROUP BY name, mean, d, run""",
    "fx_day": """
SELECT i AS d, ['Sunday', 'Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday'][i + 1] AS long,
       ['Sun', 'Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat'][i + 1] AS short FROM range(7) r(i)""",
    "fx_range": """
SELECT * FROM (VALUES ('0-1 BTC', 0, 1, 1), ('1-10 BTC', 1, 10, 2), ('10-50 BTC', 10, 50, 3), ('50-100 BTC', 50, 100, 4),
       ('>100 BTC', 100, 1e18, 5)) r(name, lo, hi, pos)""",
    "fx_pred": """
SELECT prediction_time, model_name, fast_fee, CASE WHEN last_fee < 100 THEN last_fee END AS medium_fee, low_fee,
       date_trunc('day', prediction_time) AS generated_at
FROM (SELECT date_trunc('hour', ts) AS prediction_time, event_type AS model_name, max(value) AS fast_fee,
             min(value) AS low_fee, arg_max(value, event_id) AS last_fee FROM events GROUP BY ALL)""",
    "fx_macro": """
SELECT o_orderpriority AS asset_symbol, CAST(o_orderdate AS DATE) AS date,
       arg_min(CAST(round(o_totalprice * 100) AS BIGINT), o_orderkey) / 100 AS open, max(CAST(round(o_totalprice * 100) AS BIGINT)) / 100 AS high,
       min(CAST(round(o_totalprice * 100) AS BIGINT)) / 100 AS low, arg_max(CAST(round(o_totalprice * 100) AS BIGINT), o_orderkey) / 100 AS close,
       CASE WHEN count(*) > 1 THEN CAST(count(*) AS DOUBLE) END AS volume
FROM orders GROUP BY ALL""",
}
