"""Oracles of the whale, alert and market queries."""

STAMP = "strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp"
KEPT = "(SELECT txid, sum(value) AS total_sent FROM fx_output GROUP BY txid HAVING sum(sats) >= 25000000)"
SIDES = """
o AS (SELECT txid, list_sort(list(address)) AS outs FROM fx_output GROUP BY txid),
i AS (SELECT txid, list_sort(list(address)) AS ins FROM fx_input GROUP BY txid),
al AS (SELECT w.txid, w.status, w.timestamp, w.total_sent AS btc, w.total_sent * 50000 AS usd,
              CASE WHEN w.custkey <> 7 THEN w.fee_per_vbyte END AS rate, coalesce(i.ins, []) AS ins,
              CASE WHEN w.ok % 7 = 0 THEN list_prepend('bc1q' || lpad(CAST(w.ok AS VARCHAR), 38, '0'), o.outs) ELSE o.outs END AS outs
       FROM fx_whale w LEFT JOIN o ON o.txid = w.txid LEFT JOIN i ON i.txid = w.txid),
ty AS (SELECT *, CASE WHEN rate > 1000 THEN 'MINER_BRIBE'
              WHEN len([a FOR a IN outs IF regexp_matches(a, '^(bc1q\\w{38}|1\\w{33}|3\\w{33})')]) > 0 THEN 'EXCHANGE_FLOW'
              ELSE 'WHALE_MOVE' END AS kind,
              sha256(txid || '-' || CAST(CAST(usd AS DECIMAL(20,2)) AS VARCHAR)) AS hash FROM al),
fired AS (SELECT * FROM ty WHERE rate IS NOT NULL AND outs IS NOT NULL
          AND usd >= CASE kind WHEN 'MINER_BRIBE' THEN 5000000 WHEN 'EXCHANGE_FLOW' THEN 2000000 ELSE 1000000 END)"""
POINTS = """
p AS (SELECT i.address, w.timestamp, w.total_sent AS amount, w.fee_per_vbyte AS rate FROM fx_input i JOIN fx_whale w ON w.txid = i.txid),
busy AS (SELECT p.*, count(*) OVER (PARTITION BY address) AS n, median(amount) OVER (PARTITION BY address) AS am,
                median(rate) OVER (PARTITION BY address) AS rm FROM p),
dev AS (SELECT *, abs(amount - am) AS ad, abs(rate - rm) AS rd FROM busy WHERE n > 10),
mad AS (SELECT *, median(ad) OVER (PARTITION BY address) AS amad, median(rd) OVER (PARTITION BY address) AS rmad FROM dev),
ratio AS (SELECT address, count(*) FILTER (WHERE 0.6745 * ad > 3.5 * amad OR 0.6745 * rd > 3.5 * rmad) / count(*) AS ratio FROM mad GROUP BY address)"""
STORED = "(SELECT * FROM fx_macro WHERE date <= DATE '1999-12-31' AND asset_symbol <> '5-LOW')"

SQL = {
    "unseen_txids": f"SELECT txid FROM fx_tx WHERE status <> 'F' AND txid NOT IN (SELECT txid FROM {KEPT})",
    "whale_filter": f"SELECT txid, round(total_sent, 6) AS total_sent FROM {KEPT}",
    "resolve_inputs": """
SELECT s.spent_in_txid AS txid, o.address, round(o.value, 6) AS value FROM fx_spend s JOIN fx_output o ON o.txid = s.prev_txid AND o.vout = s.prev_vout""",
    "whale_output_rows": f"SELECT txid, address, round(value, 6) AS value FROM fx_output WHERE txid IN (SELECT txid FROM {KEPT})",
    "tx_fee_rate": """
SELECT w.txid, w.vsize, CAST(coalesce(i.s, 0) - o.s AS BIGINT) AS fee_paid, round(CAST(coalesce(i.s, 0) - o.s AS BIGINT) / w.vsize, 6) AS fee_per_vbyte
FROM fx_whale w JOIN (SELECT txid, sum(sats) AS s FROM fx_output GROUP BY txid) o ON o.txid = w.txid
LEFT JOIN (SELECT txid, sum(sats) AS s FROM fx_input GROUP BY txid) i ON i.txid = w.txid""",
    "whale_upsert": """
SELECT txid, strftime(CASE WHEN status = 'O' THEN timestamp + INTERVAL 1 MINUTE ELSE timestamp END, '%Y-%m-%d %H:%M:%S') AS timestamp, size,
       CASE WHEN status = 'O' THEN fee + 100000000 ELSE fee END AS fee_sats, round(total_sent, 6) AS total_sent FROM fx_whale""",
    "evict_mined": """
WITH pool AS (SELECT txid FROM fx_tx WHERE status <> 'F')
SELECT 'whales' AS part, txid, count(*) AS rows FROM fx_whale WHERE txid IN (FROM pool) GROUP BY txid
UNION ALL SELECT 'inputs', txid, count(*) FROM fx_input WHERE txid IN (FROM pool) GROUP BY txid
UNION ALL SELECT 'outputs', txid, count(*) FROM fx_output WHERE txid IN (FROM pool) GROUP BY txid""",
    "whale_behavior": f"""
WITH {POINTS},
g AS (SELECT address, count(*) AS n, avg(amount) AS amount, epoch(max(timestamp)) - epoch(min(timestamp)) AS span FROM p GROUP BY address)
SELECT g.address, n AS txs, CASE WHEN n < 3 THEN 'Insufficient Data' WHEN coalesce(ratio, 0) > 0.3 THEN 'Erratic'
       WHEN n > 5 AND span / (n - 1) < 3600 THEN 'Frequent Trader' WHEN amount >= 100 THEN 'Large Transactor' ELSE 'Normal' END AS behavior_pattern
FROM g LEFT JOIN ratio ON ratio.address = g.address""",
    "tx_anomaly_ratio": f"WITH {POINTS} SELECT address, round(ratio, 6) AS anomaly_ratio FROM ratio",
    "whale_addresses": """
WITH b AS (SELECT address, CAST(sum(value) AS BIGINT) AS balance FROM fx_utxo WHERE NOT spent GROUP BY address)
SELECT i.address, count(*) AS rows, b.balance FROM fx_input i JOIN fx_whale w ON w.txid = i.txid JOIN b ON b.address = i.address
WHERE w.total_sent > 10 AND b.balance >= 500000 GROUP BY i.address, b.balance HAVING count(*) > 3""",
    "whale_balance_snapshot": """
SELECT address, strftime((SELECT max(timestamp) FROM fx_whale), '%Y-%m-%d %H:%M:%S') AS timestamp,
       round(CAST(sum(value) AS BIGINT) / 500000.0::DOUBLE, 6) AS confirmed_balance
FROM fx_utxo WHERE NOT spent GROUP BY address HAVING sum(value) > 0""",
    "whale_transactions_top": f"""
SELECT txid, {STAMP}, size, vsize, weight, fee AS fee_paid, round(fee_per_vbyte, 6) AS fee_per_vbyte, round(total_sent, 6) AS total_sent
FROM fx_whale WHERE total_sent >= 10 ORDER BY fx_whale.timestamp DESC, txid LIMIT 1000""",
    "recent_whales_parsed": f"""
WITH {SIDES}
SELECT txid, {STAMP}, round(btc, 6) AS sum_btc_sent, array_to_string(ins, ',') AS tx_in_addr,
       CASE WHEN len(ins) = 0 THEN '' ELSE array_to_string(outs, ',') END AS tx_out_addr
FROM al WHERE al.timestamp >= (SELECT max(timestamp) FROM al) - INTERVAL 30 DAY""",
    "whale_activity_report": """
WITH s AS (SELECT address, sum(sats) AS v, count(*) AS n FROM fx_input GROUP BY address),
r AS (SELECT address, sum(sats) AS v, count(*) AS n FROM fx_output GROUP BY address)
SELECT 'top_senders' AS section, address AS name, round(v / 500000.0::DOUBLE, 6) AS amount, n AS rows FROM (SELECT * FROM s ORDER BY v DESC, address LIMIT 10)
UNION ALL SELECT 'top_receivers', address, round(v / 500000.0::DOUBLE, 6), n FROM (SELECT * FROM r ORDER BY v DESC, address LIMIT 10)
UNION ALL SELECT 'recurring', s.address, NULL, s.n + r.n FROM s JOIN r ON r.address = s.address
UNION ALL SELECT 'by_hour', CAST(hour(timestamp) AS VARCHAR), round(sum(total_sent), 6), count(*) FROM fx_whale GROUP BY hour(timestamp)""",
    "alert_classify": f"""
WITH {SIDES} SELECT txid, kind AS alert_type, round(usd, 6) AS sum_usd_sent, round(rate, 6) AS fee_per_vbyte FROM fired""",
    "alert_validate": f"WITH {SIDES} SELECT rate IS NOT NULL AND outs IS NOT NULL AS valid, count(*) AS rows FROM al GROUP BY 1",
    "alert_event_hash": f"WITH {SIDES} SELECT txid, hash AS event_hash FROM ty",
    "alert_dedup": f"WITH {SIDES} SELECT txid, kind AS alert_type, hash AS event_hash FROM fired WHERE status <> 'O'",
    "alert_message": f"""
WITH {SIDES}, m AS (SELECT max(timestamp) AS t FROM al),
s AS (SELECT * FROM (VALUES ('WHALE_MOVE', '\U0001F433', 'Whale Move'), ('MINER_BRIBE', '⛏️', 'Miner Bribe'), ('EXCHANGE_FLOW', '\U0001F3E6', 'Exchange Flow')) v(kind, sign, title))
SELECT txid, sign || ' *' || title || ' Alert!* ' || sign || chr(10)
    || '\U0001F4B0 *' || format('{{:.2f}}', btc) || ' BTC* ($' || format('{{:,.2f}}', usd) || ')' || chr(10)
    || '⛽ *Fee Rate:* ' || format('{{:.1f}}', rate) || ' sat/vB' || chr(10)
    || '\U0001F4E5 *From:* ' || array_to_string(ins[1:2], ', ') || '...' || chr(10)
    || '\U0001F4E4 *To:* ' || array_to_string(outs[1:2], ', ') || '...' || chr(10)
    || '\U0001F552 *Time:* ' || strftime(m.t, '%Y-%m-%d %H:%M:%S') || chr(10)
    || '\U0001F517 [View Transaction](https://mempool.space/tx/' || txid || ')' AS message
FROM fired JOIN s ON s.kind = fired.kind, m""",
    "market_latest_date": "SELECT asset_symbol, strftime(max(date), '%Y-%m-%d') AS latest_date FROM fx_macro GROUP BY asset_symbol",
    "market_increment": f"""
WITH l AS (SELECT asset_symbol, max(date) AS latest FROM {STORED} GROUP BY asset_symbol)
SELECT m.asset_symbol, strftime(m.date, '%Y-%m-%d') AS date, round(m.close, 6) AS close FROM fx_macro m LEFT JOIN l ON l.asset_symbol = m.asset_symbol
WHERE l.latest IS NULL OR (m.date > l.latest AND m.date < (SELECT CAST(max(date) AS DATE) FROM fx_tx))""",
    "market_insert_ignore": f"""
SELECT m.asset_symbol, strftime(m.date, '%Y-%m-%d') AS date, round(m.open, 6) AS open, round(m.high, 6) AS high, round(m.low, 6) AS low,
       round(m.close, 6) AS close, m.volume FROM fx_macro m ANTI JOIN {STORED} s ON s.asset_symbol = m.asset_symbol AND s.date = m.date""",
}

SQL["behavior_upsert"] = """
SELECT CAST(user_id AS VARCHAR) AS address, arg_max(event_type, ts) AS behavior_pattern, CAST(epoch_us(max(ts)) AS BIGINT) AS last_updated
FROM events GROUP BY user_id"""
SQL["alert_history"] = f"""
WITH {SIDES}
SELECT strftime((SELECT max(timestamp) FROM fx_whale), '%Y-%m-%d %H:%M:%S') AS timestamp, txid, kind AS alert_type, round(btc, 6) AS amount_btc,
       round(usd, 6) AS amount_usd, round(rate, 6) AS fee_rate FROM fired"""
SQL["stream_alerts"] = f"WITH {SIDES} SELECT txid, kind AS alert_type, hash AS event_hash FROM fired"
SQL["stream_alerts_bounded"] = SQL["stream_alerts"]
