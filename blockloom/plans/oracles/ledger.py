"""Oracles of the ledger queries."""

SQL = {
    "ledger_transactions": """
SELECT txid, block_height, timestamp, CASE WHEN status = 'P' THEN 0 ELSE fee END AS fee, size, weight,
       strftime(date, '%Y-%m-%d %H:%M:%S') AS date, txid AS raw_txid, coalesce(i.n, 1) AS raw_inputs, coalesce(o.n, 0) AS raw_outputs
FROM fx_tx LEFT JOIN (SELECT spent_in_txid, count(*) AS n FROM fx_spend GROUP BY 1) i ON i.spent_in_txid = txid
LEFT JOIN (SELECT ok AS line_ok, count(*) AS n FROM fx_line GROUP BY 1) o ON o.line_ok = fx_tx.ok""",
    "ledger_outputs": """
SELECT txid, vout, address, value, block_height, false AS spent, timestamp, output_type FROM fx_utxo""",
    "ledger_spends": "SELECT * FROM fx_spend",
    "output_address": "SELECT output_type, address, count(*) AS outputs FROM fx_utxo GROUP BY ALL",
    "address_received_delta": """
SELECT block_height, address, CAST(sum(value) AS BIGINT) AS delta, min(timestamp) AS timestamp FROM fx_utxo GROUP BY ALL""",
    "mark_spent": "SELECT txid, vout, value, spent, spent_in_txid FROM fx_utxo",
    "upsert_addresses": """
SELECT address, CAST(sum(value) AS BIGINT) AS balance, min(timestamp) AS first_seen, max(timestamp) AS last_seen,
       strftime(to_timestamp(min(timestamp))::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS date_first_seen,
       strftime(to_timestamp(max(timestamp))::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS date_last_seen
FROM fx_utxo GROUP BY address""",
    "price_by_day": """
SELECT t.txid, t.timestamp, coalesce(p.price, 0)::DOUBLE AS btc_price_usd
FROM fx_tx t LEFT JOIN (
  SELECT CAST(o_orderdate AS DATE) AS day, max(CAST(round(o_totalprice * 100) AS BIGINT)) / 100 AS price
  FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) p ON p.day = CAST(t.date AS DATE)""",
    "outputs_from_raw": """
SELECT u.txid, u.vout, u.address, u.value, u.block_height, u.timestamp, u.btc_price_usd::DOUBLE AS btc_price_usd
FROM fx_utxo u JOIN fx_tx t ON t.ok = u.ok WHERE t.status <> 'P' AND u.output_type <> 'script_a'""",
    "spends_from_raw": """
SELECT s.* FROM fx_spend s JOIN fx_tx t ON t.txid = s.spent_in_txid WHERE t.status <> 'P'""",
    "rebuild_balances": """
SELECT address, CAST(sum(value) FILTER (WHERE NOT spent) AS BIGINT) AS balance, max(timestamp) AS last_seen
FROM fx_utxo GROUP BY address HAVING count(*) FILTER (WHERE NOT spent) > 0""",
    "duplicate_txids": """
SELECT txid, count(*) AS cnt FROM fx_utxo GROUP BY txid HAVING count(*) > 1 ORDER BY cnt DESC, txid LIMIT 10""",
    "rollback_block": """
WITH top AS (SELECT max(block_height) AS h FROM fx_tx)
SELECT 'tx' AS part, txid AS key, fee AS value FROM fx_tx, top WHERE block_height <> h
UNION ALL
SELECT 'output', txid || ':' || vout, CASE WHEN spent AND spent_height <> h THEN 1 ELSE 0 END
FROM fx_utxo, top WHERE block_height <> h
UNION ALL
SELECT 'address', address, CAST(coalesce(sum(value) FILTER (WHERE block_height <> h), 0) AS BIGINT)
FROM fx_utxo, top GROUP BY address""",
    "latest_block": "SELECT coalesce(max(block_height), 0) AS latest_block FROM fx_tx",
    "sync_range": """
WITH days AS (SELECT DISTINCT block_height // 144 AS height FROM fx_tx),
     ranked AS (SELECT height, row_number() OVER (ORDER BY height) - 1 AS rn FROM days)
SELECT height FROM ranked WHERE height = rn""",
    "address_balance": """
SELECT address, CAST(coalesce(sum(value) FILTER (WHERE NOT spent), 0) AS BIGINT) AS balance FROM fx_utxo GROUP BY address""",
    "address_balance_lookup": """
SELECT address, CAST(coalesce(sum(value) FILTER (WHERE NOT spent), 0) AS BIGINT) AS balance FROM fx_utxo GROUP BY address""",
    "balance_at_height": """
SELECT address, CAST(coalesce(sum(value) FILTER (WHERE NOT spent OR spent_height > 172800), 0) AS BIGINT) AS balance
FROM fx_utxo WHERE block_height <= 172800 GROUP BY address""",
    "balance_history": """
SELECT address, timestamp, count(*) AS events, CAST(max(balance) AS BIGINT) AS balance
FROM (SELECT address, timestamp, sum(value) OVER (PARTITION BY address ORDER BY timestamp) AS balance FROM fx_change)
GROUP BY address, timestamp""",
    "balance_history_daily": """
SELECT address, strftime(to_timestamp(day * 86400)::TIMESTAMP, '%Y-%m-%d') AS day,
       CAST(sum(net) OVER (PARTITION BY address ORDER BY day) AS BIGINT) AS balance
FROM (SELECT address, timestamp // 86400 AS day, sum(value) AS net FROM fx_change GROUP BY ALL)""",
    "daily_tx_count": "SELECT strftime(date, '%Y-%m-%d') AS day, count(*) AS tx_count FROM fx_tx GROUP BY 1",
    "block_summary": """
SELECT block_height, min(timestamp) AS block_time, count(*) AS tx_count, CAST(sum(fee) AS BIGINT) AS total_fees,
       round(CAST(sum(btc_price_usd) AS BIGINT) / count(*), 4) AS avg_btc_price
FROM fx_tx GROUP BY block_height""",
    "address_history": """
SELECT u.address, t.txid, t.block_height, t.timestamp, 'in' AS direction, u.value, t.fee, t.btc_price_usd::DOUBLE AS btc_price_usd
FROM fx_utxo u JOIN fx_tx t ON u.txid = t.txid
UNION ALL
SELECT u.address, t.txid, t.block_height, t.timestamp, 'out', -u.value, t.fee, t.btc_price_usd::DOUBLE
FROM fx_utxo u JOIN fx_tx t ON u.spent_in_txid = t.txid""",
    "backfill_tx_timestamp": """
SELECT i.txid, i.address, i.sats, strftime((SELECT w.timestamp FROM fx_whale w WHERE w.txid = i.txid), '%Y-%m-%d %H:%M:%S') AS tx_timestamp
FROM fx_input i""",
}
SQL["ledger_resync"] = """
WITH d AS (SELECT DISTINCT block_height FROM fx_tx ORDER BY 1 DESC LIMIT 2),
t AS (SELECT * FROM fx_tx WHERE block_height NOT IN (FROM d) OR ok % 2 = 0),
o AS (SELECT u.address, u.value, t.timestamp, u.spent AND u.spent_in_txid IN (SELECT txid FROM t) AS spent FROM fx_utxo u JOIN t ON t.txid = u.txid)
SELECT address, CAST(sum(value) AS BIGINT) AS balance, min(timestamp) AS first_seen, max(timestamp) AS last_seen, count(*) AS outputs,
       CAST(count_if(spent) AS BIGINT) AS spent FROM o GROUP BY address"""
