"""Oracles of the graph and entity queries. The graph ones write out every address pair, which suits small inputs only."""

# Every pair of addresses of a transaction with its two weights in tenths, then per address pair.
PAIRS = """
top AS (SELECT txid, vout, count(*) OVER (PARTITION BY txid) AS outs,
               row_number() OVER (PARTITION BY txid ORDER BY sats DESC, vout) AS place, address FROM fx_output),
mem AS (SELECT txid, address, CAST(sum(i) AS BIGINT) AS ins, CAST(sum(c) AS BIGINT) AS changes FROM (
          SELECT txid, address, 1 AS i, 0 AS c FROM fx_input
          UNION ALL SELECT txid, address, 0, 1 FROM top WHERE outs > 1 AND place > 1) GROUP BY ALL),
pair AS (SELECT a.address AS x, b.address AS y, CAST(sum(10 * a.ins * b.ins) AS BIGINT) AS common,
                CAST(sum(7 * (a.ins * b.changes + b.ins * a.changes)) AS BIGINT) AS change
         FROM mem a JOIN mem b ON a.txid = b.txid AND a.address < b.address GROUP BY ALL
         HAVING sum(a.ins * b.ins + a.ins * b.changes + b.ins * a.changes) > 0),
linked AS (SELECT DISTINCT m.txid FROM mem m JOIN mem n ON m.txid = n.txid AND m.address <> n.address WHERE m.ins > 0),
sig AS (SELECT address, string_agg(txid || ':' || ins || ':' || changes, ',' ORDER BY txid) AS s FROM mem WHERE txid IN (FROM linked) GROUP BY address),
twin AS (SELECT address, min(address) OVER (PARTITION BY s) AS node FROM sig)"""


def folded(weight: str, extra: str = "") -> str:
    return f"""
WITH {PAIRS}
SELECT least(a.node, b.node) AS src, greatest(a.node, b.node) AS dst, count(*) AS pairs, max({weight}) / 10 AS weight{extra}
FROM pair JOIN twin a ON a.address = pair.x JOIN twin b ON b.address = pair.y WHERE {weight} > 0
GROUP BY 1, 2 HAVING min({weight}) = max({weight})"""


ENDS = "ends AS (SELECT x AS a, y AS b FROM pair UNION ALL SELECT y, x FROM pair), deg AS (SELECT a, count(*) AS d FROM ends GROUP BY a)"
COEFF = """
tri AS (SELECT e.a, count(*) AS t FROM ends e JOIN ends f ON e.a = f.a AND e.b < f.b JOIN pair p ON p.x = e.b AND p.y = f.b GROUP BY e.a),
cc AS (SELECT deg.a, CASE WHEN d < 2 THEN 0 ELSE 2 * coalesce(t, 0) / (d * (d - 1)) END AS cc FROM deg LEFT JOIN tri ON tri.a = deg.a),
nd AS (SELECT ends.a, avg(o.d) AS nd FROM ends JOIN deg o ON o.a = ends.b GROUP BY ends.a)"""
ACT = """
act AS (SELECT address, count(*) AS n, epoch(min(t)) AS a, epoch(max(t)) AS b FROM (
          SELECT address, tx_timestamp AS t FROM fx_input UNION ALL SELECT address, tx_timestamp FROM fx_output) GROUP BY address),
clock AS (SELECT max(timestamp + ok % 86400) AS now FROM fx_tx)"""
OWNER = "own AS (SELECT l.address, min(t.custkey) AS owner FROM fx_line l JOIN fx_tx t ON t.ok = l.ok GROUP BY l.address)"
CLUSTER_ID = "substr(sha256(concat_ws(',', count(*), " + ", ".join(
    f"sum(CAST('0x' || substr(sha256(address), {1 + 8 * i}, 8) AS BIGINT))" for i in range(8)) + ")), 1, 16)"
STAR = """
e AS (SELECT DISTINCT a.address AS x, b.address AS y FROM fx_input a JOIN fx_input b ON a.txid = b.txid AND a.address <> b.address),
reach AS (SELECT DISTINCT x AS node, x AS label FROM e UNION SELECT e.y, reach.label FROM reach JOIN e ON e.x = reach.node)"""

ENTITY = """
a AS (SELECT address, sum(value) AS v, count(DISTINCT txid) AS txs, min(t) AS a, max(t) AS b FROM (
        SELECT address, value, txid, epoch(tx_timestamp) AS t FROM fx_input UNION ALL SELECT address, value, txid, epoch(tx_timestamp) FROM fx_output) GROUP BY address),
g AS (SELECT owner, count(*) AS n, sum(v) AS v, CAST(sum(txs) AS BIGINT) AS txs, min(a) AS a, max(b) AS b FROM own JOIN a ON a.address = own.address GROUP BY owner),
c AS (SELECT max(timestamp + ok % 86400) AS now FROM fx_tx),
k AS (SELECT g.*, now - b AS idle, v / n AS mean, txs / greatest((now - a) / 86400, 1) AS freq, v / greatest((now - a) / 86400, 1) AS day FROM g, c)"""
LABEL = """CASE WHEN n > 1000 THEN 'exchange_entity'
  WHEN mean > 1000 THEN CASE WHEN freq < 0.1 THEN 'dormant_whale' WHEN freq > 20 THEN 'exchange_hot_wallet' WHEN day > 5000 THEN 'whale_accumulator' ELSE 'institutional' END
  WHEN freq > 10 THEN CASE WHEN day > 1000 THEN 'payment_processor' ELSE 'retail_active' END
  WHEN n > 50 THEN CASE WHEN day > 500 THEN 'mining_pool' ELSE 'shared_custody' END
  WHEN idle > 7776000 THEN 'dormant' ELSE 'retail' END"""
FEATURES = "degree clustering_coefficient avg_neighbor_degree tx_count lifetime_sec recency_sec active_duration_sec avg_dwell_sec".split()


def density(source: str, columns: list[str]) -> str:
    """CTEs from a table of points (address, columns): scaled, the median distance to the nearest other distinct point as reach, and ``dense`` (component, address)
    with the components of points within it."""
    scaled = ", ".join(f"CASE WHEN stddev_pop({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () ELSE 0 END AS {c}" for c in columns)
    gap = " + ".join(f"(p.{c} - q.{c}) * (p.{c} - q.{c})" for c in columns)
    same = ", ".join(columns)
    return f"""
z AS (SELECT address, {scaled} FROM {source}),
pt AS (SELECT row_number() OVER () AS i, min(address) AS first, count(*) AS n, {same} FROM z GROUP BY {same}),
nn AS (SELECT p.i, min({gap}) AS gap FROM pt p JOIN pt q ON p.i <> q.i GROUP BY p.i),
lim AS (SELECT coalesce(quantile_disc(gap, 0.5), 0) * (1 + 1e-9) AS lim FROM nn),
near AS MATERIALIZED (SELECT p.i AS a, q.i AS b FROM pt p JOIN pt q ON p.i <> q.i, lim WHERE {gap} <= lim),
lab(node, label) USING KEY (node) AS (
  SELECT i, first FROM pt UNION SELECT near.b, min(lab.label) FROM lab JOIN near ON near.a = lab.node JOIN recurring.lab AS cur ON cur.node = near.b
  WHERE lab.label < cur.label GROUP BY near.b),
dense AS (SELECT label AS component, address FROM z JOIN pt USING ({same}) JOIN lab ON lab.node = pt.i
          WHERE label IN (SELECT label FROM lab JOIN pt ON pt.i = lab.node GROUP BY label HAVING sum(n) > 1))"""


FEAT = f"""{PAIRS}, {ENDS}, {COEFF}, {ACT},
feat AS (SELECT deg.a AS address, CAST(d AS DOUBLE) AS degree, CAST(cc AS DOUBLE) AS clustering_coefficient, nd AS avg_neighbor_degree,
  CAST(n AS DOUBLE) AS tx_count, CAST(now - act.a AS DOUBLE) AS lifetime_sec, CAST(now - act.b AS DOUBLE) AS recency_sec,
  CAST(act.b - act.a AS DOUBLE) AS active_duration_sec, CAST(CASE WHEN n > 1 THEN (act.b - act.a) / (n - 1) ELSE 0 END AS DOUBLE) AS avg_dwell_sec
  FROM deg JOIN cc ON cc.a = deg.a JOIN nd ON nd.a = deg.a JOIN act ON act.address = deg.a, clock)"""
# The same over the transactions that hold a new address.
RELATED = FEAT.replace("fx_input", "rin").replace("fx_output", "rout")
SQL = {
    "density_clusters": f"WITH {FEAT}, {density('feat', FEATURES)} SELECT component, address FROM dense",
    "edges_common_input": folded("common"),
    "edges_change": folded("change"),
    "address_graph": folded("(common + change)", """,
       concat_ws(',', CASE WHEN max(change) > 0 THEN 'change_detection' END, CASE WHEN max(common) > 0 THEN 'common_input' END) AS types"""),
    "graph_degree": f"WITH {PAIRS}, {ENDS} SELECT a AS address, d AS degree FROM deg",
    "clustering_coefficient": f"WITH {PAIRS}, {ENDS}, {COEFF} SELECT a AS address, round(cc, 6) AS clustering_coefficient FROM cc",
    "avg_neighbor_degree": f"WITH {PAIRS}, {ENDS}, {COEFF} SELECT a AS address, round(nd, 6) AS avg_neighbor_degree FROM nd",
    "neighbour_degrees": f"WITH {PAIRS}, {ENDS}, {COEFF} SELECT deg.a AS address, d AS degree, round(nd, 6) AS avg_neighbor_degree FROM deg JOIN nd ON nd.a = deg.a",
    "address_activity": f"""
WITH {ACT}
SELECT address, n AS tx_count, now - a AS lifetime_sec, now - b AS recency_sec, b - a AS active_duration_sec,
       round(CASE WHEN n > 1 THEN (b - a) / (n - 1) ELSE 0 END, 6) AS avg_dwell_sec FROM act, clock""",
    "address_features": f"""
WITH {PAIRS}, {ENDS}, {COEFF}, {ACT}
SELECT deg.a AS address, CAST(d AS DOUBLE) AS degree, round(cc, 6) AS clustering_coefficient, round(nd, 6) AS avg_neighbor_degree,
       CAST(n AS DOUBLE) AS tx_count, now - act.a AS lifetime_sec, now - act.b AS recency_sec, act.b - act.a AS active_duration_sec,
       round(CASE WHEN n > 1 THEN (act.b - act.a) / (n - 1) ELSE 0 END, 6) AS avg_dwell_sec
FROM deg JOIN cc ON cc.a = deg.a JOIN nd ON nd.a = deg.a JOIN act ON act.address = deg.a, clock""",
    "entity_components": f"WITH {STAR} SELECT node, min(label) AS component FROM reach GROUP BY node",
    "merge_overlaps": """
WITH RECURSIVE ends AS (SELECT l.address, min(t.custkey) AS lo, max(t.custkey) AS hi FROM fx_line l JOIN fx_tx t ON t.ok = l.ok GROUP BY l.address),
r AS (SELECT 'low' || lo AS c, address FROM ends UNION ALL SELECT 'high' || hi, address FROM ends),
z AS (SELECT c, count(*) AS n FROM r GROUP BY c),
s AS (SELECT a.c AS src, b.c AS dst, count(*) AS shared FROM r a JOIN r b ON a.address = b.address AND a.c < b.c GROUP BY ALL),
p AS (SELECT src, dst FROM s JOIN z x ON x.c = src JOIN z y ON y.c = dst WHERE shared / (x.n + y.n - shared) > 0.3),
e AS (SELECT src AS a, dst AS b FROM p UNION SELECT dst, src FROM p),
reach(node, label) AS (SELECT c, c FROM z UNION SELECT e.b, reach.label FROM reach JOIN e ON e.a = reach.node),
m AS (SELECT node, min(label) AS component FROM reach GROUP BY node)
SELECT DISTINCT component, address FROM r JOIN m ON m.node = r.c""",
    "cluster_id": f"""
WITH {OWNER} SELECT CAST(owner AS VARCHAR) AS component, substr(sha256(string_agg(address, ',' ORDER BY address)), 1, 16) AS cluster_id, count(*) AS cluster_size
FROM own GROUP BY owner""",
    "min_size_filter": f"""
WITH {OWNER} SELECT CAST(owner AS VARCHAR) AS component, address FROM own WHERE owner IN (SELECT owner FROM own GROUP BY owner HAVING count(*) >= 2)""",
    "entity_type": f"""
WITH {OWNER}, {ENTITY}
SELECT CAST(owner AS VARCHAR) AS cluster_id, n AS cluster_size, round(v, 6) AS value, txs, {LABEL} AS entity_type FROM k""",
    "clustering_job": f"""
WITH {FEAT}, {density('feat', FEATURES)}, own AS (SELECT component AS owner, address FROM dense), {ENTITY},
id AS (SELECT owner, {CLUSTER_ID} AS cluster_id FROM own GROUP BY owner),
t AS (SELECT strftime(to_timestamp(now)::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS t FROM c)
SELECT cluster_id, {LABEL} AS entity_type, n AS cluster_size, t.t AS first_seen, t.t AS last_active FROM k JOIN id ON id.owner = k.owner, t""",
    "incremental_clusters": f"""
WITH {OWNER},
known AS (SELECT address, owner FROM own WHERE address IN (SELECT o.address FROM fx_output o JOIN fx_tx t ON t.txid = o.txid WHERE t.status = 'F')),
sides AS (SELECT txid, address FROM fx_input UNION ALL SELECT txid, address FROM fx_output),
fresh AS (SELECT DISTINCT address FROM sides WHERE txid IN (SELECT txid FROM fx_tx WHERE status <> 'F') AND address NOT IN (SELECT address FROM known)),
rel AS (SELECT DISTINCT txid FROM sides WHERE address IN (FROM fresh)),
rin AS (SELECT * FROM fx_input WHERE txid IN (FROM rel)), rout AS (SELECT * FROM fx_output WHERE txid IN (FROM rel)),
{RELATED}, mine AS (SELECT * FROM feat WHERE address IN (FROM fresh)), {density('mine', FEATURES)},
every AS (SELECT 'old:' || owner AS component, address FROM known UNION ALL SELECT 'new:' || component, address FROM dense)
SELECT component, address FROM every WHERE component IN (SELECT component FROM every GROUP BY component HAVING count(*) >= 2)""",
    "current_clusters": f"WITH {OWNER} SELECT CAST(owner AS VARCHAR) AS cluster_id, count(*) AS members, min(address) AS first_member FROM own GROUP BY owner",
    "cluster_history": f"""
WITH {OWNER},
p AS (SELECT owner AS k, {CLUSTER_ID} AS id FROM own GROUP BY owner),
q AS (SELECT owner // 2 AS k, {CLUSTER_ID} AS id FROM own GROUP BY owner // 2)
SELECT q.id AS cluster_id, p.id AS parent_id, address, CAST(2 AS BIGINT) AS version,
       strftime((SELECT to_timestamp(max(timestamp + ok % 86400))::TIMESTAMP FROM fx_tx), '%Y-%m-%d %H:%M:%S') AS timestamp
FROM own JOIN p ON p.k = own.owner JOIN q ON q.k = own.owner // 2""",
    "graph_sample": f"""
WITH {PAIRS}, {ENDS}, {OWNER}
SELECT a AS id, coalesce(CAST(owner AS VARCHAR), 'unclustered') AS "group", d AS degree
FROM (SELECT * FROM deg ORDER BY d DESC, a LIMIT 500) t LEFT JOIN own ON own.address = t.a""",
    "graph_sample_links": f"""
WITH {PAIRS}, {ENDS}, t AS (SELECT a FROM deg ORDER BY d DESC, a LIMIT 500)
SELECT x AS source, y AS target, (common + change) / 10 AS weight FROM pair WHERE x IN (FROM t) AND y IN (FROM t)""",
}

SQL["store_clusters"] = f"""
WITH {OWNER},
p AS (SELECT {CLUSTER_ID} AS id FROM own GROUP BY owner)
SELECT {CLUSTER_ID} AS cluster_id, count(*) AS cluster_size
FROM own GROUP BY owner // 2 HAVING {CLUSTER_ID} NOT IN (FROM p)"""
