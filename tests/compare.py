"""Compare registered queries with their DuckDB oracles: ``python tests/compare.py [sf] [key ...]``."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def frames_differ(got, want) -> str:
    """Empty text when both pandas frames hold the same rows in any order."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    columns = sorted(got.columns)
    if len(got) == len(want):
        got, want = got.copy(), want.copy()
        for c in columns:  # a whole number with nulls comes as another type from each side
            whole = [str(frame[c].dtype).lower() in ("int64", "float64") or frame[c].isna().all() for frame in (got, want)]
            if all(whole) and str(got[c].dtype) != str(want[c].dtype) and (got[c].isna().any() or want[c].isna().any()):
                got[c], want[c] = got[c].astype("Float64"), want[c].astype("Float64")
    kinds = [(c, str(got[c].dtype), str(want[c].dtype)) for c in columns if str(got[c].dtype) != str(want[c].dtype)]
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    if kinds and len(got):
        return f"types {kinds}"
    def ordered(frame):
        return sorted(map(tuple, frame[columns].astype(str).values.tolist()))

    a, b = ordered(got), ordered(want)
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(bad)} rows differ, columns {columns}, first {bad[0]}"
    return ""


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def main() -> int:
    from blockloom.session import build_session
    import __spark_entry__ as driver

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    cores = os.environ.get("CHECK_CORES", "8")
    spark = build_session("compare", f"local[{cores}]", **{
        "spark.sql.shuffle.partitions": cores, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failed = duck(sf_dir), driver.oracle_sql(), []
    keys = sys.argv[2:] or list(driver.queries())
    for key in keys:
        start = time.time()
        try:
            got = driver.queries()[key](spark, sf_dir).toPandas()
            spent = time.time() - start
            note = ""
            if key in sqls:
                begin = time.time()
                note = frames_differ(got, con.execute(sqls[key]).df())
                spent_sql = time.time() - begin
            else:
                spent_sql = float("nan")
        except Exception as error:  # noqa: BLE001 - a failing key must not stop the report
            got, spent, spent_sql, note = [], time.time() - start, float("nan"), f"{type(error).__name__}: {str(error)[:1500]}"
        status = "FAIL" if note else ("ok" if key in sqls else "rows")
        if note:
            failed.append(key)
        print(f"{status:5} {key:28} rows={len(got):7} spark={spent:6.2f}s duckdb={spent_sql:5.2f}s {note}", flush=True)
    print("failed:", failed)
    return len(failed)


if __name__ == "__main__":
    sys.exit(main())
