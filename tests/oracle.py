"""Runs queries next to their SQL and compares rows without regard to order."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return "null" if v is None else f"{v}"


def compare(spark_df, con, sql: str) -> str | None:
    """None if equal, else what differs."""
    ours = spark_df.collect()
    cols = sorted(spark_df.columns)
    rel = con.sql(sql)
    theirs_cols = list(rel.columns)
    if sorted(theirs_cols) != cols:
        return f"columns {cols} against {sorted(theirs_cols)}"
    a = sorted(tuple(_cell(r[c]) for c in cols) for r in ours)
    at = [theirs_cols.index(c) for c in cols]
    b = sorted(tuple(_cell(r[i]) for i in at) for r in rel.fetchall())
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ in {cols}, first {bad[0]}" if bad else None


def main() -> None:
    import __spark_entry__ as entry
    from hostgauge.session import build_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    sqls = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            if name in sqls:
                found = compare(fn(spark, sf_dir), con, sqls[name])
                what = "ok" if found is None else f"DIFFERS: {found}"
            else:
                what = f"rows only: {fn(spark, sf_dir).count()}"
        except Exception as e:  # noqa: BLE001
            what = f"FAILED: {type(e).__name__}: {str(e)[:1500]}"
        print(f"{name:28s} {time.time() - start:6.1f}s  {what}", flush=True)


if __name__ == "__main__":
    main()
