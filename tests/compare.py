"""Run registered queries against their check SQL: python tests/compare.py SF_DIR [key ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir: str, key: str) -> tuple[str, str]:
    start = time.time()
    df = entry.queries()[key](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    took = time.time() - start
    sql = entry.oracle_sql().get(key)
    if sql is None:
        return "rows", f"{len(got)} rows, {took:.1f}s"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return "FAIL", f"columns {sorted(df.columns)} <> {sorted(names)}"
    off = {n: (t, types[n]) for n, t in df.dtypes if TYPES.get(t, t) != types[n]}
    if got != want:
        bad = next(((g, w) for g, w in zip(got, want) if g != w), ("", ""))
        return "FAIL", f"{len(got)} vs {len(want)} rows {off or ''}\n   got  {str(bad[0])[:700]}\n   want {str(bad[1])[:700]}"
    return ("TYPE" if off else "ok"), f"{len(got)} rows, {took:.1f}s {off or ''}"


def main() -> None:
    from faultline.session import local_session

    sf_dir, keys = sys.argv[1], sys.argv[2:] or list(entry.queries())
    spark, con = local_session(), connect(sf_dir)
    spark.sparkContext.setLogLevel("OFF")
    for key in keys:
        try:
            state, note = compare(spark, con, sf_dir, key)
        except Exception as e:
            state, note = "ERROR", str(e)[:700]
        print(f"{state:5} {key}: {note}", flush=True)


if __name__ == "__main__":
    main()
