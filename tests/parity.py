"""Runs queries beside their SQL in DuckDB and compares rows, columns and values."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else str(v) if v is not None and not isinstance(v, (int, str, bool)) else v


def compare(spark, name: str, query, sql: str, sf_dir: str) -> str | None:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = query(spark, sf_dir)
    order = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in order) for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != order:
        return f"{name}: columns {order} and {sorted(names)}"
    want = [tuple(plain(dict(zip(names, r, strict=True))[c]) for c in order) for r in cur.fetchall()]
    key = lambda r: tuple((x is None, str(type(x)), x) if x is not None else (True, "", 0) for x in r)
    got, want = sorted(got, key=key), sorted(want, key=key)
    if got == want:
        return None
    odd = [(a, b) for a, b in zip(got, want, strict=False) if a != b][:3]
    return f"{name}: {len(got)} and {len(want)} rows, {odd}"


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry
    from waymark.session import session

    spark = session("local[4]", 8, **{"spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    for name, sql in entry.oracle_sql().items():
        if len(sys.argv) < 3 or name in sys.argv[2:]:
            try:
                print(name, compare(spark, name, entry.queries()[name], sql, f"/root/testdata/{sys.argv[1]}") or "same", flush=True)
            except Exception as e:  # noqa: BLE001
                print(name, "ERROR", str(e)[:600].replace("\n", " "), flush=True)
