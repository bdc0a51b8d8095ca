"""Runs registered queries next to their SQL twins and compares all values.

    python tools/check.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from parlance.plans import ORACLES, QUERIES  # noqa: E402
from parlance.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name: str, folder: str) -> tuple[bool, str]:
    start = time.time()
    df = QUERIES[name](spark, folder)
    got = rows_of(df.columns, df.collect())
    spent = time.time() - start
    if name not in ORACLES:
        return True, f"{spent:6.2f}s  {len(got)} rows, no SQL"
    start = time.time()
    result = con.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    want = rows_of(columns, result.fetchall())
    other = time.time() - start
    same = sorted(columns) == sorted(df.columns) and got == want
    text = f"{spent:6.2f}s  {len(got)} rows (SQL {other:.2f}s)"
    if not same:
        text += f"\n   columns {sorted(df.columns)} / {sorted(columns)}; SQL rows {len(want)}"
        text += f"\n   only Spark: {[r for r in got if r not in set(want)][:3]}\n   only SQL:   {[r for r in want if r not in set(got)][:3]}"
    return same, text[:3000]


def main() -> None:
    folder, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    bad = []
    for name in names:
        try:
            same, text = compare(spark, con, name, folder)
        except Exception as problem:  # report and go on
            same, text = False, f"{type(problem).__name__}: {str(problem)[:1500]}"
        print("ok  " if same else "FAIL", f"{name:24}", text, flush=True)
        if not same:
            bad.append(name)
    print("failed:", bad)


if __name__ == "__main__":
    main()
