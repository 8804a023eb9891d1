"""Run every registered query next to its SQL and compare all values.

    python -m workload.check --sf 0.01 [--only name,name]
"""

from __future__ import annotations

import argparse
import math
import time

import duckdb

from salesmart.session import build_session
from workload import ORACLES, QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float) and value == int(value):
        return int(value)
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(out, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def oracle(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def compare(spark, con, name: str, sf_dir: str, df=None) -> str:
    """'' when equal, else what differs."""
    df = QUERIES[name](spark, sf_dir) if df is None else df
    ours = _rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        return "" if ours[1] else "no rows"
    cursor = con.execute(ORACLES[name])
    theirs = _rows([d[0] for d in cursor.description], cursor.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {set(ours[0]) ^ set(theirs[0])}"
    if len(ours[1]) != len(theirs[1]):
        return f"rows {len(ours[1])} / {len(theirs[1])}"
    if not ours[1]:
        return "both empty"
    wrong = [(a, b) for a, b in zip(ours[1], theirs[1]) if a != b]
    if wrong:
        a, b = wrong[0]
        cells = {c: (x, y) for c, x, y in zip(ours[0], a, b) if x != y}
        return f"{len(wrong)} of {len(ours[1])} rows differ, first: {cells}"
    return ""


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--only", default="")
    args = parser.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = build_session("check", master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle(sf_dir)
    names = [n for n in QUERIES if not args.only or n in args.only.split(",")]
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, name, sf_dir)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(problem)
        kind = "sql " if name in ORACLES else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {time.time() - start:6.1f}s {name} {problem}", flush=True)
    print(f"{len(names) - bad} of {len(names)} fine")


if __name__ == "__main__":
    main()
