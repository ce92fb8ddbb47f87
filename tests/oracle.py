"""Run named queries next to their DuckDB text and compare: python tests/oracle.py [folder] [name…]"""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, con, folder, fn, sql):
    """None when equal, else a short description. Values must be equal exactly, types included."""
    df = fn(spark, folder)
    mine = _rows(df.columns, [tuple(r) for r in df.collect()])
    ran = con.execute(sql)
    columns = [d[0] for d in ran.description]
    theirs = _rows(columns, ran.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} / {sorted(columns)}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} / {len(theirs)}"
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b or [type(x) for x in a] != [type(x) for x in b]]
    return f"{len(bad)} of {len(mine)} rows differ, first {bad[0]}" if bad else None


def main():
    import __spark_entry__ as contract
    from lotwise.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session(
        "oracle", master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="10g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, failed = connect(folder), contract.oracle_sql(), 0
    for name, fn in contract.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        started = time.time()
        try:
            if name in oracles:
                problem = differences(spark, con, folder, fn, oracles[name])
            else:
                problem = None if fn(spark, folder).count() > 0 else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        kind = "sql" if name in oracles else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {kind:4} {time.time() - started:6.1f}s {name} {problem or ''}", flush=True)
        spark.catalog.clearCache()
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(bool(main()))
