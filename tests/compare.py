"""Run registered queries against their SQL: ``python tests/compare.py [folder] [name ...]``."""

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return db


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, bool) or value is None:
        return value
    return round(float(value), 9) if type(value).__name__ == "Decimal" else value


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return names, sorted(plain, key=lambda r: tuple((x is None, str(type(x)), x) if x is not None else (True, "", 0) for x in r))


def check(spark, db, folder, name, queries, oracles):
    start = time.time()
    df = queries[name](spark, folder)
    got = normal(df.columns, df.collect())
    print(f"      {name} spark {time.time() - start:.1f}s", flush=True)
    result = db.execute(oracles[name])
    want = normal([c[0] for c in result.description], result.fetchall())
    return got, want


def main():
    import __spark_entry__ as entry
    from commitloom import session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    spark = session.build("compare", 8)
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(folder)
    bad = 0
    for name in names:
        start = time.time()
        try:
            if name not in oracles:
                print(f"rows  {name} {queries[name](spark, folder).count()} {time.time() - start:.1f}s")
                continue
            got, want = check(spark, db, folder, name, queries, oracles)
        except Exception as error:  # report and go on with the next query
            bad += 1
            print(f"ERROR {name}: {str(error)[:1500]}", flush=True)
            continue
        same = got == want
        bad += not same
        print(f"{'ok   ' if same else 'DIFF '} {name} {len(got[1])} rows {time.time() - start:.1f}s", flush=True)
        if not same:
            print("   columns", got[0], want[0], len(got[1]), len(want[1]))
            g, w = set(got[1]), set(want[1])
            print("   spark only", sorted(g - w, key=repr)[:3])
            print("   sql only  ", sorted(w - g, key=repr)[:3])
    print("missing sql:", sorted(set(queries) - set(oracles)), "unknown:", sorted(set(oracles) - set(queries)))
    print("failures:", bad)


if __name__ == "__main__":
    main()
