"""Compare registered queries with their SQL on the same files.

    python tests/oracle.py [sf_dir] [name-part ...]
"""

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def kind(type_name):
    t = str(type_name).lower()
    for k, words in {
        "int": ("int", "long", "short"), "float": ("double", "float", "decimal"), "text": ("string", "varchar"),
        "bool": ("bool",), "time": ("timestamp",), "date": ("date",),
    }.items():
        if any(w in t for w in words):
            return k
    return t


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    t1 = time.time()
    if sql is None:
        return f"rows-only {len(got)} rows {t1 - t0:.1f}s", True
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    kinds = {d[0]: kind(d[1]) for d in cur.description}
    want = cur.fetchall()
    t2 = time.time()
    if sorted(df.columns) != sorted(names):
        return f"COLUMNS {sorted(df.columns)} != {sorted(names)}", False
    for f in df.schema.fields:
        if kind(f.dataType.simpleString()) != kinds[f.name]:
            return f"TYPE {f.name} {f.dataType.simpleString()} != {kinds[f.name]}", False
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a != b:
        diff = [x for x in zip(a, b) if x[0] != x[1]][:2]
        return f"MISMATCH rows {len(a)} vs {len(b)}\n   cols {sorted(names)}\n   {str(diff)[:1500]}", False
    return f"ok {len(a)} rows spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s", True


def main():
    from lectern.queries import all_oracles, all_queries
    from lectern.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session("oracle", master="local[8]", shuffle_partitions=8,
                          extra={"spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": "/tmp/lectern-oracle", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracles = all_queries(), all_oracles()
    bad = []
    for name, fn in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            text, ok = compare(spark, con, name, fn, oracles.get(name), sf_dir)
        except Exception as error:  # report and go on
            text, ok = f"ERROR {type(error).__name__} {str(error)[:1500]}", False
        print(name, text, flush=True)
        if not ok:
            bad.append(name)
    print("BAD:", bad)


if __name__ == "__main__":
    main()
