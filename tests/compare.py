"""Run registered queries against their SQL and report differences.

    python tests/compare.py <sf_dir> [name ...]
"""

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(v):
    if v is None:
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def oracle(sf, sql):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(f)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{f}'")
    cur = con.execute(sql)
    return [d[0] for d in cur.description], [str(d[1]) for d in cur.description], cur.fetchall()


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf, names = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = []
    for name in names or queries:
        t = time.time()
        try:
            df = queries[name](spark, sf)
            got = df.collect()
            took = time.time() - t
            if name not in sqls:
                print(f"rows-only {name} rows={len(got)} {took:.1f}s", flush=True)
                continue
            t = time.time()
            cols, types, want = oracle(sf, sqls[name])
            a, b = rows_of(df.columns, got), rows_of(cols, want)
            same = sorted(df.columns) == sorted(cols) and a == b
            print(f"{'OK ' if same else 'BAD'} {name} rows={len(a)}/{len(b)} spark={took:.1f}s sql={time.time() - t:.1f}s", flush=True)
            if not same:
                bad.append(name)
                if sorted(df.columns) != sorted(cols):
                    print("   columns", sorted(df.columns), sorted(cols))
                sa, sb = set(a), set(b)
                print("   spark only", [tuple(x[:90] for x in r) for r in sorted(sa - sb)[:3]])
                print("   sql only  ", [tuple(x[:90] for x in r) for r in sorted(sb - sa)[:3]])
            kinds = dict(zip(sorted(cols), [types[i] for i in sorted(range(len(cols)), key=lambda i: cols[i])]))
            odd = {c: k for c, k in kinds.items() if k.startswith(("HUGEINT", "DECIMAL", "UBIGINT"))}
            if odd:
                print("   types", odd)
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print(f"ERR {name} {type(e).__name__}: {str(e)[:600]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
