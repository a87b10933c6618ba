"""Compare registered queries with their SQL twins on one data directory: python -m queries.check [dir] [names...]"""

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6f}"
    return str(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((v is None, v or "") for v in r))


def compare(spark, directory, names=None):
    from queries.catalog import ORACLES, QUERIES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{directory}/{t}.parquet'")
    bad = []
    for name, function in QUERIES.items():
        if names and name not in names:
            continue
        began = time.time()
        try:
            df = function(spark, directory)
            got = normal(df.columns, [tuple(r) for r in df.collect()])
            seconds = time.time() - began
            if name not in ORACLES:
                print(f"ROWS {name} rows={len(got[1])} {seconds:.1f}s", flush=True)
                continue
            result = con.execute(ORACLES[name])
            columns = [c[0] for c in result.description]
            kinds = {c[0]: str(c[1]) for c in result.description}
            want = normal(columns, result.fetchall())
            types = {c: (t, kinds.get(c)) for c, t in df.dtypes}
            if got == want:
                print(f"OK   {name} rows={len(got[1])} {seconds:.1f}s {'EMPTY' if not got[1] else ''}", flush=True)
                odd = {c: t for c, t in types.items() if not same_kind(*t)}
                if odd:
                    print("     types", odd)
            else:
                bad.append(name)
                print(f"BAD  {name} columns {got[0]} / {want[0]} rows {len(got[1])} / {len(want[1])}")
                first = [(a, b) for a, b in zip(got[1], want[1]) if a != b][:3]
                print("     ", first)
        except Exception as error:  # noqa: BLE001
            bad.append(name)
            print(f"FAIL {name}: {str(error)[:1500]}", flush=True)
    return bad


def same_kind(spark_type, duck_type):
    pairs = {
        "bigint": ("BIGINT", "NUMBER"), "int": ("INTEGER", "NUMBER"), "string": ("VARCHAR", "STRING"), "double": ("DOUBLE", "NUMBER"),
        "boolean": ("BOOLEAN", "bool"), "date": ("DATE", "Date"),
    }
    return duck_type in pairs.get(spark_type, (duck_type,))


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    target = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    failures = compare(session, target, set(sys.argv[2:]))
    print("failures:", failures)
