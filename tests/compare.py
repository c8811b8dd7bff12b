"""Compare a Spark result with the DuckDB answer of the same question: names, types and values, any row order."""

from __future__ import annotations

import math
import os
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "date": "DATE",
         "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "array<string>": "VARCHAR[]", "smallint": "SMALLINT"}


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, Decimal):
        return ("n", format(v.normalize(), "f") if v else "0")
    if isinstance(v, float):
        return ("f", "nan" if math.isnan(v) else repr(v + 0.0))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v if v is None else str(v)


def differences(df, con, sql: str) -> list[str]:
    out = []
    rel = con.sql(sql)
    names = sorted(df.columns)
    if names != sorted(rel.columns):
        return [f"columns {names} != {sorted(rel.columns)}"]
    duck_types = dict(zip(rel.columns, map(str, rel.types), strict=True))
    for f in df.schema.fields:
        want = f.dataType.simpleString()
        want = TYPES.get(want, want.upper())
        if want != duck_types[f.name]:
            out.append(f"type {f.name}: {want} != {duck_types[f.name]}")
    left = Counter(tuple(plain(r[n]) for n in names) for r in df.collect())
    order = [rel.columns.index(n) for n in names]
    right = Counter(tuple(plain(r[i]) for i in order) for r in rel.fetchall())
    if left != right:
        out.append(f"rows {sum(left.values())} / {sum(right.values())}")
        out.append(f"names {names}")
        out.append(f"only spark {list((left - right).items())[:3]}")
        out.append(f"only duckdb {list((right - left).items())[:3]}")
    return out


if __name__ == "__main__":
    import re
    import sys
    import time

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    from queries import REGISTRY

    sf = sys.argv[1]
    pattern = re.compile(sys.argv[2] if len(sys.argv) > 2 else ".")
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    bad = 0
    for name, entry in REGISTRY.items():
        if not pattern.search(name):
            continue
        t = time.time()
        try:
            df = entry.run(spark, sf)
            if entry.oracle is None:
                found = [f"rows only: {df.count()}"]
            else:
                found = differences(df, con, entry.oracle)
                bad += bool(found)
        except Exception as e:  # noqa: BLE001
            found = [f"ERROR {type(e).__name__}: {str(e)[:1500]}"]
            bad += 1
        print(f"{'ok ' if not found else '!! '}{name} {time.time() - t:.1f}s", *found, sep="\n    ", flush=True)
    print("bad:", bad)
