"""Run registered queries beside their SQL twins: ``python tests/compare.py [name part ...] [--base DIR]``."""
from __future__ import annotations

import math
import os
import sys
import time
import warnings

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
warnings.filterwarnings("ignore")

BASE = os.environ.get("CHECK_DIR", "/root/testdata/sf0.01")
KINDS = {
    "int": "int", "bigint": "int", "smallint": "int", "tinyint": "int", "string": "str", "double": "float", "float": "float",
    "boolean": "bool", "timestamp": "ts", "date": "date",
    "INTEGER": "int", "BIGINT": "int", "VARCHAR": "str", "DOUBLE": "float", "FLOAT": "float", "BOOLEAN": "bool", "TIMESTAMP": "ts", "DATE": "date",
}


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 7)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if hasattr(v, "as_tuple"):
        return round(float(v), 7)
    return v


def connect(base: str = BASE):
    import duckdb

    from tessera.sources.tables import SCHEMAS

    con = duckdb.connect()
    for name in SCHEMAS:
        con.execute(f"create view {name} as select * from '{base}/{name}.parquet'")
    return con


def difference(spark, con, name: str, job, sql: str | None, base: str = BASE) -> str:
    """Empty text when the two agree; else what differs."""
    df = job(spark, base)
    cols = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    if sql is None:
        return ""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    if sorted(names) != cols:
        return f"columns {cols} != {sorted(names)}"
    place = [names.index(c) for c in cols]
    want = [tuple(plain(r[i]) for i in place) for r in cur.fetchall()]
    kinds = [
        (f.name, f.dataType.simpleString(), types[f.name])
        for f in df.schema.fields
        if KINDS.get(f.dataType.simpleString()) != KINDS.get(types[f.name])
    ]
    order = lambda r: tuple((x is not None, str(x)) for x in r)
    rows, want = sorted(rows, key=order), sorted(want, key=order)
    if len(rows) != len(want):
        return f"rows {len(rows)} != {len(want)}; only here {list(set(rows) - set(want))[:2]}; only there {list(set(want) - set(rows))[:2]}"
    bad = [(a, b) for a, b in zip(rows, want) if a != b]
    if bad:
        return f"{len(bad)} of {len(rows)} rows differ, e.g. {cols}: {bad[0]}"
    return f"types differ: {kinds}" if kinds else ""


def main(parts: list[str]) -> None:
    import tempfile

    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = connect(), entry.oracle_sql(), 0
    for name, job in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            diff = difference(spark, con, name, job, oracles.get(name))
        except Exception as e:  # keep going: this is a report
            diff = f"{type(e).__name__}: {str(e)[:700]}"
        bad += bool(diff)
        print(f"{'OK ' if not diff else 'BAD'} {name} {time.time() - start:.1f}s {'' if name in oracles else '(no twin) '}{diff}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
