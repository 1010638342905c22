"""Run queries and their oracles side by side: python tests/oracle.py SF_DIR [NAME...]"""

import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def compare(spark, sf_dir, name, f, sql):
    """None if rows and columns agree, else what differs."""
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = f(spark, sf_dir)
    want = con.sql(sql)
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {got.columns} and {want.columns}"
    at = [want.columns.index(c) for c in got.columns]
    a = Counter(tuple(map(canonical, r)) for r in got.collect())
    b = Counter(tuple(canonical(r[k]) for k in at) for r in want.fetchall())
    if a != b:
        return f"{sum(a.values())} rows, wanted {sum(b.values())}; only here {list((a - b).items())[:3]}; only wanted {list((b - a).items())[:3]}"
    if not a:
        return "no rows"
    return None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    s = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    queries, oracles = e.queries(), e.oracle_sql()
    for n in sys.argv[2:] or [k for k in queries if k in oracles]:
        t0 = time.time()
        try:
            why = compare(s, sys.argv[1], n, queries[n], oracles[n]) if n in oracles else f"no oracle; {queries[n](s, sys.argv[1]).count()} rows"
        except Exception as x:  # noqa: BLE001
            why = f"{type(x).__name__}: {str(x)[:600]}"
        print(n, "ok" if why is None else why, f"{time.time() - t0:.1f}s", flush=True)
