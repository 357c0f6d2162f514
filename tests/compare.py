"""Spark against SQL: ``python tests/compare.py SF_DIR NAME...`` (all names without any)."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb
import pandas as pd


def duck(sf_dir: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con.execute(sql).df()


def canonical(df: pd.DataFrame) -> list[tuple]:
    def text(v) -> str:
        if v is None or (isinstance(v, float) and pd.isna(v)) or v is pd.NaT:
            return "NULL"
        if hasattr(v, "tolist") and not isinstance(v, (pd.Timestamp, str)) and getattr(v, "ndim", 0):
            return "[" + ",".join(text(x) for x in v.tolist()) + "]"
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(text(x) for x in v) + "]"
        if isinstance(v, float) or type(v).__name__.startswith("float"):
            return f"{round(float(v), 6) + 0.0:g}" if float(v).is_integer() else f"{float(v):.6f}"
        if isinstance(v, pd.Timestamp):
            return v.isoformat()
        return str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(text(v) for v in row) for row in df.itertuples(index=False, name=None))


def differs(spark_df, duck_df: pd.DataFrame) -> str:
    got = spark_df.toPandas()
    if sorted(got.columns) != sorted(duck_df.columns):
        return f"columns {sorted(got.columns)} != {sorted(duck_df.columns)}"
    a, b = canonical(got), canonical(duck_df)
    if a == b:
        return ""
    only_a, only_b = set(a) - set(b), set(b) - set(a)
    return f"{len(a)} and {len(b)} rows; only Spark {list(only_a)[:3]}; only SQL {list(only_b)[:3]}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from changeprism.session import session

    spark = session(cpus=8)
    spark.sparkContext.setLogLevel("ERROR")
    where, names = sys.argv[1], sys.argv[2:]
    sql = entry.oracle_sql()
    bad = 0
    for name, f in entry.queries().items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        t = time.time()
        try:
            if name in sql:
                out = differs(f(spark, where), duck(where, sql[name]))
            else:
                out = f"(no SQL) {f(spark, where).count()} rows"
        except Exception as e:  # noqa: BLE001
            out = f"ERROR {type(e).__name__} {str(e)[:600]}"
        bad += bool(out) and not out.startswith("(no")
        print(f"{name}: {out or 'same'} [{time.time() - t:.1f}s]", flush=True)
    print("BAD", bad)
