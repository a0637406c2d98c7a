"""python tests/compare.py SF NAME...: each query against its SQL in DuckDB, as sets of rows."""

import os
import pathlib
import sys
import tempfile
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402


def main(sf: str, names: list[str]) -> int:
    base = sf if sf.startswith("/") else f"/root/testdata/sf{sf}"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in os.listdir(base):
        con.sql(f"create view {t.removesuffix('.parquet')} as select * from '{base}/{t}{'/*.parquet' if os.path.isdir(f'{base}/{t}') else ''}'")
    q, o = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or q:
        t0 = time.time()
        try:
            got = q[name](spark, base).toPandas()
        except Exception as e:
            print("ERROR", name, str(e)[:1500])
            bad += 1
            continue
        t1 = time.time()
        if name not in o:
            print("rows ", name, len(got), f"{t1 - t0:.1f}s", list(got.columns))
            continue
        try:
            want = con.sql(o[name]).df()
        except Exception as e:
            print("SQL  ", name, str(e)[:800])
            bad += 1
            continue
        cols = sorted(got.columns)
        if cols != sorted(want.columns):
            print("COLS ", name, cols, sorted(want.columns))
            bad += 1
            continue

        def norm(df):
            def f(v):
                if isinstance(v, float):
                    return "null" if v != v else f"{v:.9g}"
                if v is None or str(v) in ("NaT", "<NA>", "None"):
                    return "null"
                if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
                    return "[" + ",".join(f(x) for x in v) + "]"
                if type(v).__name__ in ("Decimal", "int64", "int32", "int", "bool", "bool_"):
                    return f"{float(v):.9g}"
                return str(v)

            return sorted(tuple(f(v) for v in row) for row in df[cols].astype(object).itertuples(index=False))

        a, b = norm(got), norm(want)
        if a == b:
            print("ok   ", name, len(a), f"spark {t1 - t0:.1f}s duckdb {time.time() - t1:.1f}s")
        else:
            bad += 1
            sa, sb = set(a), set(b)
            print("DIFF ", name, len(a), len(b), cols, "\n   spark only", sorted(sa - sb)[:3], "\n   sql only", sorted(sb - sa)[:3])
    return bad


if __name__ == "__main__":
    code = main(sys.argv[1], sys.argv[2:])
    sys.stdout.flush()
    os._exit(int(code > 0))
