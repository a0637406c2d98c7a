"""python tests/llm/accuracy.py DIR NAME...: held-out accuracy of the classifiers against the given labels."""

import pathlib
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[2]))

from chipmeter.llm import queries  # noqa: E402


def main(base: str, names: list[str]) -> None:
    spark = (
        SparkSession.builder.master("local[6]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false").config("spark.local.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    labels = spark.read.parquet(f"{base}/labels.parquet").toPandas()
    docs = spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "lang").toPandas()
    for name in names:
        t = time.time()
        out = queries.QUERIES[name](spark, base).toPandas()
        print(name, f"{time.time() - t:.1f} s", len(out))
        if "lang_pred" in out:
            m = out.merge(docs, on="doc_id")
            for h, g in m.groupby("held_out"):
                g = g[g.lang.notna()]
                print("  held out" if h else "  learned", len(g), "right", (g.lang == g.lang_pred).mean(), "rejected", g.rejected.mean(), "right of accepted", (g.lang == g.lang_pred)[~g.rejected].mean())
        else:
            col = "toxic" if name.startswith("op7") else "quality"
            m = out.merge(labels, on="doc_id")
            for h, g in m.groupby("held_out"):
                y, p = g[col], g.predicted
                r, n1 = g.score.rank(), (y == 1).sum()
                auc = (r[y == 1].sum() - n1 * (n1 + 1) / 2) / max(1, n1 * (len(y) - n1))
                print("  held out" if h else "  learned", len(g), f"right {(y == p).mean():.4f} auc {auc:.4f} tp {((y == 1) & (p == 1)).sum()} fp {((y == 0) & (p == 1)).sum()} fn {((y == 1) & (p == 0)).sum()} tn {((y == 0) & (p == 0)).sum()}")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
