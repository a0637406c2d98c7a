"""Near copies of the pipeline's stage against an exact search without MinHash: python tests/llm/recall.py DIR.

The exact search runs in this process on all texts that exact dedup leaves: two texts at the threshold share a shingle among the
first n - ceil(0.8 n) + 1 of either in the order of how few texts hold them; every pair that does is compared in full.
"""

from __future__ import annotations

import pathlib
import sys
import tempfile
from itertools import pairwise

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import SparkSession

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[2]))

from chipmeter.llm import exact_dedup, near_copies  # noqa: E402

LEAST = near_copies.SIMILARITY


def close_pairs(texts: list[bytes]) -> list[tuple[int, int]]:
    """All pairs of texts at the threshold, texts without words left out."""
    sets = [near_copies.shingles(t) for t in texts]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, gram, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((gram, df[gram], owner))
    owner, gram = owner[order], gram[order]
    size = np.array([len(s) for s in sets])
    start = np.cumsum(size) - size
    first = np.arange(len(owner)) - start[owner] < size[owner] - np.ceil(LEAST * size[owner] - 1e-9) + 1
    owner, gram = owner[first & (df[gram] > 1)], gram[first & (df[gram] > 1)]
    order = np.lexsort((size[owner], gram))
    owner, gram = owner[order], gram[order]
    pairs = set()
    for lo, hi in pairwise(np.flatnonzero(np.diff(gram, prepend=-1, append=-1))):
        docs = owner[lo:hi]
        for k, i in enumerate(docs):
            ends = np.searchsorted(size[docs], size[i] / LEAST + 1e-9, "right")
            pairs.update((min(i, j), max(i, j)) for j in docs[k + 1 : ends])
    return [(i, j) for i, j in sorted(pairs) if near_copies.similarity(sets[i], sets[j]) >= LEAST]


def smallest_of(pairs: list[tuple[int, int]], n: int) -> np.ndarray:
    """The smallest member of each one's component."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i, j in pairs:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    return np.array([find(x) for x in range(n)])


def main(base: str) -> None:
    spark = (
        SparkSession.builder.master("local[6]").config("spark.sql.shuffle.partitions", "16").config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.local.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    out = tempfile.mkdtemp(prefix="spark-recall-")
    exact_dedup.deduplicate(spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "text")).write.parquet(f"{out}/docs")
    docs = spark.read.parquet(f"{out}/docs")
    near_copies.named(docs).write.parquet(f"{out}/named")
    rows = pq.read_table(f"{out}/docs").sort_by("doc_id").to_pydict()
    found = dict(zip(*(c.to_pylist() for c in pq.read_table(f"{out}/named", columns=["doc_id", "root"]).columns)))
    spark.stop()
    pairs = close_pairs([(t or "").encode() for t in rows["text"]])
    got = np.unique([found[d] for d in rows["doc_id"]], return_inverse=True)[1]
    together = sum(got[i] == got[j] for i, j in pairs)
    want = smallest_of(pairs, len(got))
    joined = len({*zip(got, want)})
    print(f"{len(got)} texts, {len(pairs)} pairs at {LEAST} or more, {together} in one component; components: {len(set(want))} exact, {len(set(got))} found, {joined} in the overlap of both")


if __name__ == "__main__":
    main(sys.argv[1])
