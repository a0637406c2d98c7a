"""Operator 12, vector code compression: product quantisation whose nearest entries are found by Orchard's search.

Vectors become integers, floor(256 x), and are cut into 16 equal consecutive parts. Each part has a codebook: at first that part
of the 64 smallest ids; two rounds move every entry to the componentwise floor of the mean of its parts (unused entries stay).

Orchard's search: each entry has a list of all entries, sorted by distance. A part starts at the first entry and
reads that entry's list; a nearer entry is jumped to, and its list is read from the start; entries that were tried are marked.
When the list's next entry lies beyond twice the current distance nothing nearer can follow, as d(q, e) >= d(c, e) - d(q, c).
An entry at exactly the current distance has not been passed then, so ties go to the lower index. All parts of a batch walk
at once. Distances are squares of whole numbers, so nothing is rounded.

A round is one scan: tasks search, add up and send one row for each entry; 1,024 sums go to the driver. Vectors don't move.

Rows whose vector is null or holds null or non-finite components are dropped. Null ids and labels are values (null ids
come last). Of equal ids the vectors decide the order. Fewer than 64 vectors make smaller codebooks; an empty table gives no rows.
Components beyond 2^24 after scaling count as 2^24, so that sums fit into long. A vector shorter than the first one's length is
filled with zeros, a longer one is cut for coding, and so is a length that is no multiple of 16 filled up to the next one: none of these
occurs in a table of embeddings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Fixed values of the contract: parts of a vector, entries of a codebook, rounds, scale.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LARGEST = 1 << 24
#: Vectors that search at once in a task, and most labels whose sums are broadcast.
TOGETHER, BROADCAST_LABELS = 2048, 1_000_000


def kept(vector: str | Column = "embedding") -> Column:
    """Whether a row has a vector of finite numbers."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def neighbour_lists(book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry all entries by distance (itself first, then by index), and those squared distances."""
    d = ((book[:, None, :] - book[None, :, :]) ** 2).sum(2)
    d[np.arange(len(book)), np.arange(len(book))] = -1
    order = np.argsort(d, axis=1, kind="stable")
    return order, np.maximum(np.take_along_axis(d, order, 1), 0)


def orchard(q: np.ndarray, book: np.ndarray, lists: tuple[np.ndarray, np.ndarray], start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry (ties: lowest index) of each row of ``q`` and its squared distance."""
    order, far = lists
    n, size = len(q), len(book)
    best = np.zeros(n, np.int64) if start is None else start.copy()
    dist = ((q - book[best]) ** 2).sum(1)
    marked = np.zeros((n, size), bool)
    marked[np.arange(n), best] = True
    walk, at = np.arange(n), np.ones(n, np.int64)  # place 0 of a list is the entry itself
    while True:
        at_w, best_w = at[walk], best[walk]
        on = at_w < size
        on[on] = far[best_w[on], at_w[on]] <= 4 * dist[walk[on]]  # strictly beyond twice the distance ends the walk
        walk = walk[on]
        if not len(walk):
            return best, dist
        entry = order[best[walk], at[walk]]
        at[walk] += 1
        new = ~marked[walk, entry]
        w, entry = walk[new], entry[new]
        marked[w, entry] = True
        d = ((q[w] - book[entry]) ** 2).sum(1)
        nearer = (d < dist[w]) | ((d == dist[w]) & (entry < best[w]))
        w = w[nearer]
        best[w], dist[w], at[w] = entry[nearer], d[nearer], 1


def _integers(column: pa.ListArray, dims: int) -> np.ndarray:
    """Vectors of a column as whole numbers, ``dims`` each."""
    values = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    lengths = np.diff(column.offsets.to_numpy())
    flat = np.clip(values, -LARGEST, LARGEST).astype(np.int64)
    if (lengths == dims).all():
        return flat.reshape(-1, dims)
    out, at = np.zeros((len(lengths), dims), np.int64), np.concatenate([[0], np.cumsum(lengths)])
    for i, m in enumerate(lengths):
        k = min(m, dims)
        out[i, :k] = flat[at[i] : at[i] + k]
    return out


def _searched(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of the batches with their parts (rows, PARTS, width), codes and squared distances."""
    lists = [neighbour_lists(b) for b in books]
    for batch in batches:
        for k in range(0, batch.num_rows, TOGETHER):
            piece = batch.slice(k, TOGETHER)
            parts = _integers(piece.column(piece.num_columns - 1), books.shape[0] * books.shape[2]).reshape(piece.num_rows, books.shape[0], books.shape[2])
            code, dist = np.empty(parts.shape[:2], np.int64), np.empty(parts.shape[:2], np.int64)
            for j in range(books.shape[0]):
                code[:, j], dist[:, j] = orchard(parts[:, j], books[j], lists[j])
            yield piece, parts, code, dist


def fit(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, width) of whole numbers, learned from all kept vectors.

    The first entries come from a top-k of the ids, then of the rows up to the last of them (``entries`` rows reach the driver); a round brings
    parts x entries sums.
    """
    rows = vectors.where(kept(vector)).select(F.col(vec_id).alias("i"), F.col(vector).cast("array<double>").alias("v"))
    ids = rows.select("i").where("i is not null").orderBy("i").limit(entries).collect()  # a task sends ids only
    near = rows.where(F.col("i") <= ids[-1].i) if len(ids) == entries else rows
    first = near.orderBy(F.col("i").isNull(), "i", "v").limit(entries).collect()
    if not first:
        return np.zeros((parts, 0, 0), np.int64)
    width = -(-len(first[0].v) // parts)
    books = _integers(pa.array([r.v for r in first], pa.list_(pa.float64())), parts * width).reshape(len(first), parts, width).transpose(1, 0, 2).copy()

    def sums(books: np.ndarray):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
            for _, own, code, _ in _searched(batches, books):
                for j in range(len(books)):
                    n[j] += np.bincount(code[:, j], minlength=books.shape[1])
                    np.add.at(total[j], code[:, j], own[:, j])
            j, e = np.nonzero(n)
            if len(j):
                yield pa.RecordBatch.from_arrays([pa.array(j, pa.int32()), pa.array(e, pa.int32()), pa.array(n[j, e]), pa.array(total[j, e].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

        found = rows.select("v").mapInArrow(task, "part int, entry int, n long, total array<long>")
        return found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("total", F.lit(d))) for d in range(width)]).alias("total")).collect()

    for _ in range(rounds):
        new = books.copy()
        for r in sums(books):
            new[r.part, r.entry] = [t // r.n for t in r.total]
        books = new
    return books


def encode(vectors: DataFrame, books: np.ndarray, vector: str = "embedding", carried: Sequence[str] | None = None) -> DataFrame:
    """Kept rows of ``vectors`` as ``row`` (a struct of the ``carried`` columns, all if not given) with ``code`` (two hex digits a part)
    and ``error``, the sum of squared distances."""
    carried = vectors.columns if carried is None else carried
    rows = vectors.where(kept(vector)).select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"), F.col(vector).cast("array<double>").alias("v"))
    kind = rows.select("row").schema

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not books.shape[1]:
            return
        digits = np.array([f"{e:02x}" for e in range(books.shape[1])], dtype=object)
        for piece, _, code, dist in _searched(batches, books):
            text = ["".join(c) for c in digits[code].tolist()]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(text, pa.string()), pa.array(dist.sum(1))], ["row", "code", "error"])

    return rows.mapInArrow(task, kind.add("code", "string").add("error", "long"))


def books_digest(books: np.ndarray) -> str:
    """sha256 of all components in decimal, by part, entry and place, with commas between."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error (errors of equal labels together, nulls too) and the codebooks' digest, for every kept row."""
    books = fit(vectors, vec_id, vector)
    coded = encode(vectors, books, vector, [vec_id, label])
    coded = materialise(coded.select(F.col("row")[vec_id].alias("vec_id"), F.col("row")[label].alias("label"), "code", "error"))
    total = F.least(F.sum(F.col("error").cast("decimal(28,0)")), F.lit(2**63 - 1)).cast("long")
    by = materialise(coded.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "l"))
    by = F.broadcast(by) if by.count() <= BROADCAST_LABELS else by
    out = coded.join(by, coded.label.eqNullSafe(by.l), "left")
    return out.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _oracle() -> str:
    """Assignments against all entries, twice with an update, then once more."""
    near = """near{k} AS (SELECT i, j, e, d FROM (SELECT p.i, p.j, b.e, list_sum(list_transform(range(len(p.x)), lambda z: (p.x[z + 1] - b.x[z + 1]) * (p.x[z + 1] - b.x[z + 1]))) AS d,
      row_number() OVER (PARTITION BY p.i, p.j ORDER BY d, b.e) AS r FROM part p JOIN book{k} b USING (j)) WHERE r = 1)"""
    move = """sum{k} AS (SELECT n.j, n.e, count(*) AS n, {sums} FROM near{k} n JOIN part p USING (i, j) GROUP BY n.j, n.e),
      book{m} AS (SELECT b.j, b.e, CASE WHEN s.n IS NULL THEN b.x ELSE [{means}] END AS x FROM book{k} b LEFT JOIN sum{k} s USING (j, e))"""
    sums = ", ".join(f"sum(p.x[{d}])::BIGINT AS s{d}" for d in range(1, 5))
    means = ", ".join(f"CAST(floor(s.s{d}::DOUBLE / s.n) AS BIGINT)" for d in range(1, 5))
    steps = [near.format(k=0)]
    for k in range(ROUNDS):
        steps += [move.format(k=k, m=k + 1, sums=sums, means=means), near.format(k=k + 1)]
    last = ROUNDS
    return f"""
WITH ok AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (SELECT i, j, v[4 * j + 1 : 4 * j + 4] AS x FROM ok, (SELECT unnest(range(16)) AS j)),
book0 AS (SELECT j, i AS e, x FROM part WHERE i < 64),
{", ".join(steps)},
code AS (SELECT i, string_agg(printf('%02x', e), '' ORDER BY j) AS code, sum(d)::BIGINT AS error FROM near{last} GROUP BY i)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY j, e)) FROM book{last}) AS codebooks_sha256
FROM ok JOIN code USING (i)
"""


ORACLE = _oracle()
