"""Connected components of an edge table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialise

#: Most edges of a grid that one task joins by itself; larger grids take rounds of joins.
SMALL = 200_000
#: Edges that a task joins at once: whole grids up to about this number.
CHUNK = 200_000


def connected(nodes: DataFrame, edges: DataFrame, small: int = SMALL) -> DataFrame:
    """nodes (grid, node) and edges (grid, a, b) to (grid, node, root), root the smallest node reachable.

    Grids of at most ``small`` edges are joined inside tasks, each grid in one; larger ones spread over all tasks in rounds. Both
    give the same roots. Nodes without edges and edges from a node to itself are allowed.
    """
    e = edges.where("a <> b and grid is not null").select("grid", F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = materialise(e)
    large = materialise(e.groupBy("grid").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > small).select("grid"))
    if large.limit(1).count():
        roots = _in_tasks(e.join(large, "grid", "left_anti")).unionByName(_in_rounds(e.join(large, "grid", "left_semi")))
    else:
        roots = _in_tasks(e)
    return nodes.select("grid", "node").join(roots, ["grid", "node"], "left").select("grid", "node", F.coalesce("root", "node").alias("root"))


def smallest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest of the numbers below ``n`` that each reaches over edges a - b: roots hook onto smaller ones, then paths are halved."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    return root


def _in_tasks(e: DataFrame) -> DataFrame:
    """(grid, node, root) of the edges (grid, u, v) of grids that fit a task each; a task holds one grid or ``CHUNK`` edges and a batch at most."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        grid, u, v = (t.column(k).to_numpy() for k in range(3))
        # rows are sorted by grid, so a grid's number is how often the value has changed
        g = np.concatenate([[0], np.cumsum(grid[1:] != grid[:-1])])
        node, of = np.concatenate([u, v]), np.concatenate([g, g])
        order = np.lexsort((node, of))
        first = np.concatenate([[True], (np.diff(of[order]) != 0) | (np.diff(node[order]) != 0)])
        at = np.empty(len(node), np.int64)
        at[order] = np.cumsum(first) - 1
        one = order[first]
        root = smallest(at[: len(u)], at[len(u) :], len(one))
        named = t.column(0).take(pa.array(one % len(u))).combine_chunks()
        return pa.RecordBatch.from_arrays([named, pa.array(node[one]), pa.array(node[one][root])], ["grid", "node", "root"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            if b.num_rows == 0:
                continue
            held.append(b)
            rows += b.num_rows
            if rows < CHUNK:
                continue
            t = pa.Table.from_batches(held)
            grid = t.column(0).to_numpy()
            cut = int(np.flatnonzero(grid != grid[-1])[-1]) + 1 if grid[0] != grid[-1] else 0
            if cut:  # the last grid may go on in the next batch
                yield solve(t.slice(0, cut))
                held = t.slice(cut).to_batches()
                rows -= cut
        if held:
            yield solve(pa.Table.from_batches(held))

    kind = e.schema["grid"].dataType.simpleString()
    rows = e.select("grid", F.col("u").cast("long"), F.col("v").cast("long")).repartition("grid").sortWithinPartitions("grid")
    return rows.mapInArrow(run, f"grid {kind}, node long, root long")


def _in_rounds(e: DataFrame) -> DataFrame:
    """(grid, node, root) of the edges (grid, u, v), u above v.

    Large-star and small-star rounds on the edges alone: larger neighbours of a node go to the smallest node near it, then a node and
    its smaller neighbours go to the smallest of them. Labels only fall, so rounds end, after about the logarithm of the
    longest path. Edges inside what has been joined vanish from round to round, and nothing is gathered.
    """
    e, sign = materialise(e.distinct()), None
    while True:
        both = e.unionByName(e.select("grid", F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("grid", "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, ["grid", "u"]).select("grid", F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large)
        low = large.groupBy("grid", "u").agg(F.min("v").alias("m"))
        small = large.join(low, ["grid", "u"])
        e = small.where("v <> m").select("grid", F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("grid", "u", F.col("m").alias("v")))
        e = materialise(e.distinct())
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("grid", "u", "v"))).first()
        if now == sign:
            break
        sign = now
    return e.select("grid", F.col("u").alias("node"), F.col("v").alias("root"))
