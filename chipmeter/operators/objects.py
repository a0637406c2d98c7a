"""Objects in grids: labelling, sizes, overlap with reference objects, one-to-one matching and detection counts."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import materialise
from .graph import connected

#: Columns of a block in which runs of neighbouring rows meet.
BLOCK = 64


def components(cells: DataFrame, width: int = 1 << 20) -> DataFrame:
    """Foreground cells (grid, row, col) with ``label``, the 4-neighbour component: row * width + col of its first cell.

    Cells are folded into row runs first, and runs that touch are joined; labels spread over runs, not cells. Runs of
    neighbouring rows meet by blocks of ``BLOCK`` columns, so a run is tried with those near it only.
    """
    w = W.partitionBy("grid", "row").orderBy("col")
    isle = cells.select("grid", "row", "col").distinct().withColumn("isle", F.col("col") - F.row_number().over(w))
    runs = isle.groupBy("grid", "row", "isle").agg(F.min("col").alias("c0"), F.max("col").alias("c1"))
    runs = materialise(runs.withColumn("node", F.col("row").cast("long") * width + F.col("c0")))
    below = runs.select("grid", (F.col("row") - 1).alias("row"), F.col("c0").alias("d0"), F.col("c1").alias("d1"), F.col("node").alias("b"))
    blocks = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / BLOCK), F.floor(F.col(hi) / BLOCK)))
    near = runs.withColumn("block", blocks("c0", "c1")).join(below.withColumn("block", blocks("d0", "d1")), ["grid", "row", "block"])
    edges = near.where("c0 <= d1 and d0 <= c1").select("grid", F.col("node").alias("a"), "b")
    roots = connected(runs.select("grid", "node"), edges)
    out = runs.join(roots, ["grid", "node"])
    return out.select("grid", "row", F.explode(F.sequence("c0", "c1")).alias("col"), F.col("root").alias("label"))


def sizes(labelled: DataFrame, cell_m2: float = 100.0) -> DataFrame:
    """Per object: cells, area, root length and bounding box."""
    out = labelled.groupBy("grid", "label").agg(
        F.count(F.lit(1)).alias("px"), F.min("row").alias("row0"), F.max("row").alias("row1"), F.min("col").alias("col0"), F.max("col").alias("col1")
    )
    return out.withColumns({"area_m2": F.col("px") * cell_m2, "root_length": F.sqrt(F.col("px") * cell_m2)})


def without_small(labelled: DataFrame, least_px: int) -> DataFrame:
    """Labelled cells without the objects of fewer cells."""
    small = labelled.groupBy("grid", "label").agg(F.count(F.lit(1)).alias("px")).where(F.col("px") < least_px)
    return labelled.join(small, ["grid", "label"], "left_anti")


def size_bin(root_length: Column) -> Column:
    return F.when(root_length < 100, "rl_40_100").when(root_length < 300, "rl_100_300").otherwise("rl_300_plus")


def overlaps(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Shared cells and IoU of every touching pair of objects (grid, gt, pred); found by shared cells, so no pair is tried in vain.

    Joins are merged: Spark takes cells that come from a few rings for a small table and would send them all to the driver.
    """
    g = gt.select("grid", "row", "col", F.col("label").alias("gt"))
    p = pred.select("grid", "row", "col", F.col("label").alias("pred"))
    both = g.join(p.hint("merge"), ["grid", "row", "col"]).groupBy("grid", "gt", "pred").agg(F.count(F.lit(1)).alias("shared"))
    ga = g.groupBy("grid", "gt").agg(F.count(F.lit(1)).alias("gt_px"))
    pa = p.groupBy("grid", "pred").agg(F.count(F.lit(1)).alias("pred_px"))
    out = both.join(ga.hint("merge"), ["grid", "gt"]).join(pa.hint("merge"), ["grid", "pred"])
    return out.withColumn("iou", F.col("shared") / (F.col("gt_px") + F.col("pred_px") - F.col("shared")))


def _groups(pairs: DataFrame) -> DataFrame:
    """Pairs with ``group``, the connected group of objects that they belong to; references are even nodes, predictions odd ones."""
    e = pairs.select("grid", (F.col("gt") * 2).alias("a"), (F.col("pred") * 2 + 1).alias("b"))
    roots = connected(e.select("grid", F.col("a").alias("node")).distinct(), e)
    return pairs.join(roots.select("grid", F.shiftright("node", 1).alias("gt"), F.col("root").alias("group")), ["grid", "gt"])


def best_pairs(edges: list[tuple[int, int, int]], n: int, m: int) -> list[tuple[int, int, int]]:
    """The one-to-one edges (row, column, weight above 0) of the largest total weight; weights are whole numbers, so sums are exact.

    Shortest augmenting paths with potentials on the edges that there are, so work grows with edges, not with n times m. Each row
    has a column of its own besides, at weight 0, for staying alone.
    """
    top = max((w for _, _, w in edges), default=0)
    near: list[list[tuple[int, int]]] = [[(m + i, top)] for i in range(n)]
    weight = {}
    for i, j, w in edges:
        near[i].append((j, top - w))
        weight[i, j] = w
    u, v, owner, mate = [0] * n, [0] * (m + n), [-1] * (m + n), [-1] * n
    for start in range(n):
        dist, prev, done, heap = {}, {}, set(), []
        i, base = start, 0
        while True:
            for j, c in near[i]:
                d = base + c - u[i] - v[j]
                if j not in done and (j not in dist or d < dist[j]):
                    dist[j], prev[j] = d, i
                    heapq.heappush(heap, (d, j))
            base, j = heapq.heappop(heap)
            while j in done:
                base, j = heapq.heappop(heap)
            if owner[j] < 0:
                break
            done.add(j)
            i = owner[j]
        u[start] += base
        for k in done:
            v[k] -= base - dist[k]
            u[owner[k]] += base - dist[k]
        while True:  # turn the path around
            i = prev[j]
            owner[j], j, mate[i] = i, mate[i], j
            if i == start:
                break
    return [(i, j, weight[i, j]) for i, j in enumerate(mate) if j < m]


#: A fixed mix of two objects' numbers, which settles what is equal otherwise.
MIX_GT, MIX_PRED, MIX = 7919, 104_729, 1_000_003


def _by_group(pairs: DataFrame, solve: Callable[[pd.DataFrame], list[int]], *ties: Column) -> DataFrame:
    """The pairs (grid, gt, pred, iou) that each connected group gives: the first by IoU, then ``ties``, where a side has one object, else the rows that ``solve`` names."""
    pairs = materialise(_groups(pairs.select("grid", "gt", "pred", "iou")))
    shape = pairs.groupBy("grid", "group").agg(F.countDistinct("gt").alias("n"), F.countDistinct("pred").alias("m"))
    pairs = materialise(pairs.join(shape, ["grid", "group"]))
    first = F.min_by(F.struct("gt", "pred", "iou"), F.struct(-F.col("iou"), *ties)).alias("first")
    single = pairs.where("n = 1 or m = 1").groupBy("grid", "group").agg(first).select("grid", "first.*")
    several = pairs.where("n > 1 and m > 1").groupBy("grid", "group")
    return single.unionByName(several.applyInPandas(lambda pdf: pdf.iloc[solve(pdf)][["grid", "gt", "pred", "iou"]], "grid long, gt long, pred long, iou double"))


def match_optimal(pairs: DataFrame, least_iou: float = 0.3) -> DataFrame:
    """One-to-one pairs (grid, gt, pred, iou) with the largest total IoU, then those of ``least_iou`` or more.

    Pairs fall into connected groups. A group with one object on a side takes its best pair in one aggregation; the others are solved
    exactly in tasks, one group after the other, on the pairs that touch. A group is what overlaps in one grid. IoUs are taken to 1e-12.
    Totals are compared first; of equal ones that with the smaller sum of predictions is taken, then a fixed mix of the
    objects' numbers decides (their largest sum loses), so the result is the same on every run.
    """

    def solve(pdf: pd.DataFrame) -> list[int]:
        rows, gts = pd.factorize(pdf["gt"], sort=True)
        cols, preds = pd.factorize(pdf["pred"], sort=True)
        # whole numbers of three digits, the base being above any sum of the lower ones
        most = max(map(int, preds)) + 1
        steps, total = MIX * len(gts), most * len(gts)
        weight = []
        for i, p, iou in zip(map(int, pdf["gt"]), map(int, pdf["pred"]), pdf["iou"]):
            weight.append((round(iou * 10**12) * total - p) * steps - (i * MIX_GT + p * MIX_PRED) % MIX)
        at = {(i, j): k for k, (i, j) in enumerate(zip(rows.tolist(), cols.tolist()))}
        found = best_pairs([(i, j, w) for (i, j), w in zip(at, weight) if w > 0], len(gts), len(preds))
        return [at[i, j] for i, j, _ in found]

    mix = F.pmod(F.col("gt") * MIX_GT + F.col("pred") * MIX_PRED, F.lit(MIX))
    return _by_group(pairs, solve, F.col("pred"), mix, F.col("gt")).where(F.col("iou") >= least_iou)


def match_greedy(pairs: DataFrame, above_iou: float = 0.3) -> DataFrame:
    """References in the order of their best IoU each take their best prediction that is free, strictly above ``above_iou``.

    Equal references go by their numbers, and so do equal predictions. A choice only bears on its own connected group, so groups are settled in tasks, each in
    one pass over its references.
    """

    def solve(pdf: pd.DataFrame) -> list[int]:
        wants: dict[int, list[tuple[float, int, int]]] = {}
        for k, (i, p, iou) in enumerate(zip(pdf["gt"], pdf["pred"], pdf["iou"])):
            wants.setdefault(i, []).append((-iou, p, k))
        for w in wants.values():
            w.sort()
        used, out = set(), []
        for i in sorted(wants, key=lambda i: (wants[i][0][0], i)):
            free = next(((p, k) for _, p, k in wants[i] if p not in used), None)
            if free:
                used.add(free[0])
                out.append(free[1])
        return out

    return _by_group(pairs.where(F.col("iou") > above_iou), solve, F.col("gt"), F.col("pred"))


def ambiguous(pairs: DataFrame, least_iou: float = 0.1) -> DataFrame:
    """References with two or more predictions of at least ``least_iou``, and those predictions."""
    out = pairs.where(F.col("iou") >= least_iou).groupBy("grid", "gt").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("pred")).alias("preds"))
    return out.where("n >= 2")


def without_ambiguous(matched: DataFrame, pairs: DataFrame, least_iou: float = 0.1) -> DataFrame:
    """Matched pairs without those of ambiguous references; these still count as references."""
    return matched.join(ambiguous(pairs, least_iou).select("grid", "gt"), ["grid", "gt"], "left_anti")


def detection(gt: DataFrame, pred: DataFrame, matched: DataFrame, grids: DataFrame) -> DataFrame:
    """Per grid: objects, matches, misses, false finds, and a note where a side is empty."""
    n = lambda df, name: df.groupBy("grid").agg(F.count(F.lit(1)).alias(name))
    out = grids.select("grid").distinct()
    for df, name in ((gt, "n_gt"), (pred, "n_pred"), (matched, "n_matched")):
        out = out.join(n(df, name), "grid", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    note = F.when((F.col("n_gt") == 0) & (F.col("n_pred") == 0), "both_null").when(F.col("n_gt") == 0, "gt_null").when(F.col("n_pred") == 0, "pred_null")
    return out.withColumns({"n_fn": F.greatest(F.lit(0), F.col("n_gt") - F.col("n_matched")), "n_fp": F.greatest(F.lit(0), F.col("n_pred") - F.col("n_matched")), "note": note})
