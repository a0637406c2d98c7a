"""Operators on cells of gridded chips: thresholds, gates, coverage, masks and tiles. Undefined metrics are NULL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def reflectance(band: Column) -> Column:
    """Digital numbers to reflectance where the band's maximum shows that it holds digital numbers."""
    return F.when(F.array_max(band) > 100, F.transform(band, lambda v: v * 1e-4)).otherwise(band)


def water_index_mask(px: DataFrame, t: float) -> DataFrame:
    """Cells that are bright and have a positive water index."""
    ndwi = (F.col("b03") - F.col("b08")) / (F.col("b03") + F.col("b08") + F.lit(1e-6))
    return px.where((ndwi > 0) & (F.col("b08") >= t))


def merge_classes(cls: Column, merged: Sequence[int] = (2,), into: int = 1) -> Column:
    return F.when(cls.isin(*merged), into).otherwise(cls)


def validity(px: DataFrame, bright: float, least_bright: float, most_empty: float) -> DataFrame:
    """Per chip: share of bright cells, share of cells with all bands zero, and whether the chip is valid."""
    empty = (F.col("b08") == 0) & (F.col("b03") == 0) & (F.col("b04") == 0)
    out = px.groupBy("chip_id").agg(F.avg((F.col("b08") > bright).cast("int")).alias("bright"), F.avg(empty.cast("int")).alias("empty"))
    return out.withColumn("valid", (F.col("bright") >= least_bright) & (F.col("empty") <= most_empty))


def coverage(px: DataFrame, t: float, by: Sequence[str] = ("chip_id",), strict: bool = False) -> DataFrame:
    """Share of bright cells; ``strict`` compares with > instead of >=."""
    test = F.col("b08") > t if strict else F.col("b08") >= t
    return px.groupBy(*by).agg(F.avg(test.cast("int")).alias("ic"), F.count(F.lit(1)).alias("n"))


def otsu(px: DataFrame, by: Sequence[str] = ("chip_id",), value: str = "b08", bins: int = 256, least_cells: int = 1) -> DataFrame:
    """Histogram threshold of each group with the largest variance between its two sides; NULL for constant groups.

    Equal bins over [min, max], the last one closed; bin centres stand for values; the lowest bin wins ties.
    One aggregation to bins, then windows over at most ``bins`` rows a group, so cells move once.
    """
    by = list(by)
    ends = px.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n")).where(F.col("n") >= least_cells)
    flat = F.col("hi") <= F.col("lo")
    at = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)).cast("int")
    hist = px.join(ends, by).where(~flat).groupBy(*by, "lo", "hi", "n", at.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    hist = hist.withColumn("centre", F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins)
    up = W.partitionBy(*by).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*by)
    hist = hist.withColumns({"w1": F.sum("c").over(up), "s1": F.sum(F.col("c") * F.col("centre")).over(up), "s": F.sum(F.col("c") * F.col("centre")).over(whole), "next": F.lead("bin").over(W.partitionBy(*by).orderBy("bin"))})
    m1, w2 = F.col("s1") / F.col("w1"), F.col("n") - F.col("w1")
    var = F.col("w1") * w2 * F.pow(m1 - F.try_divide(F.col("s") - F.col("s1"), w2), F.lit(2))
    best = hist.where(F.col("next").isNotNull()).withColumn("var", F.round(var, 9))
    best = best.groupBy(*by).agg(F.max_by("centre", F.struct("var", -F.col("bin"))).alias("threshold"))
    return ends.join(best, by, "left").select(*by, "threshold", F.when(F.col("threshold").isNull(), "constant").alias("reason"))


def confusion(px: DataFrame, truth: Column, pred: Column, by: Sequence[str], cell_m2: float = 100.0) -> DataFrame:
    """Pixel counts and IoU, precision, recall, F1, areas and their errors; F1 is undefined without true positives."""
    c = px.groupBy(*by).agg(
        F.count_if(truth & pred).alias("tp"), F.count_if(~truth & pred).alias("fp"), F.count_if(truth & ~pred).alias("fn"), F.count(F.lit(1)).alias("n"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    c = c.withColumns({
        "iou": F.try_divide(tp, tp + fp + fn), "precision": F.try_divide(tp, tp + fp), "recall": F.try_divide(tp, tp + fn), "gt_pixels": tp + fn, "pred_pixels": tp + fp,
        "pred_area": (tp + fp) * cell_m2, "gt_area": (tp + fn) * cell_m2,
    })
    return c.withColumns({
        "f1": F.when(tp > 0, F.try_divide(2 * tp, 2 * tp + fp + fn)), "abs_err": F.abs(F.col("pred_area") - F.col("gt_area")),
        "sq_err": F.pow(F.col("pred_area") - F.col("gt_area"), F.lit(2.0)),
    })


def class_iou(px: DataFrame, truth: str, pred: str, classes: Sequence[int], by: Sequence[str]) -> DataFrame:
    """Mean IoU over the classes that the truth or the prediction has, area bias in percent and Dice of class 1."""
    aggs = []
    for k in classes:
        aggs += [F.count_if((F.col(truth) == k) & (F.col(pred) == k)).alias(f"i{k}"), F.count_if((F.col(truth) == k) | (F.col(pred) == k)).alias(f"u{k}")]
    out = px.groupBy(*by).agg(*aggs, F.count_if(F.col(truth) == 1).alias("t"), F.count_if(F.col(pred) == 1).alias("p"))
    each = F.filter(F.array(*[F.try_divide(F.col(f"i{k}"), F.col(f"u{k}")) for k in classes]), lambda x: x.isNotNull())
    return out.select(
        *by, F.try_divide(F.aggregate(each, F.lit(0.0), lambda a, x: a + x), F.size(each)).alias("miou"),
        (F.try_divide(F.col("p") - F.col("t"), F.col("t")) * 100).alias("bias_pct"), F.try_divide(2 * F.col("i1"), F.col("t") + F.col("p")).alias("dice"),
    )


def dilate_cross(cells: DataFrame, height: int, width: int) -> DataFrame:
    """A mask (grid, row, col) and its four neighbours inside the grid."""
    moves = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))])
    out = cells.select("grid", "row", "col", F.explode(moves).alias("m")).select("grid", (F.col("row") + F.col("m.r")).alias("row"), (F.col("col") + F.col("m.c")).alias("col"))
    return out.where((F.col("row").between(0, height - 1)) & (F.col("col").between(0, width - 1))).distinct()


def belt(cells: DataFrame, radius: int, height: int, width: int) -> DataFrame:
    """Cells within a square radius of a mask but not in it: row runs are widened, copied up and down, and thinned."""
    rows = cells.select("grid", F.col("col"), F.explode(F.sequence(F.greatest(F.col("row") - radius, F.lit(0)), F.least(F.col("row") + radius, F.lit(height - 1)))).alias("row")).distinct()
    wide = rows.select("grid", "row", F.explode(F.sequence(F.greatest(F.col("col") - radius, F.lit(0)), F.least(F.col("col") + radius, F.lit(width - 1)))).alias("col")).distinct()
    return wide.join(cells, ["grid", "row", "col"], "left_anti")


def tiles(cells: DataFrame, k: int, by: Sequence[str] = ("grid",)) -> DataFrame:
    """Whole k x k tiles of a dense grid, named by the offset of their first cell; partial tiles at the edges go."""
    r, c = F.floor(F.col("row") / k).cast("int") * k, F.floor(F.col("col") / k).cast("int") * k
    out = cells.groupBy(*by, r.alias("row0"), c.alias("col0")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.max("value").alias("most"))
    out = out.where(F.col("n") == k * k)
    return out.withColumn("name", F.format_string("r%04d_c%04d", F.col("row0"), F.col("col0")))


def turned(cells: DataFrame, side: int) -> DataFrame:
    """The eight flips and rotations of square grids (variant 0 to 7)."""
    r, c, m = F.col("row"), F.col("col"), F.lit(side - 1)
    ways = [(r, c), (r, m - c), (m - r, c), (m - r, m - c), (c, r), (c, m - r), (m - c, r), (m - c, m - r)]
    all_ways = F.array(*[F.struct(F.lit(i).alias("variant"), a.cast("int").alias("row"), b.cast("int").alias("col")) for i, (a, b) in enumerate(ways)])
    rest = [x for x in cells.columns if x not in ("row", "col")]
    return cells.select(*rest, F.explode(all_ways).alias("w")).select(*rest, "w.variant", "w.row", "w.col")


def stretch(px: DataFrame, by: Sequence[str] = ("chip_id",), value: str = "b08", low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Values stretched between two exact percentiles of their group and clipped to [0, 1]."""
    ends = px.groupBy(*by).agg(F.percentile(value, F.array(F.lit(low), F.lit(high))).alias("e"))
    out = px.join(ends, list(by))
    scaled = F.try_divide(F.col(value) - F.col("e")[0], F.col("e")[1] - F.col("e")[0])
    return out.withColumn("stretched", F.least(F.lit(1.0), F.greatest(F.lit(0.0), scaled))).drop("e")


def histogram(rows: DataFrame, value: Column, lo: float, hi: float, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Counts and densities over equal bins of [lo, hi]; values outside are left out, the last bin is closed."""
    step = (hi - lo) / bins
    at = F.least(F.floor((value - lo) / step), F.lit(bins - 1)).cast("int")
    out = rows.where(value.between(lo, hi)).groupBy(*by, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy(*by) if by else W.partitionBy(F.lit(0)))
    return out.withColumn("density", F.col("n") / (total * step))


def log_histogram(rows: DataFrame, value: str, start: float, bins: int) -> DataFrame:
    """Counts over bins of equal width in the logarithm, from ``start`` to the largest value there is; every bin has a row.

    Two passes: the largest value, then the counts. bin, low, high (edges), n. Values below ``start`` are left out, the last bin is closed;
    without a value above ``start`` there are no bins.
    """
    top = rows.agg(F.max(value).alias("top")).where(F.col("top") > start)
    step = (F.log10("top") - F.log10(F.lit(float(start)))) / bins
    edge = lambda i: F.pow(F.lit(10.0), F.log10(F.lit(float(start))) + i * F.col("step"))
    top = top.select("top", step.alias("step"))
    at = F.least(F.floor((F.log10(value) - F.log10(F.lit(float(start)))) / F.col("step")), F.lit(bins - 1)).cast("int")
    n = rows.where(F.col(value) >= start).join(F.broadcast(top)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    dense = top.select("step", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return dense.join(F.broadcast(n), "bin", "left").select("bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def densities(rows: DataFrame, value: str, kind: str, kinds: Sequence[str], by: Sequence[str], lo: float, hi: float, bins: int) -> DataFrame:
    """Counts and densities of several kinds of values on the same edges, beside each other; every bin of a group has a row.

    by..., bin, and for each kind n_<kind> and d_<kind>, its density (null if the group has no value of the kind)."""
    h = histogram(rows.where(F.col(kind).isin(*kinds)), F.col(value), lo, hi, bins, [*by, kind])
    h = h.groupBy(*by, "bin").agg(*[x for k in kinds for x in (F.sum(F.when(F.col(kind) == k, F.col("n"))).alias(f"n_{k}"), F.sum(F.when(F.col(kind) == k, F.col("density"))).alias(f"d_{k}"))])
    groups = rows.groupBy(*by).agg(*[F.count_if((F.col(kind) == k) & F.col(value).between(lo, hi)).alias(f"t_{k}") for k in kinds])
    dense = groups.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = dense.join(h, [*by, "bin"], "left")
    return out.select(*by, "bin", *[x for k in kinds for x in (F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}"), F.when(F.col(f"t_{k}") > 0, F.coalesce(f"d_{k}", F.lit(0.0))).alias(f"d_{k}"))])
