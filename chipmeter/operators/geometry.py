"""Rings, boxes and affine grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import materialise


def ring_from(coords: Column) -> Column:
    """Flat coordinates, given as strings, to an array of points; NULL for rings with fewer than three points."""
    flat = F.filter(F.transform(coords, lambda s: s.try_cast("double")), lambda v: v.isNotNull())
    n = F.floor(F.size(flat) / 2).cast("int")
    pts = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.struct(F.get(flat, i * 2).alias("x"), F.get(flat, i * 2 + 1).alias("y")))
    return F.when(F.size(flat) >= 6, pts)


def ring_area(ring: Column) -> Column:
    """Shoelace formula."""
    turned = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, F.lit(1), F.lit(1)))
    cross = F.zip_with(ring, turned, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, x: s + x)) / 2


def ring_box(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))


def to_pixel(x: Column, y: Column, x0: Column, y0: Column, cell: float) -> tuple[Column, Column]:
    """Column and row of a map point in a north-up grid."""
    return F.floor((x - x0) / cell).cast("int"), F.floor((y0 - y) / cell).cast("int")


def rasterise(rings: DataFrame, height: int, width: int) -> DataFrame:
    """rings (grid, ring) to the cells (grid, row, col) whose centres lie inside one of them, by the even-odd rule; each cell once."""
    return spans(rings, height, width).select("grid", "row", F.explode(F.sequence("c0", "c1")).alias("col"))


def spans(rings: DataFrame, height: int, width: int) -> DataFrame:
    """The cells of :func:`rasterise` as pieces of rows that share no cell: grid, row, c0, c1 (both inside).

    Edges meet the row centres that they span; crossings of a row are ordered by a window and filled in pairs. What rings share is cut from
    the later spans of a row.
    """
    one = rings.where(F.col("ring").isNotNull()).withColumn("id", F.xxhash64("grid", "ring")).dropDuplicates(["grid", "id"])
    turned = F.concat(F.slice("ring", 2, 1 << 20), F.slice("ring", 1, 1))
    e = one.select("grid", "id", F.explode(F.zip_with("ring", turned, lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("e"))
    lo, hi = F.least("e.a.y", "e.b.y"), F.greatest("e.a.y", "e.b.y")
    first, last = F.greatest(F.ceil(lo - 0.5), F.lit(0)), F.least(F.ceil(hi - 0.5) - 1, F.lit(height - 1))
    e = e.withColumns({"r0": first.cast("int"), "r1": last.cast("int")}).where("r0 <= r1").withColumn("row", F.explode(F.sequence("r0", "r1")))
    x = F.col("e.a.x") + (F.col("row") + 0.5 - F.col("e.a.y")) * (F.col("e.b.x") - F.col("e.a.x")) / (F.col("e.b.y") - F.col("e.a.y"))
    w = W.partitionBy("grid", "id", "row").orderBy("x")
    c = e.withColumn("x", x).withColumns({"k": F.row_number().over(w), "x1": F.lead("x").over(w)}).where("k % 2 = 1 and x1 is not null")
    c0, c1 = F.greatest(F.ceil(F.col("x") - 0.5), F.lit(0)).cast("int"), F.least(F.ceil(F.col("x1") - 0.5) - 1, F.lit(width - 1)).cast("int")
    c = c.withColumns({"c0": c0, "c1": c1}).where("c0 <= c1").select("grid", "row", "c0", "c1")
    earlier = W.partitionBy("grid", "row").orderBy("c0", "c1").rowsBetween(W.unboundedPreceding, -1)
    return c.withColumn("c0", F.greatest("c0", F.max("c1").over(earlier) + 1)).where("c0 <= c1")


def boundary(cells: DataFrame) -> DataFrame:
    """Unit edges of a mask with the outside on their other side: grid, row, col and side (N, S, W, E).

    Neighbours are found by windows along rows and along columns. A join would do as well, but Spark takes cells that come from a few
    rings for a small table and would send them all to the driver.
    """
    out = cells.select("grid", "row", "col").withColumns(_free("row", "col", "W", "E"))
    out = out.withColumns(_free("col", "row", "N", "S"))
    sides = F.array_compact(F.array(*[F.when(F.col(s), F.lit(s)) for s in ("N", "S", "W", "E")]))
    return out.where("N or S or W or E").select("grid", "row", "col", F.explode(sides).alias("side"))


def _free(line: str, at: str, before: str, after: str) -> dict[str, Column]:
    """Whether a cell's places before and after it on a line are outside."""
    w = W.partitionBy("grid", line).orderBy(at)
    return {before: F.coalesce(F.lag(at).over(w) < F.col(at) - 1, F.lit(True)), after: F.coalesce(F.lead(at).over(w) > F.col(at) + 1, F.lit(True))}


def in_boxes(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Points with the boxes (region, minx, maxx, miny, maxy) that hold them; boxes are a small dimension table, checked."""
    if boxes.limit(10_001).count() > 10_000:
        raise ValueError("more than 10,000 boxes")
    return points.join(F.broadcast(boxes), F.col("x").between(F.col("minx"), F.col("maxx")) & F.col("y").between(F.col("miny"), F.col("maxy")))


#: Sides of a cell in clockwise order, rows downwards: N runs right, E down, S left, W up; the cell is on the right.
SIDES = ("N", "E", "S", "W")


def ring_segments(cells: DataFrame, width: int = 1 << 20) -> DataFrame:
    """Straight pieces of the outlines of labelled cells (grid, label, row, col): grid, label, side (0 to 3), x0, y0, x1, y1, ``id``.

    Unit edges of one side that follow each other on a line are one piece. A piece runs with its object on the right.
    """
    e = boundary(cells).join(cells.select("grid", "row", "col", "label"), ["grid", "row", "col"])
    side = F.array_position(F.array(*map(F.lit, SIDES)), F.col("side")).cast("int") - 1
    flat = F.col("side") % 2 == 0
    e = e.withColumn("side", side).withColumns({"line": F.when(flat, F.col("row")).otherwise(F.col("col")), "at": F.when(flat, F.col("col")).otherwise(F.col("row"))})
    e = e.withColumn("isle", F.col("at") - F.row_number().over(W.partitionBy("grid", "side", "line").orderBy("at")))
    s = e.groupBy("grid", "side", "line", "isle").agg(F.min("at").alias("a"), F.max("at").alias("b"), F.min("label").alias("label"))
    k, far = F.col("side"), F.col("b") + 1
    corner = lambda n, e_, s_, w: F.when(k == 0, n).when(k == 1, e_).when(k == 2, s_).otherwise(w)
    line, a = F.col("line"), F.col("a")
    s = s.withColumns({"x0": corner(a, line + 1, far, line), "y0": corner(line, a, line + 1, far), "x1": corner(far, line + 1, a, line), "y1": corner(line, far, line + 1, a)})
    return s.select("grid", "label", "side", "x0", "y0", "x1", "y1", ((F.col("y0").cast("long") * width + F.col("x0")) * 4 + k).alias("id"))


def rings(cells: DataFrame, width: int = 1 << 20) -> DataFrame:
    """Closed outlines of labelled cells: grid, label, hole, area (cells, by the shoelace formula) and ring, an array of corners (x, y).

    Outer rings run clockwise (rows downwards), holes the other way; each starts at its upper left corner and has corners at turns only.
    At a corner where two cells touch across, the outline stays at its cell, so objects of 4-neighbours have one outer ring each.

    A piece is followed by the one that starts at its end and turns right, else by the one that turns left. Rings are then found by pointer
    doubling: in each round every piece knows the smallest id among the next 2^k pieces and how far it is, and learns that of
    the next 2^(k+1) by one join, so a ring of n pieces takes log n rounds, and no ring is walked by one task.
    """
    s = materialise(ring_segments(cells, width))
    ahead = s.select("grid", F.col("x0").alias("x1"), F.col("y0").alias("y1"), F.col("side").alias("turned"), F.col("id").alias("after"))
    turn = F.pmod(F.col("turned") - F.col("side"), F.lit(4))
    follow = s.join(ahead, ["grid", "x1", "y1"]).where(turn.isin(1, 3)).groupBy("grid", "id").agg(F.min_by("after", turn).alias("next"))
    step = materialise(follow.select("grid", "id", F.col("next").alias("p"), F.col("id").alias("m"), F.lit(0).cast("long").alias("o")))
    far = 1
    while True:
        other = step.select("grid", F.col("id").alias("p"), F.col("p").alias("p2"), F.col("m").alias("m2"), F.col("o").alias("o2"))
        low = F.col("m2") < F.col("m")
        step = step.join(other, ["grid", "p"]).select(
            "grid", "id", F.col("p2").alias("p"), F.least("m", "m2").alias("m"), F.when(low, F.col("o2") + far).otherwise(F.col("o")).alias("o"), low.alias("changed")
        )
        step, far = materialise(step), far * 2
        if not step.where("changed").limit(1).count():
            break
        step = step.drop("changed")
    corner = F.struct((-F.col("o")).alias("back"), F.col("x0").cast("double").alias("x"), F.col("y0").cast("double").alias("y"))
    # the piece with the smallest id is 0 away from itself, the one behind it the ring's length less one, and so on
    out = s.join(step.select("grid", "id", "m", "o"), ["grid", "id"]).groupBy("grid", F.col("m").alias("head")).agg(
        F.min("label").alias("label"), F.array_sort(F.collect_list(corner)).alias("c"), (F.sum((F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")).cast("double")) / 2).alias("signed")
    )
    pts = F.transform("c", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    turned_first = F.concat(F.slice(pts, -1, 1), F.slice(pts, F.lit(1), F.size(pts) - 1))
    return out.select("grid", "label", (F.col("signed") < 0).alias("hole"), F.abs("signed").alias("area"), turned_first.alias("ring"))


def filled(polygons: DataFrame, height: int, width: int) -> DataFrame:
    """Cells (grid, label, row, col) of polygons as :func:`rings` gives them: those inside the outer rings and not inside holes."""
    own = lambda which: rasterise(polygons.where(which).select(F.struct("grid", "label").alias("grid"), "ring"), height, width)
    out = own(~F.col("hole")).join(own(F.col("hole")), ["grid", "row", "col"], "left_anti")
    return out.select("grid.grid", "grid.label", "row", "col")


def to_map(col: Column, row: Column, gt: Column) -> tuple[Column, Column]:
    """Map coordinates of a place in a grid; gt: struct a to f of the affine x = a col + b row + c, y = d col + e row + f."""
    return gt["a"] * col + gt["b"] * row + gt["c"], gt["d"] * col + gt["e"] * row + gt["f"]


def from_map(x: Column, y: Column, gt: Column) -> tuple[Column, Column]:
    """Column and row, not rounded, of a map point; null where the affine has no inverse."""
    det = gt["a"] * gt["e"] - gt["b"] * gt["d"]
    u, v = x - gt["c"], y - gt["f"]
    return F.try_divide(gt["e"] * u - gt["b"] * v, det), F.try_divide(gt["a"] * v - gt["d"] * u, det)


def _proper(pts: Column, digits: int) -> Column:
    """Points of a ring, or null if fewer than three of them differ at so many digits."""
    return F.when(F.size(F.array_distinct(F.transform(pts, lambda p: F.struct(F.round(p["x"], digits), F.round(p["y"], digits))))) >= 3, pts)


def ring_to_map(ring: Column, gt: Column) -> Column:
    """A ring of grid places in map coordinates; null if degenerate."""
    pts = F.transform(ring, lambda p: F.struct(to_map(p["x"], p["y"], gt)[0].alias("x"), to_map(p["x"], p["y"], gt)[1].alias("y")))
    return _proper(pts, 4)


def ring_to_grid(ring: Column, gt: Column, height: int, width: int) -> Column:
    """A ring in map coordinates as places of a grid, held inside the grid and rounded to 2 digits; null if degenerate then."""
    held = lambda v, n: F.round(F.greatest(F.lit(0.0), F.least(F.lit(float(n - 1)), v)), 2)
    pts = F.transform(ring, lambda p: F.struct(held(from_map(p["x"], p["y"], gt)[0], width).alias("x"), held(from_map(p["x"], p["y"], gt)[1], height).alias("y")))
    return _proper(pts, 2)


def clipped(px: DataFrame, rings: DataFrame, height: int, width: int, values: tuple[str, ...]) -> DataFrame:
    """Cells with ``values`` set to 0 outside the rings (grid, ring) of their grid; a grid without rings is all 0."""
    inside = rasterise(rings, height, width).withColumn("_in", F.lit(True))
    out = px.join(inside, ["grid", "row", "col"], "left")
    return out.withColumns({v: F.when(F.col("_in"), F.col(v)).otherwise(F.lit(0.0)) for v in values}).drop("_in")
