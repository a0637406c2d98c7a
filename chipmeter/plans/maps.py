"""Queries over affine grids, clipped polygons, scene searches, files that stand for each other, and a campaign's tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import geometry as G
from ..operators import raster as R
from ..operators import search as X
from ..sources import io as IO
from ..sources import views as V
from ..sources.scratch import materialise, scratch_folder
from .common import INVENTORY, PX, rounded
from .records import EXP, NAMES, SUBS, _checked, _decisions, _scenes

Q, SQL = {}, {}


def query(name: str, sql: str, views: str = ""):
    def put(f):
        Q[name] = lambda spark, sf: rounded(f(spark, sf))
        SQL[name] = "WITH RECURSIVE " + (views.strip() + sql if views else sql.lstrip(", "))
        return f

    return put


def _grid(k):
    """A turned grid for each of five scenes: 10 m cells with a shear, and an origin of its own."""
    s = (k % 5).cast("double")
    return F.struct((s * 0 + 10).alias("a"), (s * 2).alias("b"), (s * 1000 + 300).alias("c"), s.alias("d"), (s * 0 - 10).alias("e"), (9000 - s * 500).alias("f"))


@query("J4_affine_blocks", ", ce AS (SELECT DISTINCT chip_id, chip_id % 5 AS s, chip_id * 37 % 4000 AS c, chip_id * 53 % 3000 AS r FROM px), bl AS (SELECT chip_id % 5 AS s, chip_id * 3 % 5 * 1000 AS c0, chip_id * 7 % 4 * 1000 AS r0, avg(CAST(b08 >= 0.55 AS INT)) AS ic FROM px WHERE chip_id % 3 > 0 GROUP BY ALL) SELECT chip_id, c // 1000 * 1000 AS col0, r // 1000 * 1000 AS row0, round(ic, 6) AS ic, CASE WHEN ic IS NULL THEN 'no_block' WHEN ic < 0.35 THEN 'pass' ELSE 'fail' END AS note FROM ce LEFT JOIN bl ON bl.s = ce.s AND c0 = c // 1000 * 1000 AND r0 = r // 1000 * 1000", PX)
def affine_blocks(spark, sf):
    """Chips' centres in map coordinates, back to their scene's grid, to the block there and its coverage."""
    k = F.col("chip_id")
    x, y = G.to_map(k * 37 % 4000 + 0.5, k * 53 % 3000 + 0.5, F.col("gt"))
    chips = V.chips(spark, sf).select(k, (k % 5).alias("scene"), _grid(k).alias("gt")).withColumns({"x": x, "y": y})
    col, row = G.from_map(F.col("x"), F.col("y"), F.col("gt"))
    block = lambda v: (F.floor(v / 1000) * 1000).cast("long")
    at = chips.select(k, "scene", block(col).alias("col0"), block(row).alias("row0"))
    px = V.pixels(V.chips(spark, sf)).where("chip_id % 3 > 0").select((k % 5).alias("scene"), (k * 3 % 5 * 1000).alias("col0"), (k * 7 % 4 * 1000).alias("row0"), "b08")
    ic = R.coverage(px, 0.55, ("scene", "col0", "row0")).select("scene", "col0", "row0", "ic")
    note = F.when(F.col("ic").isNull(), "no_block").when(F.col("ic") < 0.35, "pass").otherwise("fail")
    return at.join(ic, ["scene", "col0", "row0"], "left").select("chip_id", "col0", "row0", "ic", note.alias("note"))


#: Squares in grid places, some too small and some beyond the grid; ten metres and a shear of the scene, in SQL.
SQUARES = ", sq AS (SELECT c_custkey AS id, CAST(c_custkey % 5 AS DOUBLE) AS s, CAST(c_custkey * 7 % 280 AS DOUBLE) AS x, CAST(c_custkey * 11 % 290 AS DOUBLE) AS y, CAST(c_custkey % 6 AS DOUBLE) AS w FROM customer), pt AS (SELECT id, s, k, x + CASE WHEN k IN (1, 2) THEN w ELSE 0 END AS c, y + CASE WHEN k IN (2, 3) THEN w ELSE 0 END AS r FROM sq, (SELECT unnest(range(4)) AS k)), mp AS (SELECT *, 10 * c + 2 * s * r + 1000 * s + 300 AS mx, s * c - 10 * r + 9000 - 500 * s AS my FROM pt), hp AS (SELECT *, greatest(0, least(255, c)) AS hc, greatest(0, least(255, r)) AS hr FROM mp)"


@query("R10_affine_rings", SQUARES + " SELECT id, CASE WHEN count(DISTINCT (mx, my)) >= 3 THEN round(sum(mx), 3) END AS sum_x, CASE WHEN count(DISTINCT (mx, my)) >= 3 THEN round(sum(my), 3) END AS sum_y, CASE WHEN count(DISTINCT (mx, my)) >= 3 AND count(DISTINCT (hc, hr)) >= 3 THEN string_agg(CAST(hc AS INT) || ' ' || CAST(hr AS INT), ',' ORDER BY k) END AS back FROM hp GROUP BY id")
def affine_rings(spark, sf):
    """Rings to map coordinates and back, held inside the grid; rings of fewer than three different points are null."""
    k = F.col("c_custkey").cast("long")
    x, y, w = (k * 7 % 280).cast("double"), (k * 11 % 290).cast("double"), (k % 6).cast("double")
    ring = F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in ((x, y), (x + w, y), (x + w, y + w), (x, y + w))])
    r = V.table(spark, sf, "customer").select(k.alias("id"), _grid(k).alias("gt"), ring.alias("ring")).withColumn("m", G.ring_to_map(F.col("ring"), F.col("gt")))
    total = lambda c: F.round(F.aggregate(F.transform("m", lambda p: p[c]), F.lit(0.0), lambda a, v: a + v), 3)
    back = F.transform(G.ring_to_grid(F.col("m"), F.col("gt"), 256, 256), lambda p: F.concat_ws(" ", F.round(p["x"]).cast("int").cast("string"), F.round(p["y"]).cast("int").cast("string")))
    return r.select("id", total("x").alias("sum_x"), total("y").alias("sum_y"), F.array_join(back, ",").alias("back"))


#: A triangle for each chip, right-angled at a corner of its own; the cells whose centres it holds.
@query("R2_clip_to_polygon", ', q AS (SELECT *, chip_id % 3 AS tx, chip_id % 4 AS ty, 4 + chip_id % 3 AS n FROM px) SELECT chip_id, count(*) FILTER (b08 > 0 AND i) AS n, round(coalesce(sum(b08) FILTER (i), 0), 6) AS total, count(*) AS n_cells FROM (SELECT *, col + CAST(0.5 AS DOUBLE) >= tx AND "row" + CAST(0.5 AS DOUBLE) >= ty AND (col + CAST(0.5 AS DOUBLE) - tx) + ("row" + CAST(0.5 AS DOUBLE) - ty) < n + CAST(0.25 AS DOUBLE) AND chip_id % 10 > 0 AS i FROM q) GROUP BY chip_id', PX)
def clip_to_polygon(spark, sf):
    """Values outside a polygon of their chip are 0; a tenth of the chips have none."""
    k = F.col("chip_id")
    x, y, n = (k % 3).cast("double"), (k % 4).cast("double"), (k % 3).cast("double") + 4.25
    rings = V.chips(spark, sf).where("chip_id % 10 > 0").select(k.alias("grid"), F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in ((x, y), (x + n, y), (x, y + n))]).alias("ring"))
    px = V.pixels(V.chips(spark, sf)).select(k.alias("grid"), "row", "col", "b08")
    out = G.clipped(px, rings, V.SIDE, V.SIDE, ("b08",))
    return out.groupBy(F.col("grid").alias("chip_id")).agg(F.count_if(F.col("b08") > 0).alias("n"), F.sum("b08").alias("total"), F.count(F.lit(1)).alias("n_cells"))


BOXES = [("KQ", 0.0, 12.0, 0.0, 12.0), ("KQ", 10.0, 20.0, 8.0, 20.0), ("SK", 20.0, 35.0, 0.0, 10.0), ("SK", 5.0, 30.0, 10.0, 24.0)]
WINDOWS = [("spring", 3, 5), ("early", 4, 6), ("autumn", 9, 10)]


@query("P23_scene_search", ", bx(region, minx, maxx, miny, maxy) AS (VALUES " + ", ".join(map(str, BOXES)) + "), wi(name, m0, m1) AS (VALUES " + ", ".join(map(str, WINDOWS)) + "), sn AS (SELECT id, acquired, id * 7 % 60 AS x0, id * 7 % 60 + 4 AS x1, id * 3 % 50 AS y0, id * 3 % 50 + 4 AS y1, id * 31 % 101 AS cloud, CASE WHEN id % 4 = 0 THEN 'L2A' ELSE 'L1C' END AS product FROM rg) SELECT DISTINCT id, bx.region, name FROM sn JOIN wi ON month(acquired) BETWEEN m0 AND m1 JOIN bx ON x0 <= maxx AND x1 >= minx AND y0 <= maxy AND y1 >= miny WHERE cloud <= 20 AND product = 'L1C'", NAMES)
def scene_search(spark, sf):
    i = F.col("id")
    s = _scenes(spark, sf).select(i, "acquired", (i * 7 % 60).alias("x0"), (i * 7 % 60 + 4).alias("x1"), (i * 3 % 50).alias("y0"), (i * 3 % 50 + 4).alias("y1"), (i * 31 % 101).alias("cloud"), F.when(i % 4 == 0, "L2A").otherwise("L1C").alias("product"))
    return X.selected_scenes(s, spark.createDataFrame(BOXES, "region string, minx double, maxx double, miny double, maxy double"), spark.createDataFrame(WINDOWS, "name string, m0 int, m1 int"), 20, "L1C")


@query("S5_source_files", " SELECT 'chip_' || chip AS stem, CASE WHEN chip % 4 = 0 THEN 'own' ELSE 'merged' END AS used, CAST(CASE WHEN chip % 4 = 0 THEN n_objects + 1 ELSE n_objects END AS INT) AS n FROM inv WHERE chip % 4 = 0 OR chip % 5 BETWEEN 1 AND 3", INVENTORY)
def source_files(spark, sf):
    """Merged rows name their chip with or without an ending; those of other endings belong to no chip."""
    inv = V.inventory(spark, sf).withColumn("stem", F.concat(F.lit("chip_"), F.col("chip").cast("string")))
    own = inv.where("chip % 4 = 0").select("stem", (F.col("n_objects") + 1).alias("n"))
    name = F.concat("stem", F.when(F.col("chip") % 5 == 1, ".tif").when(F.col("chip") % 5 == 4, ".png").otherwise(""))
    merged = inv.where("chip % 5 > 0").select(name.alias("source_file"), F.col("n_objects").alias("n"))
    known = inv.select("stem")
    return IO.preferred(own, merged).join(known, "stem", "left_semi").select("stem", "used", "n")


@query("S13_campaign_tables", EXP + ", asg AS (SELECT DISTINCT labeler, assignment FROM sb), rs1 AS (SELECT rs.*, (labeler, assignment) IN (SELECT (labeler, assignment) FROM asg WHERE labeler % 50 > 0) AS has FROM rs) SELECT 'chips' AS name, (SELECT count(*) FROM customer) AS n, 0::BIGINT AS n_repeated, 0::BIGINT AS n_loose UNION ALL SELECT 'predictions', count(*), 0, count(*) FILTER (assignment NOT IN (SELECT c_custkey FROM customer)) FROM pd UNION ALL SELECT 'labelers', count(DISTINCT labeler) + 1, 1, 0 FROM sb UNION ALL SELECT 'assignments', count(*), 0, count(*) FILTER (assignment NOT IN (SELECT c_custkey FROM customer)) FROM asg WHERE labeler % 50 > 0 UNION ALL SELECT 'annotation_results', count(*), 0, count(*) FILTER (NOT has) FROM rs1 UNION ALL SELECT 'polygon_decisions', count(*), 0, count(*) FILTER (prediction IS NOT NULL AND (assignment, prediction) NOT IN (SELECT (assignment, prediction) FROM pd)) FROM de", SUBS)
def campaign_tables(spark, sf):
    """Six written tables read with their schemas: rows, repeated keys, lost parents. One labeler stands twice; some labelers' assignments are missing."""
    s, p, rs = V.submissions(spark, sf), V.predictions(spark, sf), _checked(spark, sf).where("status = 'accepted'")
    asg = lambda d: (d["labeler"] * 1_000_000 + d["assignment"]).cast("long")
    who = s.select("labeler").distinct()
    tables = {
        "chips": V.table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.concat(F.lit("chip_"), F.col("c_custkey").cast("string")).alias("filename"), F.lit("kq").alias("region"), V.bin_of("c_custkey").alias("sza_bin")),
        "predictions": p.select((F.col("chip") * 100 + F.col("prediction")).cast("long").alias("id"), F.col("chip").cast("long").alias("chip_id"), F.col("class").alias("class_name"), (G.ring_area(F.col("ring")) * 100).alias("area_m2")),
        "labelers": who.unionByName(who.agg(F.min("labeler").alias("labeler"))).select(F.col("labeler").cast("long").alias("id"), F.concat(F.lit("labeler_"), F.col("labeler").cast("string")).alias("name"), F.lit(False).alias("is_admin")),
        "assignments": s.where("labeler % 50 > 0").select("labeler", "assignment").distinct().select(asg(s).alias("id"), F.col("assignment").cast("long").alias("chip_id"), F.col("labeler").cast("long").alias("labeler_id"), F.lit("pending").alias("status")),
        "annotation_results": rs.select(F.col("event_id").alias("id"), asg(rs).alias("assignment_id"), F.col("verdict").alias("chip_verdict"), F.array_join("tags", ",").alias("tags"), F.col("ts").alias("submitted_at")),
    }
    d = _decisions(spark, sf)
    rid = rs.select(F.col("assignment").alias("chip"), F.col("event_id").alias("result_id"))
    d = d.join(rid, "chip").withColumn("id", F.row_number().over(W.partitionBy("chip").orderBy("prediction", "action")) + F.col("chip") * 10_000)
    tables["polygon_decisions"] = d.select(F.col("id").cast("long").alias("id"), F.col("result_id").cast("long").alias("result_id"), F.when(F.col("prediction").isNotNull(), F.col("chip") * 100 + F.col("prediction")).cast("long").alias("prediction_id"), "action")
    path = scratch_folder(spark, "campaigns")
    for name, t in tables.items():
        t.write.parquet(f"{path}/{name}")
    return materialise(IO.campaign_faults(IO.read_campaign(spark, path)))
