"""Queries over rings of objects, written collections of annotations and imports that can be repeated."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry as G
from ..sources import io as IO
from ..sources import views as V
from ..sources.scratch import materialise, scratch_folder
from .common import INVENTORY, PX, rounded
from .raster import COMP, _labels

Q, SQL = {}, {}


def query(name: str, sql: str, views: str):
    def put(f):
        Q[name] = lambda spark, sf: rounded(f(spark, sf))
        SQL[name] = "WITH RECURSIVE " + views.strip() + sql
        return f

    return put


#: Rings of labelled cells ``lab`` in SQL: unit edges, each followed by the one that turns right, goes on or turns left, walked from the smallest id back to it.
RINGS = COMP.format(cond="b08 >= 0.55") + """,
nb(side, dr, dc, ax, ay, bx, by_) AS (VALUES (0, -1, 0, 0, 0, 1, 0), (1, 0, 1, 1, 0, 1, 1), (2, 1, 0, 1, 1, 0, 1), (3, 0, -1, 0, 1, 0, 0)),
ue AS (SELECT a.g, a.l, side, a.col + ax AS x0, a."row" + ay AS y0, a.col + bx AS x1, a."row" + by_ AS y1, ((a."row" + ay) * 1048576 + a.col + ax) * 4 + side AS id FROM lab a, nb
  WHERE NOT EXISTS (SELECT 1 FROM lab b WHERE b.g = a.g AND b."row" = a."row" + dr AND b.col = a.col + dc)),
nx AS (SELECT a.g, a.id, arg_min(b.id, CASE (b.side - a.side + 4) % 4 WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END) AS nid FROM ue a JOIN ue b ON b.g = a.g AND b.x0 = a.x1 AND b.y0 = a.y1 AND (b.side - a.side + 4) % 4 <> 2 GROUP BY a.g, a.id),
wk(g, head, cur, n) AS (SELECT g, id, nid, 1 FROM nx UNION ALL SELECT wk.g, head, nid, n + 1 FROM wk JOIN nx ON nx.g = wk.g AND nx.id = wk.cur WHERE wk.cur > head),
hd AS (SELECT g, head FROM wk WHERE cur = head),
st AS (SELECT wk.g, wk.head, ue.*, n % max(n) OVER (PARTITION BY wk.g, wk.head) AS k FROM wk JOIN hd USING (g, head) JOIN ue ON ue.g = wk.g AND ue.id = wk.cur),
tn AS (SELECT *, coalesce(lag(side) OVER o, last_value(side) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) <> side AS turn FROM st WINDOW o AS (PARTITION BY g, head ORDER BY k)),
rg AS (SELECT g, head, any_value(l) AS l, sum(x0 * y1 - x1 * y0) / 2.0 AS signed, string_agg(x0 || ' ' || y0, ',' ORDER BY k) FILTER (turn) AS ring, min(x0) AS bx0, max(x0) AS bx1, min(y0) AS by0, max(y0) AS by1 FROM tn GROUP BY g, head)"""


def _polygons(spark, sf):
    return G.rings(_labels(spark, sf, "b08 >= 0.55"))


def _text(ring: str):
    return F.array_join(F.transform(ring, lambda p: F.concat_ws(" ", p["x"].cast("int").cast("string"), p["y"].cast("int").cast("string"))), ",")


@query("R11_object_rings", RINGS + " SELECT g AS grid, l AS label, signed < 0 AS hole, abs(signed)::DOUBLE AS area, ring FROM rg", PX)
def object_rings(spark, sf):
    return _polygons(spark, sf).select("grid", "label", "hole", "area", _text("ring").alias("ring"))


@query("R11_ring_round_trip", RINGS + " SELECT g AS grid, l AS label, count(*) AS n, count(*) AS n_back, 0::BIGINT AS n_other FROM lab GROUP BY ALL", PX)
def round_trip(spark, sf):
    """Rings of a mask, filled again: cells of each object, cells that came back, and cells in only one of them."""
    cells = materialise(_labels(spark, sf, "b08 >= 0.55").select("grid", "label", "row", "col"))
    back = G.filled(materialise(G.rings(cells)), V.SIDE, V.SIDE)
    both = cells.withColumn("a", F.lit(1)).join(back.withColumn("b", F.lit(1)), ["grid", "label", "row", "col"], "full_outer")
    return both.groupBy("grid", "label").agg(F.count("a").alias("n"), F.count("b").alias("n_back"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("n_other"))


def _written(spark, sf) -> str:
    images = V.chips(spark, sf).select(F.col("chip_id").alias("grid"), F.concat(F.lit("chip_"), F.col("chip_id").cast("string"), F.lit(".tif")).alias("file_name"), F.lit(V.SIDE).alias("width"), F.lit(V.SIDE).alias("height"))
    path = scratch_folder(spark, "collections")
    named, own = IO.annotations_of(images, _polygons(spark, sf), category=2, least_area=2)
    IO.write_collection(named, own, [(1, "shadow"), (2, "iceberg")], path)
    return path


IMAGES = ", im AS (SELECT chip_id AS g, 'chip_' || chip_id || '.tif' AS file_name, row_number() OVER (ORDER BY 'chip_' || chip_id || '.tif') AS id FROM (SELECT DISTINCT chip_id FROM px)), an AS (SELECT row_number() OVER (ORDER BY im.id, l) AS id, im.id AS image_id, ring, bx0, by0, bx1 - bx0 AS w, by1 - by0 AS h, signed AS area FROM rg JOIN im USING (g) WHERE signed >= 2)"


@query("S7_collection_files", RINGS + IMAGES + " SELECT id, image_id, bx0::DOUBLE AS x, by0::DOUBLE AS y, w::DOUBLE AS w, h::DOUBLE AS h, area::DOUBLE AS area, replace(ring, ' ', ',') AS points FROM an", PX)
def collection_files(spark, sf):
    """Annotations of a collection that was written and read back: global ids, boxes, areas, polygons."""
    _, a = IO.scan_collection(spark, _written(spark, sf), "iceberg")
    points = F.array_join(F.transform(F.get("segmentation", F.lit(0)), lambda v: v.cast("int").cast("string")), ",")
    return a.where("wanted").select("id", "image_id", *[F.get("bbox", F.lit(i)).alias(c) for i, c in enumerate("xywh")], "area", points.alias("points"))


@query("S6_collection_files", RINGS + IMAGES + " SELECT im.id AS image_id, file_name, count(an.id) AS n, coalesce(sum(area), 0)::DOUBLE AS area FROM im LEFT JOIN an ON an.image_id = im.id GROUP BY ALL", PX)
def images_scan(spark, sf):
    """All images of written files, those without annotations too; the category is found by its default id."""
    i, a = IO.scan_collection(spark, _written(spark, sf), "no such name")
    own = a.where("wanted").select("image_id", F.col("id").alias("a"), "area")
    return i.join(own, i.id == own.image_id, "left").groupBy(i.id.alias("image_id"), "file_name").agg(F.count("a").alias("n"), F.coalesce(F.sum("area"), F.lit(0.0)).alias("area"))


def _listed(spark, sf, of):
    """Files of an import (every 50th chip under two regions), chips' grids (every 7th is missing) and predictions."""
    inv = V.inventory(spark, sf).where(of)
    name = F.concat(F.lit("chip_"), F.col("chip").cast("string"), F.when(F.col("chip") % 5 == 0, "_B08").otherwise(""), F.lit(".png"))
    files = inv.select(name.alias("filename"), F.explode(F.when(F.col("chip") % 50 == 0, F.array(F.lit("kq"), F.lit("sk"))).otherwise(F.array(F.lit("kq")))).alias("region"), "sza_bin")
    stem = F.concat(F.lit("chip_"), F.col("chip").cast("string")).alias("stem")
    grids = inv.where("chip % 7 > 0").select(stem)
    preds = inv.where("n_objects > 0").select(stem, F.lit("iceberg").alias("class"), F.explode(F.sequence(F.lit(1), "n_objects")).alias("area_m2")).withColumn("area_m2", F.col("area_m2").cast("double"))
    return files, grids, preds


def _import_sql() -> str:
    """Three imports: multiples of 3, multiples of 2, and the second once more."""
    runs = []
    for run, (batch, of, before) in enumerate((("b1", "chip % 3 = 0", "false"), ("b2", "chip % 2 = 0", "chip % 3 = 0"), ("b2", "chip % 2 = 0", "true")), 1):
        runs.append(f"SELECT {run} AS run, chip, n_objects, unnest(range(CASE WHEN chip % 50 = 0 THEN 2 ELSE 1 END)) AS nth, ({before}) AND chip % 7 > 0 AS had FROM inv WHERE {of}")
    o = "CASE WHEN nth > 0 OR had THEN 'skipped' WHEN chip % 7 = 0 THEN 'no_tif' ELSE 'imported' END"
    return f", r AS ({' UNION ALL '.join(runs)}), q AS (SELECT *, {o} AS outcome FROM r) SELECT CAST(run AS INT) AS run, outcome, count(*) AS n, count(*) FILTER (outcome = 'imported' AND n_objects = 0) AS n_empty, (SELECT count(*) FROM inv WHERE chip % 7 > 0 AND (chip % 3 = 0 OR q.run > 1 AND chip % 2 = 0)) AS n_chips, (SELECT coalesce(sum(n_objects), 0)::BIGINT FROM inv WHERE chip % 7 > 0 AND (chip % 3 = 0 OR q.run > 1 AND chip % 2 = 0)) AS n_predictions FROM q GROUP BY run, outcome"


@query("S14_repeated_import", _import_sql(), INVENTORY)
def repeated_import(spark, sf):
    """Outcomes of three imports into one table, of which the third repeats the second, and what the table holds after each."""
    path, out = scratch_folder(spark, "imports"), None
    for run, (batch, of) in enumerate((("b1", "chip % 3 = 0"), ("b2", "chip % 2 = 0"), ("b2", "chip % 2 = 0")), 1):
        done = IO.import_chips(*_listed(spark, sf, of), path, batch)
        n = done.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.count_if("no_predictions").alias("n_empty"))
        have = IO.read_chips(spark, path).agg(F.count(F.lit(1)).alias("n_chips"), F.coalesce(F.sum("prediction_count"), F.lit(0)).alias("n_predictions"))
        part = materialise(n.join(F.broadcast(have)).select(F.lit(run).alias("run"), "*"))
        out = part if out is None else out.unionByName(part)
    return out
