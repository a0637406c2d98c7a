"""Queries over files, collections, scene grids and the rarer joins and raster steps."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import geometry as G
from ..operators import labelling as L
from ..operators import objects as O
from ..operators import raster as R
from ..operators import sampling as S
from ..sources import io as IO
from ..sources import views as V
from ..sources.scratch import materialise, scratch_folder
from .common import INVENTORY, PAIRS, PX, rounded
from .pairs import SPLIT, TEST, VAL
from .raster import COMP, FIRST, _labels
from .records import EXP, NAMES, SUBS, _scenes

Q, SQL = {}, {}


def query(name: str, sql: str | None = None, views: str = ""):
    def put(f):
        Q[name] = lambda spark, sf: rounded(f(spark, sf))
        if sql:
            SQL[name] = f"WITH RECURSIVE {views.strip()}{sql}" if views else sql
        return f

    return put


def _folder(spark):
    return scratch_folder(spark, "files")


@query("S3_partitioned_objects", " SELECT sza_bin, method, count(*) AS n, round(sum(a_pred), 3) AS area FROM pr WHERE sza_bin <> 'sza_gt75' GROUP BY ALL", PAIRS)
def partitioned(spark, sf):
    path = _folder(spark)
    IO.write_objects(V.pair_rows(spark, sf).withColumn("class_name", F.lit("object")), path)
    return IO.read_objects(spark, path).where("sza_bin <> 'sza_gt75'").groupBy("sza_bin", "method").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("a_pred"), 3).alias("area"))


@query("S4_region_class_filter", " SELECT region, method, count(*) AS n FROM pr WHERE l_ok GROUP BY ALL".replace("l_ok", "ref_id % 3 = 0"), PAIRS)
def region_class(spark, sf):
    path = _folder(spark)
    rows = V.pair_rows(spark, sf).withColumn("class_name", F.when(F.col("ref_id") % 3 == 0, "object").otherwise("shadow"))
    IO.write_objects(rows, path, ("region", "sza_bin", "method"))
    return IO.read_objects(spark, path, "object").groupBy("region", "method").agg(F.count(F.lit(1)).alias("n"))


@query("S5_preferred_source", " SELECT chip, CASE WHEN chip % 4 = 0 THEN 'own' ELSE 'merged' END AS used, CASE WHEN chip % 4 = 0 THEN n_objects + 1 ELSE n_objects END AS n FROM inv WHERE chip % 4 = 0 OR chip % 5 > 0", INVENTORY)
def preferred(spark, sf):
    """Rows of a chip's own file if there is one, else those of the merged file."""
    inv = V.inventory(spark, sf)
    own = inv.where("chip % 4 = 0").select("chip", F.lit("own").alias("used"), (F.col("n_objects") + 1).alias("n"), F.lit(0).alias("prio"))
    merged = inv.where("chip % 5 > 0").select("chip", F.lit("merged").alias("used"), F.col("n_objects").alias("n"), F.lit(1).alias("prio"))
    both = own.unionByName(merged).withColumn("first", F.min("prio").over(W.partitionBy("chip")))
    return both.where("prio = first").select("chip", "used", "n")


def _collection(spark, sf):
    inv = V.inventory(spark, sf)
    images = inv.select(F.col("chip").alias("id"), F.concat(F.lit("chip_"), F.col("chip").cast("string"), F.lit(".tif")).alias("file_name"), F.lit(256).alias("width"), F.lit(256).alias("height"))
    a = inv.where("n_objects > 0").select(F.col("chip").alias("image_id"), "max_rl", F.explode(F.sequence(F.lit(1), F.col("n_objects"))).alias("k"))
    side = F.col("max_rl") / F.col("k")
    anns = a.select((F.col("image_id") * 10 + F.col("k")).alias("id"), "image_id", (F.col("k") % 2 + 1).cast("int").alias("category_id"), F.array(F.lit(0.0), F.lit(0.0), side, side).alias("bbox"), (side * side).alias("area"), F.lit(0).alias("iscrowd"))
    return images, anns


ANN = INVENTORY + ", an AS (SELECT chip AS image_id, CAST(unnest(range(1, n_objects + 1)) AS INT) AS k, max_rl FROM inv WHERE n_objects > 0), ann AS (SELECT image_id * 10 + k AS id, image_id, k % 2 + 1 AS category_id, power(max_rl / k, 2) AS area FROM an)"


@query("S6_collection_scan", " SELECT image_id, count(*) AS n, count(*) FILTER (category_id = 2) AS n_wanted, round(sum(area), 4) AS area FROM ann GROUP BY image_id", ANN)
def collection_scan(spark, sf):
    images, anns = _collection(spark, sf)
    docs = materialise(IO.collection_of(images, anns, [(1, "shadow"), (2, "object")]))
    _, back = IO.read_collection(docs, "object")
    return back.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("wanted").alias("n_wanted"), F.round(F.sum("area"), 4).alias("area"))


@query("S7_collection_sink", " SELECT chip AS image_id, n_objects > 0 AS any_annotation, CAST(n_objects AS INT) AS n FROM inv", INVENTORY)
def collection_sink(spark, sf):
    images, anns = _collection(spark, sf)
    docs = IO.collection_of(images, anns, [(1, "shadow"), (2, "object")])
    n = F.json_array_length(F.get_json_object("value", "$.annotations")).cast("int")
    return docs.select("image_id", (n > 0).alias("any_annotation"), n.alias("n"))


@query("S8_csv_round_trip", " SELECT chip, sza_bin, CASE WHEN chip % 7 > 0 THEN round(max_rl, 6) END AS max_rl FROM inv", INVENTORY)
def csv_round_trip(spark, sf):
    path = _folder(spark)
    IO.write_csv(V.inventory(spark, sf).select("chip", "sza_bin", F.when(F.col("chip") % 7 > 0, F.col("max_rl")).alias("max_rl")), path)
    return IO.read_csv(spark, path, "chip long, sza_bin string, max_rl double")


@query("S9_manifest_round_trip", " SELECT chip, sza_bin, n_objects FROM inv", INVENTORY)
def manifest(spark, sf):
    path = _folder(spark)
    IO.manifest_lines(V.inventory(spark, sf).select("chip", "sza_bin", "n_objects")).write.text(path)
    return IO.read_manifest(spark.read.text(path), "chip long, sza_bin string, n_objects int", ["chip", "sza_bin"])


@query("S12_skip_log", " SELECT chip, 'empty' AS reason, CAST(NULL AS DOUBLE) AS max_rl FROM inv WHERE n_objects = 0 UNION ALL SELECT chip, 'small', round(max_rl, 6) FROM inv WHERE n_objects > 0 AND max_rl < 200", INVENTORY)
def skip_log(spark, sf):
    path, inv = _folder(spark), V.inventory(spark, sf)
    schema = T.StructType().add("chip", "long").add("reason", "string").add("max_rl", "double")
    a = inv.where("n_objects = 0").select("chip", F.lit("empty").alias("reason"))
    b = inv.where("n_objects > 0 and max_rl < 200").select("chip", F.lit("small").alias("reason"), "max_rl")
    IO.write_skips([a, b], schema, path)
    return IO.read_csv(spark, path, schema)


@query("S13_labelling_scan", EXP + ", t AS (SELECT 'labelers' AS name, count(DISTINCT labeler) AS n, 0 AS n_loose FROM sb UNION ALL SELECT 'chips', count(*), 0 FROM customer UNION ALL SELECT 'predictions', count(*), count(*) FILTER (assignment NOT IN (SELECT c_custkey FROM customer)) FROM pd UNION ALL SELECT 'assignments', count(*), count(*) FILTER (assignment NOT IN (SELECT c_custkey FROM customer)) FROM (SELECT DISTINCT labeler, assignment FROM sb) UNION ALL SELECT 'results', count(*), count(*) FILTER (assignment NOT IN (SELECT c_custkey FROM customer)) FROM rs UNION ALL SELECT 'decisions', count(*), count(*) FILTER (prediction IS NULL) FROM de) SELECT name, n, CAST(n_loose AS BIGINT) AS n_loose FROM t", SUBS)
def labelling_scan(spark, sf):
    """The six tables of a campaign: rows, and those whose parent (chip; prediction for decisions) is missing."""
    s, p = V.submissions(spark, sf), V.predictions(spark, sf)
    results = L.checked(s, p).where("status = 'accepted'").select(F.col("assignment").alias("chip"), "event_id", "verdict", "edits")
    chips = V.table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("chip"))
    has = chips.withColumn("has", F.lit(1))
    named = lambda df, name: df.join(has, "chip", "left").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("has").isNull()).alias("n_loose")).select(F.lit(name).alias("name"), "n", "n_loose")
    parts = [
        s.agg(F.countDistinct("labeler").alias("n")).select(F.lit("labelers").alias("name"), "n", F.lit(0).cast("long").alias("n_loose")),
        named(chips, "chips"), named(p.select("chip"), "predictions"), named(s.select("labeler", F.col("assignment").alias("chip")).distinct(), "assignments"), named(results.select("chip"), "results"),
        L.decisions(results, p).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("prediction").isNull()).alias("n_loose")).select(F.lit("decisions").alias("name"), "n", "n_loose"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("S14_idempotent_import", ", old AS (SELECT chip FROM inv WHERE chip % 3 = 0), new AS (SELECT chip FROM inv WHERE chip % 2 = 0) SELECT CASE WHEN old.chip IS NULL THEN 'added' ELSE 'skipped' END AS outcome, count(*) AS n FROM new LEFT JOIN old USING (chip) GROUP BY ALL", INVENTORY)
def importing(spark, sf):
    inv = V.inventory(spark, sf).select("chip")
    old, new = inv.where("chip % 3 = 0"), inv.where("chip % 2 = 0")
    out = new.join(old.withColumn("o", F.lit(1)), "chip", "left")
    return out.groupBy(F.when(F.col("o").isNull(), "added").otherwise("skipped").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("S15_test_pools", " SELECT sza_bin AS bin_label, CASE WHEN n_objects > 0 THEN 'GT+' ELSE 'GT0' END AS gt_label, count(*) AS n FROM inv GROUP BY ALL", INVENTORY)
def pools(spark, sf):
    path = _folder(spark)
    rows = V.inventory(spark, sf).select("chip", F.col("sza_bin").alias("bin_label"), F.when(F.col("n_objects") > 0, "GT+").otherwise("GT0").alias("gt_label"))
    rows.write.partitionBy("bin_label", "gt_label").parquet(path)
    return spark.read.parquet(path).groupBy("bin_label", "gt_label").agg(F.count(F.lit(1)).alias("n"))


@query("P28_null_scene_correction", " SELECT i.chip AS image_id, count(ann.id) AS n FROM inv i LEFT JOIN ann ON ann.image_id = i.chip AND CAST(i.chip AS VARCHAR) NOT LIKE '1%' GROUP BY i.chip", ANN)
def null_scene(spark, sf):
    """Annotations of scenes that hold none after all go; their images stay."""
    images, anns = _collection(spark, sf)
    kept = anns.where(~F.col("image_id").cast("string").startswith("1"))
    return images.join(kept.select("image_id", F.col("id").alias("a")), images.id == kept.image_id, "left").groupBy(images.id.alias("image_id")).agg(F.count("a").alias("n"))


@query("J3_annotations_per_image", " SELECT i.chip AS image_id, count(ann.id) AS n, round(max(area), 4) AS most FROM inv i LEFT JOIN ann ON ann.image_id = i.chip GROUP BY i.chip", ANN)
def per_image(spark, sf):
    images, anns = _collection(spark, sf)
    a = anns.select("image_id", F.col("id").alias("a"), "area")
    return images.join(a, images.id == a.image_id, "left").groupBy(images.id.alias("image_id")).agg(F.count("a").alias("n"), F.round(F.max("area"), 4).alias("most"))


@query("J4_block_coverage_lookup", ", bl AS (SELECT chip_id, \"row\" // 4 * 2 + col // 4 AS block, avg(CAST(b08 >= 0.55 AS INT)) AS ic FROM px GROUP BY ALL), ce AS (SELECT chip_id, chip_id % 5 AS block FROM px GROUP BY chip_id) SELECT ce.chip_id, round(ic, 6) AS ic, CASE WHEN ic IS NULL THEN 'no block' WHEN ic < 0.3 THEN 'pass' ELSE 'fail' END AS note FROM ce LEFT JOIN bl USING (chip_id, block)", PX)
def block_lookup(spark, sf):
    px = V.pixels(V.chips(spark, sf)).withColumn("block", (F.floor(F.col("row") / 4) * 2 + F.floor(F.col("col") / 4)).cast("long"))
    b = R.coverage(px, 0.55, ("chip_id", "block")).select("chip_id", "block", "ic")
    c = V.chips(spark, sf).select("chip_id", (F.col("chip_id") % 5).cast("long").alias("block"))
    note = F.when(F.col("ic").isNull(), "no block").when(F.col("ic") < 0.3, "pass").otherwise("fail")
    return c.join(b, ["chip_id", "block"], "left").select("chip_id", "ic", note.alias("note"))


@query("A54_chip_and_block_coverage", ", c AS (SELECT chip_id, avg(CAST(b08 >= 0.55 AS INT)) AS ic FROM px GROUP BY chip_id), b AS (SELECT chip_id, max(ic) AS top, min(ic) AS low FROM (SELECT chip_id, \"row\" // 4 AS r, col // 4 AS k, avg(CAST(b08 >= 0.55 AS INT)) AS ic FROM px GROUP BY ALL) GROUP BY chip_id) SELECT chip_id, round(ic, 6) AS ic, round(top, 6) AS top, round(low, 6) AS low, (ic < 0.3) = (top < 0.3) AS same FROM c JOIN b USING (chip_id)", PX)
def chip_and_block(spark, sf):
    px = V.pixels(V.chips(spark, sf)).withColumns({"r": F.floor(F.col("row") / 4), "k": F.floor(F.col("col") / 4)})
    c = R.coverage(px, 0.55).select("chip_id", "ic")
    b = R.coverage(px, 0.55, ("chip_id", "r", "k")).groupBy("chip_id").agg(F.max("ic").alias("top"), F.min("ic").alias("low"))
    return c.join(b, "chip_id").withColumn("same", (F.col("ic") < 0.3) == (F.col("top") < 0.3))


@query("J6_ring_overlap", ", rr AS (SELECT c_custkey AS g, CAST(c_custkey % 40 AS DOUBLE) AS x, CAST(c_nationkey AS DOUBLE) AS y, 3.0 + c_custkey % 7 AS k FROM customer WHERE c_custkey % 10 > 0), ov AS (SELECT g, (least(x + k, 48) - x) * (least(y + k, 32) - y) AS a, greatest(0, least(x + k, 48) - x - 1) * (least(y + k, 32) - y) AS both_, (least(x + 1 + k, 48) - least(x + 1, 48)) * (least(y + k, 32) - y) AS b FROM rr) SELECT g AS grid, round(both_ / (a + b - both_), 6) AS iou FROM ov WHERE both_ > 0".lstrip(","), "")
def ring_overlap(spark, sf):
    from .records import _rings

    r = _rings(spark, sf).where("ring is not null")
    moved = r.withColumn("ring", F.transform("ring", lambda p: F.struct((p["x"] + 1).alias("x"), p["y"].alias("y"))))
    cells = lambda d: G.rasterise(d, 32, 48).withColumn("label", F.lit(0))
    return O.overlaps(cells(r), cells(moved)).select("grid", "iou")


SQL["J6_ring_overlap"] = "WITH" + SQL["J6_ring_overlap"]


@query("J12_nearest_array", " SELECT vec_id AS probe, vec_id AS chip FROM embeddings WHERE vec_id % 10 = 0 AND len(embedding) = 64")
def nearest_array(spark, sf):
    """Probes (arrays with a little noise) to the chip with the smallest mean absolute difference below 1e-4.

    The key is the mean rounded to a grid of 1e-4; a probe looks into the neighbouring cells too, so no near pair is missed.
    """
    c = V.chips(spark, sf).select("chip_id", "b08")
    mean = F.aggregate("b08", F.lit(0.0), lambda a, x: a + x) / F.size("b08")
    chips = c.withColumn("key", F.floor(mean / 1e-4))
    probes = c.where("chip_id % 10 = 0").select(F.col("chip_id").alias("probe"), F.transform("b08", lambda x: x + 1e-5).alias("b08"))
    probes = probes.select("probe", F.col("b08").alias("p"), F.explode(F.sequence(F.floor(mean / 1e-4) - 1, F.floor(mean / 1e-4) + 1)).alias("key"))
    mae = F.aggregate(F.zip_with("b08", "p", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, x: a + x) / F.size("b08")
    near = probes.join(chips, "key").withColumn("mae", mae).where("mae < 1e-4")
    best = near.groupBy("probe").agg(F.min_by("chip_id", F.struct("mae", "chip_id")).alias("chip"))
    first = best.withColumn("rn", F.row_number().over(W.partitionBy("chip").orderBy("probe")))
    return first.where("rn = 1").select("probe", "chip")


@query("J13_sun_angle_lookup", ", p AS (SELECT s_suppkey AS id, s_suppkey * 0.37 % 24 AS x, s_suppkey * 0.53 % 23 AS y FROM supplier), f AS (SELECT *, CAST(floor(x) AS INT) AS ix, CAST(floor(y) AS INT) AS iy FROM p), z AS (SELECT id, ix, iy, x - ix AS fx, y - iy AS fy, least(ix + 1, 21) AS jx, least(iy + 1, 21) AS jy FROM f WHERE ix <= 21 AND iy <= 21), v AS (SELECT id, CASE WHEN (ix, iy) IN ((5, 5), (6, 5), (9, 9)) OR (jx, iy) IN ((5, 5), (6, 5), (9, 9)) OR (ix, jy) IN ((5, 5), (6, 5), (9, 9)) OR (jx, jy) IN ((5, 5), (6, 5), (9, 9)) THEN NULL ELSE (1 - fx) * (1 - fy) * (60 + 0.1 * ix + 0.2 * iy) + fx * (1 - fy) * (60 + 0.1 * jx + 0.2 * iy) + (1 - fx) * fy * (60 + 0.1 * ix + 0.2 * jy) + fx * fy * (60 + 0.1 * jx + 0.2 * jy) END AS z FROM z) SELECT p.id, round(CAST(v.z AS DOUBLE), 6) AS zenith, CASE WHEN v.z IS NULL THEN 'solar' ELSE 'grid' END AS source FROM p LEFT JOIN v USING (id)".lstrip(","))
def sun_lookup(spark, sf):
    p = V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 0.37 % 24).alias("x"), (F.col("s_suppkey") * 0.53 % 23).alias("y"))
    nodes = spark.range(22 * 22).select((F.col("id") % 22).cast("int").alias("ix"), F.floor(F.col("id") / 22).cast("int").alias("iy"))
    hole = F.struct("ix", "iy").isin(*[F.struct(F.lit(a), F.lit(b)) for a, b in ((5, 5), (6, 5), (9, 9))])
    nodes = nodes.withColumn("zenith", F.when(~hole, 60 + 0.1 * F.col("ix") + 0.2 * F.col("iy")))
    f = p.withColumns({"x0": F.floor("x").cast("int"), "y0": F.floor("y").cast("int")})
    corner = lambda dx, dy: F.struct(F.least(F.col("x0") + dx, F.lit(21)).alias("ix"), F.least(F.col("y0") + dy, F.lit(21)).alias("iy"), ((F.col("x") - F.col("x0")) if dx else (1 - (F.col("x") - F.col("x0")))).alias("wx"), ((F.col("y") - F.col("y0")) if dy else (1 - (F.col("y") - F.col("y0")))).alias("wy"))
    four = f.where("x0 <= 21 and y0 <= 21").select("id", F.explode(F.array(corner(0, 0), corner(1, 0), corner(0, 1), corner(1, 1))).alias("c")).select("id", "c.*")
    z = four.join(F.broadcast(nodes), ["ix", "iy"]).groupBy("id").agg(F.sum(F.col("wx") * F.col("wy") * F.col("zenith")).alias("s"), F.count("zenith").alias("n"))
    z = z.select("id", F.when(F.col("n") == 4, F.col("s")).alias("zenith"))
    return p.select("id").join(z, "id", "left").withColumn("source", F.when(F.col("zenith").isNull(), "solar").otherwise("grid"))


SQL["J13_sun_angle_lookup"] = "WITH" + SQL["J13_sun_angle_lookup"]


@query("A53_angle_source_agreement", ", s AS (SELECT region, orbit % 30 + 55.0 AS a, CASE WHEN id % 9 > 0 THEN orbit % 30 + 55.0 + (id % 13) / 10.0 END AS b FROM rg) SELECT region, round(avg(abs(a - b)), 6) AS mean_diff, round(max(abs(a - b)), 6) AS max_diff, count(*) FILTER (b IS NULL) AS without FROM s GROUP BY region", NAMES)
def angle_agreement(spark, sf):
    a = (F.col("orbit") % 30 + 55.0).alias("a")
    s = _scenes(spark, sf).select("region", a, F.when(F.col("id") % 9 > 0, F.col("orbit") % 30 + 55.0 + (F.col("id") % 13) / 10.0).alias("b"))
    d = F.abs(F.col("a") - F.col("b"))
    return s.groupBy("region").agg(F.avg(d).alias("mean_diff"), F.max(d).alias("max_diff"), F.count_if(F.col("b").isNull()).alias("without"))


@query("J15_cloud_fraction", ", b AS (SELECT s_suppkey AS id, s_suppkey % 30 AS x0, s_suppkey % 30 + s_suppkey % 5 AS x1, s_suppkey % 25 AS y0, s_suppkey % 25 + 3 AS y1 FROM supplier), c AS (SELECT id, ix, iy FROM b, range(22) a(ix), range(22) d(iy) WHERE ix BETWEEN x0 AND x1 AND iy BETWEEN y0 AND y1) SELECT b.id, round(avg(CAST((ix * iy % 4) & 3 > 0 AS INT)), 6) AS cloud FROM b LEFT JOIN c USING (id) GROUP BY b.id".lstrip(","))
def cloud_fraction(spark, sf):
    b = V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 30).alias("x0"), (F.col("s_suppkey") % 25).alias("y0"), (F.col("s_suppkey") % 5).alias("w"))
    mask = spark.range(22 * 22).select((F.col("id") % 22).alias("ix"), F.floor(F.col("id") / 22).cast("long").alias("iy")).withColumn("v", F.col("ix") * F.col("iy") % 4)
    cells = b.select("id", F.explode(F.sequence("x0", F.col("x0") + F.col("w"))).alias("ix"), "y0").select("id", "ix", F.explode(F.sequence(F.col("y0"), F.col("y0") + 3)).alias("iy"))
    hit = cells.join(F.broadcast(mask), ["ix", "iy"]).groupBy("id").agg(F.avg((F.col("v").bitwiseAND(3) > 0).cast("int")).alias("cloud"))
    return b.select("id").join(hit, "id", "left")


SQL["J15_cloud_fraction"] = "WITH" + SQL["J15_cloud_fraction"]


@query("J17_pass_set", ", ps AS (SELECT DISTINCT l_partkey AS chip FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 40) SELECT chip, sza_bin FROM inv WHERE chip IN (SELECT chip FROM ps)", INVENTORY)
def pass_set(spark, sf):
    """Chips in the quality list, which is another table."""
    listed = V.table(spark, sf, "lineitem").where("l_returnflag = 'R' and l_quantity >= 40").select(F.col("l_partkey").cast("long").alias("chip"))
    return V.inventory(spark, sf).join(listed, "chip", "left_semi").select("chip", "sza_bin")


@query("J23_key_union", " SELECT chip_id FROM cells WHERE cls = 1 UNION SELECT chip_id FROM cells WHERE p > 0.6", PX)
def key_union(spark, sf):
    px = V.cells(spark, sf)
    return px.where("cls = 1").select("chip_id").union(px.where("p > 0.6").select("chip_id")).distinct()


@query("A30_belt_contrast", ', m AS (SELECT chip_id, "row" AS r, col AS c FROM cells WHERE cls = 1), bt AS (SELECT x.chip_id, avg(b08) AS belt FROM cells x WHERE cls <> 1 AND EXISTS (SELECT 1 FROM m WHERE m.chip_id = x.chip_id AND abs(m.r - x."row") <= 1 AND abs(m.c - x.col) <= 1) GROUP BY x.chip_id), ob AS (SELECT chip_id, avg(b08) AS obj FROM cells WHERE cls = 1 GROUP BY chip_id) SELECT chip_id, round(obj, 6) AS obj, round(belt, 6) AS belt FROM ob LEFT JOIN bt USING (chip_id)', PX)
def belt_contrast(spark, sf):
    px = V.cells(spark, sf)
    obj = px.where("cls = 1")
    belt = R.belt(obj.select(F.col("chip_id").alias("grid"), "row", "col"), 1, 8, 8).withColumnRenamed("grid", "chip_id")
    b = px.join(belt, ["chip_id", "row", "col"]).groupBy("chip_id").agg(F.avg("b08").alias("belt"))
    return obj.groupBy("chip_id").agg(F.avg("b08").alias("obj")).join(b, "chip_id", "left")


@query("A35_class_pixel_share", " SELECT sza_bin, CAST(cls AS INT) AS cls, round(count(*) / sum(count(*)) OVER (PARTITION BY sza_bin), 6) AS share FROM cells GROUP BY sza_bin, cls", PX)
def class_share(spark, sf):
    n = V.cells(spark, sf).groupBy("sza_bin", "cls").agg(F.count(F.lit(1)).alias("n"))
    return n.select("sza_bin", "cls", (F.col("n") / F.sum("n").over(W.partitionBy("sza_bin"))).alias("share"))


@query("A43_decisions_by_region", ", g AS (SELECT chip_id, region, avg(CAST(b08 > 0.55 AS INT)) AS ic, quantile_cont(b08, 0.95) AS p95 FROM px GROUP BY ALL) SELECT region, CASE WHEN ic >= 0.45 THEN 'coverage' WHEN p95 > 0.7 THEN 'p95' ELSE 'accepted' END AS decision, count(*) AS n FROM g GROUP BY ALL", PX)
def decisions(spark, sf):
    g = V.pixels(V.chips(spark, sf)).groupBy("chip_id", "region").agg(F.avg((F.col("b08") > 0.55).cast("int")).alias("ic"), F.percentile("b08", F.lit(0.95)).alias("p95"))
    d = F.when(F.col("ic") >= 0.45, "coverage").when(F.col("p95") > 0.7, "p95").otherwise("accepted")
    return g.groupBy("region", d.alias("decision")).agg(F.count(F.lit(1)).alias("n"))


@query("A62_dataset_audit", SPLIT + ", a AS (SELECT sza_bin, count(*) AS n_chips, sum(n_objects)::BIGINT AS n_objects, count(*) FILTER (n_objects = 0 AND max_rl > 900 AND split <> 'train') AS masked_outside_train FROM sp GROUP BY sza_bin), l AS (SELECT sza_bin, 'n_chips' AS field, n_chips AS actual FROM a UNION ALL SELECT sza_bin, 'n_objects', n_objects FROM a UNION ALL SELECT sza_bin, 'masked_outside_train', masked_outside_train FROM a), e(field, expected) AS (VALUES ('n_chips', 500), ('n_objects', 1000), ('masked_outside_train', 0)) SELECT sza_bin, field, actual, expected, actual = expected AS ok FROM l JOIN e USING (field)", INVENTORY)
def audit(spark, sf):
    """Expected against actual values; masked chips (null chips of large scenes here) may be in training only."""
    masked = F.count_if((F.col("n_objects") == 0) & (F.col("max_rl") > 900) & (F.col("split") != "train"))
    a = S.stratified_split(V.inventory(spark, sf), TEST, VAL, V.BINS).groupBy("sza_bin").agg(F.count(F.lit(1)).alias("n_chips"), F.sum("n_objects").alias("n_objects"), masked.alias("masked_outside_train"))
    long = a.select("sza_bin", F.expr("stack(3, 'n_chips', n_chips, 'n_objects', n_objects, 'masked_outside_train', masked_outside_train) as (field, actual)"))
    want = spark.createDataFrame([("n_chips", 500), ("n_objects", 1000), ("masked_outside_train", 0)], "field string, expected int")
    return long.join(F.broadcast(want), "field").select("sza_bin", "field", "actual", "expected", (F.col("actual") == F.col("expected")).alias("ok"))


@query("W14_global_object_ids", COMP.format(cond="b08 >= 0.60") + ", s AS (SELECT DISTINCT g, l FROM lab) SELECT g AS grid, l AS label, row_number() OVER (ORDER BY g, l) AS object_id FROM s", PX)
def object_ids(spark, sf):
    """Numbers from 1 over all objects: positions within a chip plus the chips' offsets."""
    s = O.sizes(_labels(spark, sf, "b08 >= 0.60")).select("grid", "label")
    return S.with_positions(s, "grid", "label").select("grid", "label", (F.col("global_index") + 1).alias("object_id"))


@query("U4_stable_prefixes", ", t AS (SELECT satellite, list(left(tile, 2) ORDER BY id) AS ps FROM sc GROUP BY satellite) SELECT satellite, array_to_string(list_transform(list_filter(list_zip(ps, range(1, len(ps) + 1)), lambda x: list_position(ps, x[1]) = x[2]), lambda x: x[1]), ',') AS prefixes FROM t", NAMES)
def prefixes(spark, sf):
    s = _scenes(spark, sf).withColumn("pre", F.substring("tile", 1, 2))
    first = s.groupBy("satellite", "pre").agg(F.min("id").alias("first"))
    return first.groupBy("satellite").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "pre"))), lambda x: x["pre"]), ",").alias("prefixes"))


@query("R5_small_missed", COMP.format(cond="b08 >= 0.55") + ', bu AS (SELECT DISTINCT chip_id AS g, "row" + dr AS r, col + dc AS c FROM cells, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) v(dr, dc) WHERE cls = 1), k AS (SELECT g, l, count(*) AS px FROM lab WHERE NOT EXISTS (SELECT 1 FROM bu WHERE bu.g = lab.g AND bu.r = lab."row" AND bu.c = lab.col) GROUP BY ALL) SELECT g AS grid, l AS label, px FROM k WHERE px > 1 AND px < 8', PX)
def small_missed(spark, sf):
    """Bright components, trimmed by the buffered annotations after labelling, of more than 1 and fewer than 8 cells."""
    ann = R.dilate_cross(V.cells(spark, sf).where("cls = 1").select(F.col("chip_id").alias("grid"), "row", "col"), 8, 8)
    left = _labels(spark, sf, "b08 >= 0.55").join(ann, ["grid", "row", "col"], "left_anti")
    return O.sizes(left).where("px > 1 and px < 8").select("grid", "label", "px")


GUARD = FIRST.format(cond="b08 >= 0.55") + ', bg AS (SELECT g, l FROM gtl GROUP BY ALL HAVING count(*) >= 10), w1 AS (SELECT DISTINCT gtl.g, gtl."row" + dr AS r, gtl.col + dc AS c FROM gtl JOIN bg USING (g, l), (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) v(dr, dc) WHERE gtl."row" + dr BETWEEN 0 AND 7 AND gtl.col + dc BETWEEN 0 AND 7), w2 AS (SELECT DISTINCT g, r + dr AS r, c + dc AS c FROM w1, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) v(dr, dc))'


@query("R7_large_bright_guard", GUARD + COMP.format(cond='b08 >= 0.60 AND NOT EXISTS (SELECT 1 FROM w2 WHERE w2.g = cells.chip_id AND w2.r = cells."row" AND w2.c = cells.col)') + " SELECT g AS grid, l AS label, count(*) AS px FROM lab GROUP BY ALL HAVING count(*) BETWEEN 2 AND 32", PX)
def bright_guard(spark, sf):
    """Candidates of 2 to 32 cells at the higher threshold that no large bright region, widened twice, touches."""
    big = O.sizes(_labels(spark, sf, "b08 >= 0.55")).where("px >= 10").select("grid", "label")
    region = _labels(spark, sf, "b08 >= 0.55").join(big, ["grid", "label"], "left_semi").select("grid", "row", "col")
    wide = R.dilate_cross(R.dilate_cross(region, 8, 8), 8, 8)
    cells = V.cells(spark, sf).where("b08 >= 0.60").select(F.col("chip_id").alias("grid"), "row", "col").join(wide, ["grid", "row", "col"], "left_anti")
    return O.sizes(O.components(cells, width=8)).where("px between 2 and 32").select("grid", "label", "px")


@query("R8_include_and_fill", COMP.format(cond="cls = 0") + ', inn AS (SELECT g, l, count(*) AS c FROM lab GROUP BY ALL HAVING max(CAST("row" IN (0, 7) OR col IN (0, 7) AS INT)) = 0), al AS (SELECT chip_id AS grid, count(*) AS c FROM cells WHERE cls > 0 GROUP BY chip_id UNION ALL SELECT g, c FROM inn) SELECT grid, CAST(sum(c) AS BIGINT) AS px FROM al GROUP BY grid', PX)
def include_fill(spark, sf):
    """Class 1, class 2 and the background that they enclose: background components that don't reach the border."""
    px = V.cells(spark, sf).withColumnRenamed("chip_id", "grid")
    back = O.components(px.where("cls = 0").select("grid", "row", "col"), width=8)
    edge = (F.col("row").isin(0, 7) | F.col("col").isin(0, 7)).cast("int")
    inner = back.groupBy("grid", "label").agg(F.max(edge).alias("edge")).where("edge = 0").select("grid", "label")
    fill = back.join(inner, ["grid", "label"], "left_semi").select("grid", "row", "col")
    both = px.where("cls > 0").select("grid", "row", "col").unionByName(fill)
    return both.groupBy("grid").agg(F.count(F.lit(1)).alias("px"))
