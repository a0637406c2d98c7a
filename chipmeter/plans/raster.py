"""Queries over chips and their cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import objects as O
from ..operators import raster as R
from ..operators.sampling import with_positions
from ..sources import views as V
from ..sources.scratch import materialise
from .common import PX, rounded

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = lambda spark, sf: rounded(f(spark, sf))
        if sql:
            SQL[name] = "WITH RECURSIVE " + PX.strip() + sql
        return f

    return put


def _px(spark, sf):
    return V.cells(spark, sf)


@query("S1_chip_scan", " SELECT chip_id, count(*) AS n, round(min(b08), 6) AS lo, round(max(b08), 6) AS hi, round(avg(b03), 6) AS mean_b03 FROM px GROUP BY chip_id")
def chip_scan(spark, sf):
    return _px(spark, sf).groupBy("chip_id").agg(F.count(F.lit(1)).alias("n"), F.min("b08").alias("lo"), F.max("b08").alias("hi"), F.avg("b03").alias("mean_b03"))


@query("S2_split_arrays_running_index", ", s AS (SELECT chip_id, CASE WHEN chip_id % 10 < 7 THEN 0 WHEN chip_id % 10 < 8 THEN 1 ELSE 2 END AS split FROM px WHERE pos = 0) SELECT chip_id, CAST(split AS INT) AS split, row_number() OVER (PARTITION BY split ORDER BY chip_id) - 1 AS position, row_number() OVER (ORDER BY split, chip_id) - 1 AS global_index FROM s")
def split_arrays(spark, sf):
    c = V.chips(spark, sf)
    k = F.col("chip_id") % 10
    parts = [c.where(w).select("chip_id", F.lit(i).alias("split")) for i, w in enumerate((k < 7, k == 7, k > 7))]
    return with_positions(parts[0].unionByName(parts[1]).unionByName(parts[2]), "split", "chip_id")


@query("P10_conditional_reflectance", ", s AS (SELECT chip_id, CASE WHEN chip_id % 2 = 0 THEN b08 * 10000 ELSE b08 END AS v FROM px), m AS (SELECT chip_id, v, max(v) OVER (PARTITION BY chip_id) AS hi FROM s) SELECT chip_id, round(sum(CASE WHEN hi > 100 THEN v * 1e-4 ELSE v END), 6) AS total FROM m GROUP BY chip_id")
def reflectance(spark, sf):
    c = V.chips(spark, sf).withColumn("dn", F.when(F.col("chip_id") % 2 == 0, F.transform("b08", lambda v: v * 10000)).otherwise(F.col("b08")))
    return c.select("chip_id", F.aggregate(R.reflectance(F.col("dn")), F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("P11_fixed_threshold", " SELECT chip_id, count(*) AS n FROM px WHERE b08 >= 0.55 GROUP BY chip_id")
def fixed_threshold(spark, sf):
    return _px(spark, sf).where("b08 >= 0.55").groupBy("chip_id").agg(F.count(F.lit(1)).alias("n"))


@query("P12_water_index_mask", " SELECT chip_id, count(*) AS n FROM px WHERE (b03 - b08) / (b03 + b08 + 1e-6) > 0 AND b08 >= 0.45 GROUP BY chip_id")
def water_mask(spark, sf):
    return R.water_index_mask(_px(spark, sf), 0.45).groupBy("chip_id").agg(F.count(F.lit(1)).alias("n"))


@query("P13_probability_threshold", " SELECT chip_id, count(*) FILTER (p >= 0.22) AS n_low, count(*) FILTER (p > 0.5) AS n_argmax FROM cells GROUP BY chip_id")
def probability(spark, sf):
    return _px(spark, sf).groupBy("chip_id").agg(F.count_if(F.col("p") >= 0.22).alias("n_low"), F.count_if(F.col("p") > 0.5).alias("n_argmax"))


@query("P14_shadow_merge", " SELECT chip_id, CAST(CASE WHEN cls = 2 THEN 1 ELSE cls END AS INT) AS cls, count(*) AS n FROM cells GROUP BY ALL")
def shadow_merge(spark, sf):
    return _px(spark, sf).groupBy("chip_id", R.merge_classes(F.col("cls")).alias("cls")).agg(F.count(F.lit(1)).alias("n"))


@query("P17_chip_validity", ", v AS (SELECT chip_id, avg(CAST(b08 > 0.5 AS INT)) AS bright, avg(CAST(b08 = 0 AND b03 = 0 AND b04 = 0 AS INT)) AS empty FROM px GROUP BY chip_id) SELECT chip_id, round(bright, 6) AS bright, round(empty, 6) AS empty, bright >= 0.4 AND empty <= 0.3 AS valid FROM v")
def validity(spark, sf):
    return R.validity(_px(spark, sf), 0.5, 0.4, 0.3)


@query("P18_coverage_gate", ", c AS (SELECT chip_id, avg(CAST(b08 >= 0.55 AS INT)) AS ic FROM px GROUP BY chip_id) SELECT chip_id, round(ic, 6) AS ic, ic > 0.4 AS skip_strict, ic >= 0.4 AS skip FROM c")
def coverage_gate(spark, sf):
    return R.coverage(_px(spark, sf), 0.55).select("chip_id", "ic", (F.col("ic") > 0.4).alias("skip_strict"), (F.col("ic") >= 0.4).alias("skip"))


OTSU = """, lim AS (SELECT chip_id, min(b08) AS lo, max(b08) AS hi, count(*) AS n FROM {src} GROUP BY chip_id HAVING count(*) >= {least}),
hb AS (SELECT s.chip_id, lo, hi, n, CAST(least(255, floor((b08 - lo) / (hi - lo) * 256)) AS INT) AS bin, count(*) AS c FROM {src} s JOIN lim USING (chip_id) WHERE hi > lo GROUP BY ALL),
hc AS (SELECT *, lo + (bin + 0.5) * (hi - lo) / 256 AS centre FROM hb),
hw AS (SELECT *, sum(c) OVER w AS w1, sum(c * centre) OVER w AS s1, sum(c * centre) OVER (PARTITION BY chip_id) AS s, lead(bin) OVER (PARTITION BY chip_id ORDER BY bin) AS nx FROM hc WINDOW w AS (PARTITION BY chip_id ORDER BY bin ROWS UNBOUNDED PRECEDING)),
hv AS (SELECT chip_id, centre, bin, round(w1 * (n - w1) * power(s1 / w1 - (s - s1) / (n - w1), 2), 9) AS v FROM hw WHERE nx IS NOT NULL),
ot AS (SELECT lim.chip_id, t FROM lim LEFT JOIN (SELECT chip_id, arg_max(centre, v * 1000.0 - bin / 1e9) AS t0, first(centre ORDER BY v DESC, bin) AS t FROM hv GROUP BY chip_id) USING (chip_id))"""


@query("A1_otsu", OTSU.format(src="px", least=1) + " SELECT chip_id, round(t, 6) AS threshold, CASE WHEN t IS NULL THEN 'constant' END AS reason FROM ot")
def otsu(spark, sf):
    return R.otsu(_px(spark, sf))


@query("A2_otsu_valid", ", vx AS (SELECT * FROM px WHERE b08 > 0.5)" + OTSU.format(src="vx", least=25) + " SELECT chip_id, round(t, 6) AS threshold FROM ot")
def otsu_valid(spark, sf):
    return R.otsu(_px(spark, sf).where("b08 > 0.5"), least_cells=25).drop("reason")


@query("A3_otsu_clipped", ", vx AS (SELECT * FROM cells WHERE cls = 0)" + OTSU.format(src="vx", least=1) + " SELECT chip_id, round(greatest(least(t, 0.5), 0.45), 6) AS threshold FROM ot")
def otsu_clipped(spark, sf):
    out = R.otsu(_px(spark, sf).where("cls = 0"))
    return out.select("chip_id", F.when(F.col("threshold").isNotNull(), F.greatest(F.least("threshold", F.lit(0.5)), F.lit(0.45))).alias("threshold"))


@query("P19_flat_gates", OTSU.format(src="px", least=1) + " SELECT chip_id, CASE WHEN mx - mn < 0.5 THEN 'prob_range' WHEN t IS NULL THEN 'constant' WHEN t < 0.48 THEN 'low_otsu' END AS reason FROM ot JOIN (SELECT chip_id, max(p) AS mx, min(p) AS mn FROM cells GROUP BY chip_id) USING (chip_id)")
def flat_gates(spark, sf):
    px = _px(spark, sf)
    span = px.groupBy("chip_id").agg((F.max("p") - F.min("p")).alias("span"))
    reason = F.when(F.col("span") < 0.5, "prob_range").when(F.col("threshold").isNull(), "constant").when(F.col("threshold") < 0.48, "low_otsu")
    return R.otsu(px).join(span, "chip_id").select("chip_id", reason.alias("reason"))


@query("P20_cascaded_gate", ", g AS (SELECT chip_id, count(*) AS n, avg(CAST(b08 > 0.55 AS INT)) AS ic, avg(CAST(b08 < 0.45 AS INT)) AS dark, quantile_cont(b08, 0.95) AS p95 FROM px GROUP BY chip_id) SELECT chip_id, CASE WHEN n <> 64 THEN 'bands' WHEN ic >= 0.45 THEN 'coverage' WHEN dark < 0.2 THEN 'not_dark' WHEN p95 > 0.75 THEN 'p95' ELSE 'accepted' END AS decision FROM g")
def cascade(spark, sf):
    g = _px(spark, sf).groupBy("chip_id").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("b08") > 0.55).cast("int")).alias("ic"), F.avg((F.col("b08") < 0.45).cast("int")).alias("dark"), F.percentile("b08", F.lit(0.95)).alias("p95"))
    d = F.when(F.col("n") != 64, "bands").when(F.col("ic") >= 0.45, "coverage").when(F.col("dark") < 0.2, "not_dark").when(F.col("p95") > 0.75, "p95").otherwise("accepted")
    return g.select("chip_id", d.alias("decision"))


@query("P21_train_pixel_mask", ", a AS (SELECT *, coalesce(CAST(count(*) FILTER (b08 >= 0.55 AND cls = 0) OVER (PARTITION BY chip_id) AS DOUBLE) / nullif(count(*) FILTER (cls = 0) OVER (PARTITION BY chip_id), 0), 0) AS ica FROM cells) SELECT chip_id, count(*) FILTER (chip_id % 10 < 7 AND ica >= 0.05 AND b08 >= 0.55 AND cls = 0) AS n_masked, round(sum(CASE WHEN chip_id % 10 < 7 AND ica >= 0.05 AND b08 >= 0.55 AND cls = 0 THEN 0 ELSE b08 END), 6) AS total FROM a GROUP BY chip_id")
def train_mask(spark, sf):
    px = _px(spark, sf)
    ica = px.groupBy("chip_id").agg(F.coalesce(F.try_divide(F.count_if((F.col("b08") >= 0.55) & (F.col("cls") == 0)), F.count_if(F.col("cls") == 0)), F.lit(0.0)).alias("ica"))
    hit = (F.col("chip_id") % 10 < 7) & (F.col("ica") >= 0.05) & (F.col("b08") >= 0.55) & (F.col("cls") == 0)
    return px.join(ica, "chip_id").groupBy("chip_id").agg(F.count_if(hit).alias("n_masked"), F.sum(F.when(hit, 0).otherwise(F.col("b08"))).alias("total"))


COMP = """, fg AS (SELECT chip_id AS g, pos, "row", col FROM cells WHERE {cond}),
ed AS (SELECT a.g, a.pos AS a, b.pos AS b FROM fg a JOIN fg b ON a.g = b.g AND abs(a."row" - b."row") + abs(a.col - b.col) = 1),
rc(g, pos, l) AS (SELECT g, pos, pos FROM fg UNION SELECT ed.g, ed.b, rc.l FROM rc JOIN ed ON rc.g = ed.g AND rc.pos = ed.a),
lab AS (SELECT rc.g, rc.pos, any_value("row") AS "row", any_value(col) AS col, min(l) AS l FROM rc JOIN fg ON fg.g = rc.g AND fg.pos = rc.pos GROUP BY rc.g, rc.pos)"""


def _labels(spark, sf, cond):
    fg = _px(spark, sf).where(cond).select(F.col("chip_id").alias("grid"), "row", "col")
    return O.components(fg, width=V.SIDE)


@query("A4_components", COMP.format(cond="b08 >= 0.60") + ' SELECT g AS grid, l AS label, count(*) AS px, min("row") AS row0, max("row") AS row1, min(col) AS col0, max(col) AS col1, count(*) * 100.0::DOUBLE AS area_m2, round(sqrt(count(*) * 100.0), 6) AS root_length FROM lab GROUP BY ALL')
def components(spark, sf):
    return O.sizes(_labels(spark, sf, "b08 >= 0.60"))


@query("A4_components_large_grid")
def components_large(spark, sf):
    return O.sizes(O.components(V.large_grid(spark, sf)))


@query("P15_min_object_size", COMP.format(cond="b08 >= 0.60") + " SELECT g AS grid, l AS label, count(*) AS px FROM lab GROUP BY ALL HAVING count(*) >= 2")
def min_size(spark, sf):
    return O.sizes(_labels(spark, sf, "b08 >= 0.60")).where("px >= 2").select("grid", "label", "px")


@query("P16_zero_out_small", COMP.format(cond="b08 >= 0.60") + ', n AS (SELECT *, count(*) OVER (PARTITION BY g, l) AS c FROM lab) SELECT g AS grid, "row", col, l AS label FROM n WHERE c >= 2')
def zero_small(spark, sf):
    return O.without_small(_labels(spark, sf, "b08 >= 0.60"), 2).select("grid", "row", "col", "label")


@query("A5_object_stats", COMP.format(cond="b08 >= 0.60") + ", s AS (SELECT g, l, count(*) AS c FROM lab GROUP BY ALL), t AS (SELECT chip_id, count(l) AS n_objects, max(sqrt(c * 100.0)) AS max_rl FROM (SELECT DISTINCT chip_id FROM px) LEFT JOIN s ON g = chip_id GROUP BY chip_id) SELECT chip_id, n_objects > 0 AS has_object, n_objects, round(max_rl, 6) AS max_rl, CASE WHEN max_rl < 100 THEN 'rl_40_100' WHEN max_rl < 300 THEN 'rl_100_300' WHEN max_rl IS NOT NULL THEN 'rl_300_plus' END AS size_bin FROM t")
def object_stats(spark, sf):
    s = O.sizes(_labels(spark, sf, "b08 >= 0.60")).groupBy(F.col("grid").alias("chip_id")).agg(F.count(F.lit(1)).alias("n"), F.max("root_length").alias("max_rl"))
    out = V.chips(spark, sf).select("chip_id").join(s, "chip_id", "left")
    return out.select("chip_id", F.col("n").isNotNull().alias("has_object"), F.coalesce("n", F.lit(0)).alias("n_objects"), "max_rl", F.when(F.col("max_rl").isNotNull(), O.size_bin(F.col("max_rl"))).alias("size_bin"))


CONF = """, cf AS (SELECT {by}, count(*) FILTER (cls >= 1 AND {pred}) AS tp, count(*) FILTER (cls = 0 AND {pred}) AS fp, count(*) FILTER (cls >= 1 AND NOT ({pred})) AS fn, count(*) AS n FROM cells GROUP BY {by})"""
CONF_OUT = "tp, fp, fn, n, round(CAST(tp AS DOUBLE) / nullif(tp + fp + fn, 0), 6) AS iou, round(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 6) AS precision, round(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 6) AS recall, tp + fn AS gt_pixels, tp + fp AS pred_pixels, (tp + fp) * 100.0::DOUBLE AS pred_area, (tp + fn) * 100.0::DOUBLE AS gt_area, round(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1, abs(fp - fn) * 100.0::DOUBLE AS abs_err, power((fp - fn) * 100.0::DOUBLE, 2) AS sq_err"


@query("A6_pixel_confusion", CONF.format(by="chip_id", pred="b08 >= 0.55") + f" SELECT chip_id, {CONF_OUT} FROM cf")
def confusion(spark, sf):
    return R.confusion(_px(spark, sf), F.col("cls") >= 1, F.col("b08") >= 0.55, ["chip_id"])


@query("A8_set_iou_bias", CONF.format(by="region", pred="p > 0.5") + " SELECT region, round(CAST(tp AS DOUBLE) / nullif(tp + fp + fn, 0), 6) AS iou, round(100.0 * (fp - fn) / nullif(tp + fn, 0), 6) AS bias_pct FROM cf")
def set_iou(spark, sf):
    c = R.confusion(_px(spark, sf), F.col("cls") >= 1, F.col("p") > 0.5, ["region"])
    return c.select("region", "iou", (F.try_divide(F.col("fp") - F.col("fn"), F.col("gt_pixels")) * 100).alias("bias_pct"))


@query("A7_class_iou", ", q AS (SELECT chip_id, cls, CASE WHEN b08 >= 0.61 THEN 1 WHEN b08 >= 0.55 THEN 2 ELSE 0 END AS k FROM cells), u AS (SELECT chip_id, v, count(*) FILTER (cls = v AND k = v) AS i, count(*) FILTER (cls = v OR k = v) AS u FROM q, (VALUES (0), (1), (2)) x(v) GROUP BY ALL), m AS (SELECT chip_id, avg(CAST(i AS DOUBLE) / u) FILTER (u > 0) AS miou FROM u GROUP BY chip_id), b AS (SELECT chip_id, count(*) FILTER (cls = 1) AS t, count(*) FILTER (k = 1) AS p, count(*) FILTER (cls = 1 AND k = 1) AS i FROM q GROUP BY chip_id) SELECT chip_id, round(miou, 6) AS miou, round(100.0 * (p - t) / nullif(t, 0), 6) AS bias_pct, round(2.0 * i / nullif(t + p, 0), 6) AS dice FROM m JOIN b USING (chip_id)")
def class_iou(spark, sf):
    px = _px(spark, sf).withColumn("k", F.when(F.col("b08") >= 0.61, 1).when(F.col("b08") >= 0.55, 2).otherwise(0))
    return R.class_iou(px, "cls", "k", (0, 1, 2), ["chip_id"])


def _eval(spark, sf):
    """eval_results: the confusion of every chip for two methods; chips that a method skips are missed or left out."""
    px = _px(spark, sf)
    rows = None
    for m, pred in (("TR", F.col("b08") >= 0.55), ("UNet", F.col("p") > 0.5)):
        one = R.confusion(px, F.col("cls") >= 1, pred, ["chip_id", "sza_bin", "region"]).withColumn("method", F.lit(m))
        rows = one if rows is None else rows.unionByName(one)
    return rows


EV = ", ev AS (SELECT 'TR' AS method, chip_id, sza_bin, region, count(*) FILTER (cls >= 1 AND b08 >= 0.55) AS tp, count(*) FILTER (cls = 0 AND b08 >= 0.55) AS fp, count(*) FILTER (cls >= 1 AND b08 < 0.55) AS fn FROM cells GROUP BY ALL UNION ALL SELECT 'UNet', chip_id, sza_bin, region, count(*) FILTER (cls >= 1 AND p > 0.5), count(*) FILTER (cls = 0 AND p > 0.5), count(*) FILTER (cls >= 1 AND p <= 0.5) FROM cells GROUP BY ALL), em AS (SELECT *, CAST(tp AS DOUBLE) / nullif(tp + fp + fn, 0) AS iou, CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) END AS f1, abs(fp - fn) * 100.0 AS err FROM ev)"


@query("A9_method_bin_summary", EV + " SELECT method, sza_bin, count(*) AS n_chips, round(avg(iou), 6) AS mean_iou, round(avg(f1), 6) AS mean_f1, round(avg(err), 6) AS mean_abs_err FROM em GROUP BY ALL")
def method_summary(spark, sf):
    return _eval(spark, sf).groupBy("method", "sza_bin").agg(F.count(F.lit(1)).alias("n_chips"), F.avg("iou").alias("mean_iou"), F.avg("f1").alias("mean_f1"), F.avg("abs_err").alias("mean_abs_err"))


@query("A10_summary_positive_chips", EV + " SELECT method, sza_bin, count(*) AS n_chips, round(avg(iou), 6) AS mean_iou FROM em WHERE tp + fn > 0 GROUP BY ALL")
def positive_summary(spark, sf):
    return _eval(spark, sf).where("gt_pixels > 0").groupBy("method", "sza_bin").agg(F.count(F.lit(1)).alias("n_chips"), F.avg("iou").alias("mean_iou"))


@query("A64_full_evaluation", EV + ", po AS (SELECT 'all' AS population, * FROM em UNION ALL SELECT 'positive', * FROM em WHERE tp + fn > 0) SELECT population, method, coalesce(sza_bin, 'all') AS sza_bin, coalesce(region, 'all') AS region, count(iou) AS n, round(avg(iou), 6) AS mean, round(median(iou), 6) AS median, round(quantile_cont(iou, 0.25), 6) AS p25, round(quantile_cont(iou, 0.75), 6) AS p75 FROM po GROUP BY GROUPING SETS ((population, method), (population, method, sza_bin), (population, method, region), (population, method, sza_bin, region))")
def full_evaluation(spark, sf):
    ev = _eval(spark, sf)
    both = ev.withColumn("population", F.lit("all")).unionByName(ev.where("gt_pixels > 0").withColumn("population", F.lit("positive")))
    level = lambda bin_, region: F.struct(bin_.alias("sza_bin"), region.alias("region"))
    every = F.lit("all")
    levels = F.array(level(every, every), level(F.col("sza_bin"), every), level(every, F.col("region")), level(F.col("sza_bin"), F.col("region")))
    by = ["population", "method", "sza_bin", "region"]
    rows = both.select("population", "method", "iou", F.explode(levels).alias("l")).select("population", "method", "l.sza_bin", "l.region", "iou")
    return M.with_percentiles(rows, by, "iou", {"p25": 0.25, "median": 0.5, "p75": 0.75}, [F.count("iou").alias("n"), F.avg("iou").alias("mean")])


@query("A63_model_threshold_cover", EV + " SELECT method, round(avg(iou), 6) AS mean, round(median(iou), 6) AS median, round(avg(CAST(iou > 0.5 AS INT)), 6) AS above, round(avg(CAST(iou < 0.3 AS INT)), 6) AS below, round(100.0 * sum(tp + fp) / (64 * count(*)), 6) AS pred_cover, round(100.0 * sum(tp + fn) / (64 * count(*)), 6) AS true_cover FROM em GROUP BY method")
def cover(spark, sf):
    aggs = [
        F.avg("iou").alias("mean"), F.avg((F.col("iou") > 0.5).cast("int")).alias("above"), F.avg((F.col("iou") < 0.3).cast("int")).alias("below"),
        (F.sum("pred_pixels") / F.sum("n") * 100).alias("pred_cover"), (F.sum("gt_pixels") / F.sum("n") * 100).alias("true_cover"),
    ]
    return M.with_percentiles(materialise(_eval(spark, sf)), ["method"], "iou", {"median": 0.5}, aggs)


@query("J18_skip_policy", EV + ", sk AS (SELECT *, chip_id % 7 = 0 AS skipped FROM em WHERE method = 'TR') SELECT chip_id, skipped, round(CASE WHEN skipped THEN CASE WHEN tp + fn > 0 THEN 0 END ELSE iou END, 6) AS iou_missed, round(CASE WHEN NOT skipped THEN iou END, 6) AS iou_excluded FROM sk")
def skip_policy(spark, sf):
    ev = _eval(spark, sf).where("method = 'TR'")
    skipped = V.chips(spark, sf).where("chip_id % 7 = 0").select("chip_id", F.lit(True).alias("s"))
    out = ev.join(skipped, "chip_id", "left").withColumn("skipped", F.coalesce("s", F.lit(False)))
    miss = F.when(F.col("skipped"), F.when(F.col("gt_pixels") > 0, 0.0)).otherwise(F.col("iou"))
    return out.select("chip_id", "skipped", miss.alias("iou_missed"), F.when(~F.col("skipped"), F.col("iou")).alias("iou_excluded"))


@query("J16_unannotated_bright", " SELECT chip_id, count(*) AS n FROM cells WHERE b08 >= 0.55 AND cls = 0 GROUP BY chip_id")
def unannotated(spark, sf):
    px = _px(spark, sf)
    annotated = px.where("cls > 0").select("chip_id", "row", "col")
    return px.where("b08 >= 0.55").join(annotated, ["chip_id", "row", "col"], "left_anti").groupBy("chip_id").agg(F.count(F.lit(1)).alias("n"))


@query("A24_block_coverage", ' SELECT chip_id, CAST("row" // 4 AS INT) AS brow, CAST(col // 4 AS INT) AS bcol, round(avg(CAST(b08 >= 0.55 AS INT)), 6) AS ic, count(*) AS n FROM px GROUP BY ALL')
def block_coverage(spark, sf):
    px = _px(spark, sf).withColumns({"brow": F.floor(F.col("row") / 4).cast("int"), "bcol": F.floor(F.col("col") / 4).cast("int")})
    return R.coverage(px, 0.55, ("chip_id", "brow", "bcol"))


@query("A25_usable_blocks", ', b AS (SELECT chip_id, "row" // 4 AS r, col // 4 AS c, avg(CAST(b08 >= 0.55 AS INT)) AS ic FROM px GROUP BY ALL) SELECT chip_id, round(avg(CAST(ic < 0.3 AS INT)), 6) AS usable FROM b GROUP BY chip_id')
def usable(spark, sf):
    return block_coverage(spark, sf).groupBy("chip_id").agg(F.avg((F.col("ic") < 0.3).cast("int")).alias("usable"))


@query("A26_annotation_aware_coverage", " SELECT chip_id, round(coalesce(CAST(count(*) FILTER (b08 >= 0.55 AND cls = 0) AS DOUBLE) / nullif(count(*) FILTER (cls = 0), 0), 0), 6) AS ica FROM cells GROUP BY chip_id")
def aware(spark, sf):
    return _px(spark, sf).groupBy("chip_id").agg(F.coalesce(F.try_divide(F.count_if((F.col("b08") >= 0.55) & (F.col("cls") == 0)), F.count_if(F.col("cls") == 0)), F.lit(0.0)).alias("ica"))


@query("A27_pass_fail_unknown", ", c AS (SELECT chip_id, any_value(sza_bin) AS sza_bin, any_value(source) AS source, CASE WHEN chip_id % 11 > 0 THEN avg(CAST(b08 >= 0.55 AS INT)) END AS ic FROM px GROUP BY chip_id) SELECT sza_bin, source, count(*) FILTER (ic < 0.3) AS n_pass, count(*) FILTER (ic >= 0.3) AS n_fail, count(*) FILTER (ic IS NULL) AS n_unknown FROM c GROUP BY GROUPING SETS ((sza_bin), (source))")
def pass_fail(spark, sf):
    c = _px(spark, sf).groupBy("chip_id", "sza_bin", "source").agg(F.avg((F.col("b08") >= 0.55).cast("int")).alias("v")).withColumn("ic", F.when(F.col("chip_id") % 11 > 0, F.col("v")))
    return c.groupingSets([["sza_bin"], ["source"]], "sza_bin", "source").agg(F.count_if(F.col("ic") < 0.3).alias("n_pass"), F.count_if(F.col("ic") >= 0.3).alias("n_fail"), F.count_if(F.col("ic").isNull()).alias("n_unknown"))


@query("A29_object_ocean_contrast", ", c AS (SELECT chip_id, any_value(sza_bin) AS sza_bin, avg(b08) FILTER (cls = 1) AS obj, CASE WHEN count(*) FILTER (cls = 0) > 30 THEN avg(b08) FILTER (cls = 0) END AS sea FROM cells GROUP BY chip_id) SELECT sza_bin, round(avg(obj), 6) AS obj, round(avg(sea), 6) AS sea, round(avg(obj - sea), 6) AS contrast FROM c GROUP BY sza_bin")
def contrast(spark, sf):
    c = _px(spark, sf).groupBy("chip_id", "sza_bin").agg(F.avg(F.when(F.col("cls") == 1, F.col("b08"))).alias("obj"), F.when(F.count_if(F.col("cls") == 0) > 30, F.avg(F.when(F.col("cls") == 0, F.col("b08")))).alias("sea"))
    return c.groupBy("sza_bin").agg(F.avg("obj").alias("obj"), F.avg("sea").alias("sea"), F.avg(F.col("obj") - F.col("sea")).alias("contrast"))


@query("A31_histogram", ", h AS (SELECT sza_bin, CAST(least(floor((b08 - 0.25) / 0.05), 9) AS INT) AS bin, count(*) AS n FROM px WHERE b08 BETWEEN 0.25 AND 0.75 GROUP BY ALL) SELECT sza_bin, bin, n, round(n / (sum(n) OVER (PARTITION BY sza_bin) * 0.05), 6) AS density FROM h")
def histogram(spark, sf):
    return R.histogram(_px(spark, sf), F.col("b08"), 0.25, 0.75, 10, ["sza_bin"])


@query("A33_band_moments", " SELECT round(avg(b08), 6) AS mean, round(greatest(stddev_pop(b08), CASE WHEN stddev_pop(b08) < 1e-6 THEN 1 ELSE 0 END), 6) AS std FROM px")
def moments(spark, sf):
    std = F.stddev_pop("b08")
    return _px(spark, sf).agg(F.avg("b08").alias("mean"), F.when(std < 1e-6, 1.0).otherwise(std).alias("std"))


@query("A34_class_weights", ", c AS (SELECT cls, count(*) AS n FROM cells GROUP BY cls) SELECT CAST(cls AS INT) AS cls, round((1.0 / n) / sum(1.0 / n) OVER (), 6) AS weight, round(CAST(n AS DOUBLE) / sum(n) OVER (), 6) AS share FROM c")
def class_weights(spark, sf):
    c = _px(spark, sf).groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum(1 / F.col("n")).alias("inv"), F.sum("n").alias("all"))
    return c.join(F.broadcast(total)).select("cls", (1 / F.col("n") / F.col("inv")).alias("weight"), (F.col("n") / F.col("all")).alias("share"))


@query("A36_label_value_counts", " SELECT chip_id, CAST(cls AS INT) AS cls, count(*) AS n FROM cells GROUP BY ALL")
def value_counts(spark, sf):
    return _px(spark, sf).groupBy("chip_id", "cls").agg(F.count(F.lit(1)).alias("n"))


@query("A41_adaptive_bin_threshold", ", g AS (SELECT avg(b08) AS t FROM cells WHERE cls = 1), b AS (SELECT sza_bin, avg(b08) AS t FROM cells WHERE cls = 1 AND sza_bin <> 'sza_gt75' GROUP BY sza_bin) SELECT x.sza_bin, round(coalesce(b.t, g.t), 6) AS threshold, count(*) AS n FROM px x LEFT JOIN b USING (sza_bin), g WHERE x.b08 >= coalesce(b.t, g.t) GROUP BY ALL")
def adaptive(spark, sf):
    px = _px(spark, sf)
    one = px.where("cls = 1")
    t = one.where("sza_bin <> 'sza_gt75'").groupBy("sza_bin").agg(F.avg("b08").alias("t"))
    out = px.join(F.broadcast(t), "sza_bin", "left").join(F.broadcast(one.agg(F.avg("b08").alias("g")))).withColumn("threshold", F.coalesce("t", "g"))
    return out.where("b08 >= threshold").groupBy("sza_bin", "threshold").agg(F.count(F.lit(1)).alias("n"))


@query("A42_percentile_stretch", ", q AS (SELECT chip_id, quantile_cont(b08, 0.02) AS lo, quantile_cont(b08, 0.98) AS hi FROM px GROUP BY chip_id) SELECT chip_id, \"row\", col, round(least(1, greatest(0, (b08 - lo) / nullif(hi - lo, 0))), 6) AS stretched FROM px JOIN q USING (chip_id)")
def stretch(spark, sf):
    return R.stretch(_px(spark, sf).select("chip_id", "row", "col", "b08")).select("chip_id", "row", "col", "stretched")


@query("A50_threshold_sweep", ", t(t) AS (VALUES (0.50), (0.53), (0.56), (0.59), (0.62)), s AS (SELECT t, CAST(count(*) FILTER (cls = 1 AND b08 >= t) AS DOUBLE) / count(*) FILTER (cls = 1 OR b08 >= t) AS iou FROM cells, t GROUP BY t) SELECT CAST(t AS DOUBLE) AS t, round(iou, 6) AS iou, round(iou - (SELECT iou FROM s WHERE t = 0.56), 6) AS delta FROM s")
def sweep(spark, sf):
    px = _px(spark, sf).select("cls", "b08", F.explode(F.array(*map(F.lit, (0.50, 0.53, 0.56, 0.59, 0.62)))).alias("t"))
    s = px.groupBy("t").agg((F.count_if((F.col("cls") == 1) & (F.col("b08") >= F.col("t"))) / F.count_if((F.col("cls") == 1) | (F.col("b08") >= F.col("t")))).alias("iou"))
    base = s.where("t = 0.56").select(F.col("iou").alias("base"))
    return s.join(F.broadcast(base)).select("t", "iou", (F.col("iou") - F.col("base")).alias("delta"))


@query("A58_probability_calibration", ", c AS (SELECT chip_id, median(p) AS med, avg(CAST(p BETWEEN 0.2 AND 0.35 AS INT)) AS low, avg(CAST(p >= 0.5 AS INT)) AS high FROM cells GROUP BY chip_id) SELECT round(median(med), 6) AS med, round(median(low), 6) AS low, round(median(high), 6) AS high FROM c")
def calibration(spark, sf):
    c = _px(spark, sf).groupBy("chip_id").agg(F.median("p").alias("med"), F.avg(F.col("p").between(0.2, 0.35).cast("int")).alias("low"), F.avg((F.col("p") >= 0.5).cast("int")).alias("high"))
    c = materialise(c)
    med, low, high = (M.with_percentiles(c, [], k, {k: 0.5}, [F.count(F.lit(1)).alias(f"n_{k}")]).select(k) for k in ("med", "low", "high"))
    return med.join(F.broadcast(low)).join(F.broadcast(high))


@query("R1_tiles", ", t AS (SELECT chip_id AS grid, \"row\" // 3 * 3 AS row0, col // 3 * 3 AS col0, count(*) AS n, avg(b08) AS m, max(b08) AS x FROM px GROUP BY ALL HAVING count(*) = 9) SELECT grid, CAST(row0 AS INT) AS row0, CAST(col0 AS INT) AS col0, n, round(m, 6) AS mean, round(x, 6) AS most, printf('r%04d_c%04d', CAST(row0 AS INT), CAST(col0 AS INT)) AS name FROM t")
def tiles(spark, sf):
    return R.tiles(_px(spark, sf).select(F.col("chip_id").alias("grid"), "row", "col", F.col("b08").alias("value")), 3)


@query("R2_clip_to_box", ' SELECT chip_id, count(*) FILTER (v > 0) AS n, round(sum(v), 6) AS total FROM (SELECT chip_id, CASE WHEN "row" BETWEEN 1 AND 5 AND col BETWEEN 2 AND 6 THEN b08 ELSE 0 END AS v FROM px) GROUP BY chip_id')
def clip_box(spark, sf):
    v = F.when(F.col("row").between(1, 5) & F.col("col").between(2, 6), F.col("b08")).otherwise(0.0)
    return _px(spark, sf).withColumn("v", v).groupBy("chip_id").agg(F.count_if(F.col("v") > 0).alias("n"), F.sum("v").alias("total"))


@query("R3_cross_dilation", ', m AS (SELECT chip_id AS grid, "row" AS r, col AS c FROM cells WHERE cls = 1) SELECT DISTINCT grid, CAST(r + dr AS INT) AS "row", CAST(c + dc AS INT) AS col FROM m, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) v(dr, dc) WHERE r + dr BETWEEN 0 AND 7 AND c + dc BETWEEN 0 AND 7')
def dilation(spark, sf):
    return R.dilate_cross(_px(spark, sf).where("cls = 1").select(F.col("chip_id").alias("grid"), "row", "col"), 8, 8)


@query("R4_belt", ', m AS (SELECT chip_id AS grid, "row" AS r, col AS c FROM cells WHERE cls = 1) SELECT x.chip_id AS grid, x."row", x.col FROM cells x WHERE cls <> 1 AND EXISTS (SELECT 1 FROM m WHERE m.grid = x.chip_id AND abs(m.r - x."row") <= 2 AND abs(m.c - x.col) <= 2)')
def belt(spark, sf):
    return R.belt(_px(spark, sf).where("cls = 1").select(F.col("chip_id").alias("grid"), "row", "col"), 2, 8, 8)


@query("R9_flips", ', v AS (SELECT chip_id AS grid, b08, unnest([{v: 0, r: "row", c: col}, {v: 1, r: "row", c: 7 - col}, {v: 2, r: 7 - "row", c: col}, {v: 3, r: 7 - "row", c: 7 - col}, {v: 4, r: col, c: "row"}, {v: 5, r: col, c: 7 - "row"}, {v: 6, r: 7 - col, c: "row"}, {v: 7, r: 7 - col, c: 7 - "row"}]) AS w FROM px) SELECT grid, CAST(w.v AS INT) AS variant, round(sum(b08 * (w.r * 8 + w.c)), 6) AS moment FROM v GROUP BY ALL')
def flips(spark, sf):
    t = R.turned(_px(spark, sf).select(F.col("chip_id").alias("grid"), "row", "col", "b08"), 8)
    return t.groupBy("grid", "variant").agg(F.sum(F.col("b08") * (F.col("row") * 8 + F.col("col"))).alias("moment"))


@query("R6_missed_objects", COMP.format(cond="b08 >= 0.55 AND cls = 0") + ", s AS (SELECT g AS grid, l AS label, count(*) AS px FROM lab GROUP BY ALL) SELECT grid, label, px FROM s WHERE px BETWEEN 2 AND 20")
def missed(spark, sf):
    return O.sizes(_labels(spark, sf, "b08 >= 0.55 and cls = 0")).where("px between 2 and 20").select("grid", "label", "px")


@query("A51_missed_summary", COMP.format(cond="b08 >= 0.55 AND cls = 0") + ", s AS (SELECT g AS grid, l, count(*) AS px FROM lab GROUP BY ALL) SELECT grid, count(*) AS n_missed, string_agg(CAST(px AS VARCHAR), ',' ORDER BY px) AS areas FROM s WHERE px >= 2 GROUP BY grid")
def missed_summary(spark, sf):
    s = O.sizes(_labels(spark, sf, "b08 >= 0.55 and cls = 0")).where("px >= 2")
    return s.groupBy("grid").agg(F.count(F.lit(1)).alias("n_missed"), F.array_join(F.transform(F.array_sort(F.collect_list("px")), lambda x: x.cast("string")), ",").alias("areas"))


#: The components of a second mask under names of their own: gtl.
FIRST = COMP
for old, new in (("fg AS", "fg1 AS"), ("FROM fg ", "FROM fg1 "), ("JOIN fg ", "JOIN fg1 "), ("fg.", "fg1."), ("ed AS", "ed1 AS"), ("JOIN ed ", "JOIN ed1 "), ("ed.", "ed1."), ("rc(", "rc1("), ("FROM rc ", "FROM rc1 "), ("rc.", "rc1."), ("lab AS", "gtl AS")):
    FIRST = FIRST.replace(old, new)
TWO = FIRST.format(cond="cls = 1") + COMP.format(cond="p > 0.5")
OVER = TWO + ", ov AS (SELECT a.g, a.l AS gt, b.l AS pred, count(*) AS shared FROM gtl a JOIN lab b ON a.g = b.g AND a.pos = b.pos GROUP BY ALL), ga AS (SELECT g, l AS gt, count(*) AS gt_px FROM gtl GROUP BY ALL), pa AS (SELECT g, l AS pred, count(*) AS pred_px FROM lab GROUP BY ALL), iou AS (SELECT g AS grid, gt, pred, shared, gt_px, pred_px, CAST(shared AS DOUBLE) / (gt_px + pred_px - shared) AS iou FROM ov JOIN ga USING (g, gt) JOIN pa USING (g, pred))"


#: The best one-to-one pairs of each grid in SQL: the best total for every set of predictions that the references so far may take. A total is
#: a whole number: IoU to 1e-12, then the sum of predictions, then that of the mixes, each below 10 ** 9 here.
BEST = OVER + """, rf AS (SELECT grid, gt, row_number() OVER (PARTITION BY grid ORDER BY gt) AS rn FROM iou GROUP BY grid, gt),
 op AS (SELECT rf.grid, rn, gt, CAST(pred AS BIGINT) AS pred, iou, CAST(round(iou * 1e12) AS HUGEINT) * CAST(1000000000000000000 AS HUGEINT) - CAST(pred AS HUGEINT) * 1000000000 - (gt * 7919 + pred * 104729) % 1000003 AS w FROM rf JOIN iou USING (grid, gt) UNION ALL SELECT grid, rn, gt, NULL, 0, CAST(0 AS HUGEINT) FROM rf),
 mt(grid, k, used, total, picks) AS (SELECT DISTINCT grid, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(0 AS HUGEINT), CAST([] AS STRUCT(gt BIGINT, pred BIGINT, iou DOUBLE)[]) FROM rf
 UNION ALL SELECT grid, k, used, max(total), arg_max(picks, total) FROM (SELECT mt.grid, mt.k + 1 AS k, CASE WHEN pred IS NULL THEN used ELSE list_sort(list_append(used, pred)) END AS used, total + w AS total, CASE WHEN pred IS NULL THEN picks ELSE list_append(picks, {'gt': CAST(op.gt AS BIGINT), 'pred': pred, 'iou': iou}) END AS picks FROM mt JOIN op ON op.grid = mt.grid AND op.rn = mt.k + 1 WHERE pred IS NULL OR NOT list_contains(used, pred)) GROUP BY grid, k, used),
 fin AS (SELECT mt.grid, arg_max(picks, total) AS picks FROM mt JOIN (SELECT grid, max(rn) AS n FROM rf GROUP BY grid) z ON z.grid = mt.grid AND z.n = mt.k GROUP BY mt.grid),
 best AS (SELECT * FROM (SELECT grid, unnest(picks, recursive := true) FROM fin) WHERE iou >= 0.3)"""
KEPT = ", kept AS (SELECT * FROM best WHERE (grid, gt) NOT IN (SELECT (grid, gt) FROM iou WHERE iou >= 0.1 GROUP BY grid, gt HAVING count(*) >= 2))"
DETECTED = ", gd AS (SELECT DISTINCT chip_id AS grid, sza_bin FROM px), cg AS (SELECT g AS grid, count(DISTINCT l) AS n FROM gtl GROUP BY g), cp AS (SELECT g AS grid, count(DISTINCT l) AS n FROM lab GROUP BY g), cm AS (SELECT grid, count(*) AS n FROM best GROUP BY grid), dt AS (SELECT grid, sza_bin, coalesce(cg.n, 0) AS n_gt, coalesce(cp.n, 0) AS n_pred, coalesce(cm.n, 0) AS n_matched FROM gd LEFT JOIN cg USING (grid) LEFT JOIN cp USING (grid) LEFT JOIN cm USING (grid))"
GREEDY = """, rf AS (SELECT grid, gt, row_number() OVER (PARTITION BY grid ORDER BY max(iou) DESC, gt) AS rn FROM iou WHERE iou > 0.3 GROUP BY grid, gt),
 gr(grid, k, used, gt, pred, iou) AS (SELECT DISTINCT grid, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE) FROM rf
 UNION ALL SELECT grid, k, CASE WHEN b IS NULL THEN used ELSE list_append(used, b.pred) END, gt, b.pred, b.iou FROM (SELECT gr.grid, gr.k + 1 AS k, any_value(gr.used) AS used, rf.gt, arg_min({'pred': CAST(i.pred AS BIGINT), 'iou': i.iou}, (-i.iou, i.pred)) FILTER (NOT list_contains(gr.used, i.pred)) AS b FROM gr JOIN rf ON rf.grid = gr.grid AND rf.rn = gr.k + 1 JOIN iou i ON i.grid = rf.grid AND i.gt = rf.gt AND i.iou > 0.3 GROUP BY gr.grid, gr.k, rf.gt))
 SELECT grid, gt, pred, round(iou, 6) AS iou FROM gr WHERE pred IS NOT NULL"""


def _both(spark, sf):
    """Labelled cells of references and of predictions, each labelled once."""
    return materialise(_labels(spark, sf, "cls = 1")), materialise(_labels(spark, sf, "p > 0.5"))


def _pairs(spark, sf):
    return materialise(O.overlaps(*_both(spark, sf)))


@query("J5_object_overlap", OVER + " SELECT grid, gt, pred, shared, gt_px, pred_px, round(iou, 6) AS iou FROM iou")
def overlap(spark, sf):
    return _pairs(spark, sf)


@query("J7_optimal_matching", BEST + " SELECT grid, gt, pred, round(iou, 6) AS iou FROM best")
def optimal(spark, sf):
    return O.match_optimal(_pairs(spark, sf))


@query("J9_greedy_matching", OVER + GREEDY)
def greedy(spark, sf):
    return O.match_greedy(_pairs(spark, sf))


@query("J8_ambiguous_references", OVER + " SELECT grid, gt, count(*) AS n, string_agg(CAST(pred AS VARCHAR), ',' ORDER BY pred) AS preds FROM iou WHERE iou >= 0.1 GROUP BY ALL HAVING count(*) >= 2")
def ambiguous(spark, sf):
    return O.ambiguous(_pairs(spark, sf)).withColumn("preds", F.array_join(F.transform("preds", lambda x: x.cast("string")), ","))


@query("J8_ambiguous_removed", BEST + KEPT + " SELECT grid, gt, pred, round(iou, 6) AS iou FROM kept")
def ambiguous_removed(spark, sf):
    pairs = _pairs(spark, sf)
    return O.without_ambiguous(O.match_optimal(pairs), pairs)


def _detected(spark, sf):
    """Detection rows of all chips, and their matched pairs with and without ambiguous references."""
    gt, pred = _both(spark, sf)
    pairs = materialise(O.overlaps(gt, pred))
    matched = materialise(O.match_optimal(pairs))
    grids = V.chips(spark, sf).select(F.col("chip_id").alias("grid"))
    return O.detection(O.sizes(gt), O.sizes(pred), matched, grids), matched, O.without_ambiguous(matched, pairs)


@query("A13_chip_detection", BEST + DETECTED + " SELECT grid, n_gt, n_pred, n_matched, greatest(0, n_gt - n_matched) AS n_fn, greatest(0, n_pred - n_matched) AS n_fp, CASE WHEN n_gt = 0 AND n_pred = 0 THEN 'both_null' WHEN n_gt = 0 THEN 'gt_null' WHEN n_pred = 0 THEN 'pred_null' END AS note FROM dt")
def detection(spark, sf):
    return _detected(spark, sf)[0]


@query("A14_detection_stats", BEST + KEPT + DETECTED + ", s AS (SELECT sza_bin, sum(n_gt)::BIGINT AS n_ref, sum(n_pred)::BIGINT AS n_pred, sum(n_matched)::BIGINT AS n_matched FROM dt GROUP BY sza_bin), b AS (SELECT sza_bin, sum(iou) AS iou FROM best JOIN gd USING (grid) GROUP BY sza_bin), k AS (SELECT sza_bin, count(*) AS n_kept, sum(iou) AS iou_kept FROM kept JOIN gd USING (grid) GROUP BY sza_bin) SELECT sza_bin, n_ref, n_pred, n_matched, round(coalesce(n_matched / nullif(CAST(n_ref AS DOUBLE), 0), 0), 6) AS match_rate, round(coalesce(n_matched / nullif(CAST(n_pred AS DOUBLE), 0), 0), 6) AS precision, round(coalesce(iou / nullif(n_matched, 0), 0), 6) AS mean_iou, coalesce(n_kept, 0) AS n_kept, round(coalesce(n_kept, 0) / nullif(CAST(n_ref AS DOUBLE), 0), 6) AS kept_match_rate, round(coalesce(n_kept, 0) / nullif(CAST(n_pred AS DOUBLE), 0), 6) AS kept_precision, round(iou_kept / nullif(n_kept, 0), 6) AS kept_mean_iou FROM s LEFT JOIN b USING (sza_bin) LEFT JOIN k USING (sza_bin)")
def detection_stats(spark, sf):
    """Both forms: all matched pairs with 0 for rates without objects, and those without ambiguous references with NULL."""
    d, matched, kept = _detected(spark, sf)
    iou = lambda df, name: df.groupBy("grid").agg(F.sum("iou").alias(f"iou_{name}"), F.count(F.lit(1)).alias(f"k_{name}"))
    d = d.join(iou(matched, "all"), "grid", "left").join(iou(kept, "kept"), "grid", "left")
    d = d.join(V.chips(spark, sf).select(F.col("chip_id").alias("grid"), "sza_bin"), "grid")
    out = d.groupBy("sza_bin").agg(
        F.sum("n_gt").alias("n_ref"), F.sum("n_pred").alias("n_pred"), F.sum("n_matched").alias("n_matched"), F.sum("iou_all").alias("iou"),
        F.coalesce(F.sum("k_kept"), F.lit(0)).alias("n_kept"), F.sum("iou_kept").alias("iou_kept"),
    )
    rate = lambda a, b: F.try_divide(a, b)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(
        "sza_bin", "n_ref", "n_pred", "n_matched", zero(rate("n_matched", "n_ref")).alias("match_rate"), zero(rate("n_matched", "n_pred")).alias("precision"), zero(rate("iou", "n_matched")).alias("mean_iou"),
        "n_kept", rate("n_kept", "n_ref").alias("kept_match_rate"), rate("n_kept", "n_pred").alias("kept_precision"), rate("iou_kept", "n_kept").alias("kept_mean_iou"),
    )


@query("A15_area_summary", OTSU.format(src="px", least=1) + COMP.format(cond="b08 >= (SELECT t FROM ot WHERE ot.chip_id = cells.chip_id) AND chip_id IN (SELECT chip_id FROM px GROUP BY chip_id HAVING avg(CAST(b08 >= 0.55 AS INT)) <= 0.4)") + ", s AS (SELECT g, l, count(*) * 100.0::DOUBLE AS a FROM lab GROUP BY ALL HAVING count(*) >= 2), t AS (SELECT sza_bin, region, a FROM s JOIN (SELECT DISTINCT chip_id, sza_bin, region FROM px) ON g = chip_id) SELECT sza_bin, region, count(*) AS n, round(avg(a), 6) AS mean, round(median(a), 6) AS median, round(sum(a), 6) AS total, round(quantile_cont(a, 0.25), 6) AS p25, round(quantile_cont(a, 0.75), 6) AS p75 FROM t GROUP BY ALL")
def area_summary(spark, sf):
    """Chips to Otsu masks, coverage gate, objects, size cut and areas by bin and region."""
    px = _px(spark, sf)
    keep = R.coverage(px, 0.55).where("ic <= 0.4").select("chip_id")
    fg = px.join(keep, "chip_id", "left_semi").join(R.otsu(px), "chip_id").where("b08 >= threshold").select(F.col("chip_id").alias("grid"), "row", "col")
    s = O.sizes(O.components(fg, width=V.SIDE)).where("px >= 2").join(V.chips(spark, sf).select(F.col("chip_id").alias("grid"), "sza_bin", "region"), "grid")
    aggs = [F.count(F.lit(1)).alias("n"), F.avg("area_m2").alias("mean"), F.sum("area_m2").alias("total")]
    return M.with_percentiles(materialise(s.select("sza_bin", "region", "area_m2")), ["sza_bin", "region"], "area_m2", {"median": 0.5, "p25": 0.25, "p75": 0.75}, aggs)
