"""Summaries with all their columns: evaluation, description, weather, weights, labelling totals, audits, and pivots beside each other."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import names as N
from ..operators import objects as O
from ..operators import raster as R
from ..sources import views as V
from ..sources.scratch import materialise
from .common import INVENTORY, PAIRS, PX, rounded
from .pairs import MET, _pairs
from .raster import COMP, _labels
from .records import EXP, NAMES, SUBS, WX, _acquired, _checked, _decisions, _scenes, _weather

Q, SQL = {}, {}


def query(name: str, sql: str, views: str):
    def put(f):
        Q[name] = lambda spark, sf: rounded(f(spark, sf))
        SQL[name] = "WITH RECURSIVE " + views.strip() + sql
        return f

    return put


#: Confusion of two methods, of which the first one predicts nothing on the chips that it skips.
EVAL = ", ev AS (SELECT m, chip_id, sza_bin, m = 'TR' AND chip_id % 7 = 0 AS skipped, count(*) FILTER (cls >= 1 AND hit) AS tp, count(*) FILTER (cls = 0 AND hit) AS fp, count(*) FILTER (cls >= 1 AND NOT hit) AS fn FROM (SELECT 'TR' AS m, *, b08 >= 0.55 AND chip_id % 7 > 0 AS hit FROM cells UNION ALL SELECT 'UNet', *, p > 0.5 FROM cells) GROUP BY ALL), em AS (SELECT *, CAST(tp AS DOUBLE) / nullif(tp + fp + fn, 0) AS iou, CAST(tp AS DOUBLE) / nullif(tp + fp, 0) AS pr, CAST(tp AS DOUBLE) / nullif(tp + fn, 0) AS re, CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) END AS f1, 2.0 * tp / nullif(2 * tp + fp + fn, 0) AS dice, (fp - fn) * 100.0 AS err FROM ev)"


def _evaluated(spark, sf):
    px = V.cells(spark, sf)
    parts = [R.confusion(px, F.col("cls") >= 1, hit, ["chip_id", "sza_bin"]).withColumns({"method": F.lit(m), "skipped": s}) for m, hit, s in (("TR", (F.col("b08") >= 0.55) & (F.col("chip_id") % 7 > 0), F.col("chip_id") % 7 == 0), ("UNet", F.col("p") > 0.5, F.lit(False)))]
    return parts[0].unionByName(parts[1]).withColumn("dice", F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


@query("A9_summary_with_skips", EVAL + " SELECT m AS method, sza_bin, count(*) AS n_chips, count(*) FILTER (skipped) AS n_skipped, round(avg(iou), 6) AS mean_iou, round(avg(pr), 6) AS mean_precision, round(avg(re), 6) AS mean_recall, round(avg(f1), 6) AS mean_f1, round(avg(abs(err)), 6) AS mae_area, round(avg(err * err), 4) AS mse_area FROM em GROUP BY ALL", PX)
def summary_with_skips(spark, sf):
    """Skipped chips count as false negatives: they have no prediction."""
    mean = {"iou": "mean_iou", "precision": "mean_precision", "recall": "mean_recall", "f1": "mean_f1", "abs_err": "mae_area"}
    return _evaluated(spark, sf).groupBy("method", "sza_bin").agg(F.count(F.lit(1)).alias("n_chips"), F.count_if("skipped").alias("n_skipped"), *[F.avg(k).alias(v) for k, v in mean.items()], F.round(F.avg("sq_err"), 4).alias("mse_area"))


@query("A63_chip_cover", EVAL + " SELECT a.chip_id, round(a.iou, 6) AS iou, round(a.dice, 6) AS dice, round(100.0 * (a.tp + a.fp) / 64, 6) AS pred_pct, round(100.0 * (a.tp + a.fn) / 64, 6) AS gt_pct, round(b.iou, 6) AS thresh_iou, round(b.dice, 6) AS thresh_dice, round(100.0 * (b.tp + b.fp) / 64, 6) AS thresh_pct FROM em a JOIN em b USING (chip_id) WHERE a.m = 'UNet' AND b.m = 'TR'", PX)
def chip_cover(spark, sf):
    """The model and the threshold side by side, for every chip."""
    e = _evaluated(spark, sf).withColumns({"pred_pct": F.col("pred_pixels") / F.col("n") * 100, "gt_pct": F.col("gt_pixels") / F.col("n") * 100})
    a = e.where("method = 'UNet'").select("chip_id", "iou", "dice", "pred_pct", "gt_pct")
    return a.join(e.where("method = 'TR'").select("chip_id", F.col("iou").alias("thresh_iou"), F.col("dice").alias("thresh_dice"), F.col("pred_pct").alias("thresh_pct")), "chip_id")


@query("A63_set_summary", EVAL + " SELECT m AS method, round(avg(iou), 6) AS mean_iou, round(median(iou), 6) AS median_iou, round(avg(dice), 6) AS mean_dice, round(avg(CAST(iou > 0.5 AS INT)), 6) AS above, round(avg(CAST(iou < 0.3 AS INT)), 6) AS below, round(100.0 * (sum(tp + fp) - sum(tp + fn)) / nullif(sum(tp + fn), 0), 6) AS bias_pct FROM em GROUP BY m", PX)
def set_summary(spark, sf):
    aggs = [F.avg("iou").alias("mean_iou"), F.avg("dice").alias("mean_dice"), F.avg((F.col("iou") > 0.5).cast("int")).alias("above"), F.avg((F.col("iou") < 0.3).cast("int")).alias("below"),
            (F.try_divide(F.sum("pred_pixels") - F.sum("gt_pixels"), F.sum("gt_pixels")) * 100).alias("bias_pct")]
    return M.with_percentiles(materialise(_evaluated(spark, sf)), ["method"], "iou", {"median_iou": 0.5}, aggs)


#: Mean brightness of objects and of dark water (more than 30 cells of it) of each chip with objects.
BRIGHT = ", br AS (SELECT chip_id, any_value(sza_bin) AS sza_bin, avg(b08) FILTER (cls = 1) AS obj, CASE WHEN count(*) FILTER (cls = 0 AND b08 < 0.55) > 30 THEN avg(b08) FILTER (cls = 0 AND b08 < 0.55) END AS sea FROM cells GROUP BY chip_id HAVING count(*) FILTER (cls = 1) > 0)"


def _bright(spark, sf):
    sea = (F.col("cls") == 0) & (F.col("b08") < 0.55)
    c = V.cells(spark, sf).groupBy("chip_id", "sza_bin").agg(F.avg(F.when(F.col("cls") == 1, F.col("b08"))).alias("obj"), F.when(F.count_if(sea) > 30, F.avg(F.when(sea, F.col("b08")))).alias("sea"))
    return c.where("obj is not null")


@query("A29_contrast_share", BRIGHT + " SELECT sza_bin, count(*) AS n_chips, round(avg(obj), 6) AS obj, round(avg(sea), 6) AS sea, round(avg(obj - sea), 6) AS contrast, round(100.0 * avg(CAST(obj < 0.65 AS INT)), 6) AS dim_pct FROM br GROUP BY sza_bin", PX)
def contrast_share(spark, sf):
    """Means over chips, and the percentage of chips whose objects are dimmer than a mark."""
    return _bright(spark, sf).groupBy("sza_bin").agg(F.count(F.lit(1)).alias("n_chips"), F.avg("obj").alias("obj"), F.avg("sea").alias("sea"), F.avg(F.col("obj") - F.col("sea")).alias("contrast"), (F.avg((F.col("obj") < 0.65).cast("int")) * 100).alias("dim_pct"))


@query("A21_full_table", COMP.format(cond="b08 >= 0.60") + BRIGHT + """, ob AS (SELECT g AS chip_id, l, count(*) * CAST(100 AS DOUBLE) AS area FROM lab GROUP BY ALL), ch AS (SELECT px.chip_id, any_value(sza_bin) AS b, (SELECT count(*) FROM ob WHERE ob.chip_id = px.chip_id) AS n FROM px GROUP BY px.chip_id),
t AS (SELECT unnest([b, 'all']) AS sza_bin, n FROM ch), c AS (SELECT sza_bin, count(*) AS n_chips, count(*) FILTER (n = 0) AS n_null, count(*) FILTER (n >= 1) AS n_ge1, count(*) FILTER (n >= 5) AS n_ge5 FROM t GROUP BY sza_bin),
u AS (SELECT unnest([b, 'all']) AS sza_bin, area FROM ob JOIN ch USING (chip_id)), a AS (SELECT sza_bin, count(*) AS n_objects, round(avg(area), 4) AS mean_area, round(median(area), 4) AS median_area, max(area) AS max_area, round(avg(sqrt(area)), 6) AS mean_rl, round(median(sqrt(area)), 6) AS median_rl FROM u GROUP BY sza_bin),
v AS (SELECT unnest([sza_bin, 'all']) AS sza_bin, obj, sea FROM br), r AS (SELECT sza_bin, round(avg(obj), 6) AS obj, round(avg(sea), 6) AS sea, round(avg(obj - sea), 6) AS contrast FROM v GROUP BY sza_bin)
SELECT * FROM c LEFT JOIN a USING (sza_bin) LEFT JOIN r USING (sza_bin)""", PX)  # fmt: skip
def full_table(spark, sf):
    """Counts, areas, root lengths and brightness of each bin and of all chips."""
    both = lambda d: d.withColumn("sza_bin", F.explode(F.array("sza_bin", F.lit("all"))))
    o = materialise(O.sizes(_labels(spark, sf, "b08 >= 0.60")).select(F.col("grid").alias("chip_id"), "area_m2", "root_length"))
    chips = V.chips(spark, sf).select("chip_id", "sza_bin")
    n = both(chips.join(o.groupBy("chip_id").agg(F.count(F.lit(1)).alias("n")), "chip_id", "left").withColumn("n", F.coalesce("n", F.lit(0))))
    n = n.groupBy("sza_bin").agg(F.count(F.lit(1)).alias("n_chips"), F.count_if(F.col("n") == 0).alias("n_null"), F.count_if(F.col("n") >= 1).alias("n_ge1"), F.count_if(F.col("n") >= 5).alias("n_ge5"))
    own = materialise(both(o.join(chips, "chip_id")))
    a = M.with_percentiles(own, ["sza_bin"], "area_m2", {"median_area": 0.5}, [F.count(F.lit(1)).alias("n_objects"), F.round(F.avg("area_m2"), 4).alias("mean_area"), F.max("area_m2").alias("max_area"), F.avg("root_length").alias("mean_rl")])
    rl = M.with_percentiles(own, ["sza_bin"], "root_length", {"median_rl": 0.5}, [F.lit(1).alias("_")]).drop("_")
    b = both(_bright(spark, sf)).groupBy("sza_bin").agg(F.avg("obj").alias("obj"), F.avg("sea").alias("sea"), F.avg(F.col("obj") - F.col("sea")).alias("contrast"))
    return n.join(a, "sza_bin", "left").join(rl, "sza_bin", "left").join(b, "sza_bin", "left")


@query("A28_weather_distribution", ", w AS (SELECT unnest([CAST(aq.region AS VARCHAR), 'all']) AS region, wind, temp FROM aq LEFT JOIN wx ON wx.region = aq.region AND wx.h = aq.tm) SELECT region, count(*) AS n, count(wind) AS has_met, round(avg(wind), 6) AS mean_wind, round(median(wind), 6) AS median_wind, round(max(wind), 6) AS max_wind, count(*) FILTER (wind > 15) AS n_windy, round(100.0 * count(*) FILTER (wind > 15) / nullif(count(wind), 0), 6) AS windy_pct, round(avg(temp), 6) AS mean_temp, round(median(temp), 6) AS median_temp, round(max(temp), 6) AS max_temp, count(*) FILTER (temp > 0) AS n_warm, count(*) FILTER (wind > 15 OR temp <= 0) AS fail_either, count(*) FILTER (wind > 15 AND temp <= 0) AS fail_both FROM w GROUP BY region", WX)
def weather_distribution(spark, sf):
    w = _acquired(spark, sf).join(_weather(spark, sf).withColumnRenamed("h", "at"), ["region", "at"], "left")
    w = materialise(w.select(F.explode(F.array(F.col("region").cast("string"), F.lit("all"))).alias("region"), "wind", "temp"))
    windy, cold = F.col("wind") > 15, F.col("temp") <= 0
    aggs = [F.count(F.lit(1)).alias("n"), F.count("wind").alias("has_met"), F.avg("wind").alias("mean_wind"), F.max("wind").alias("max_wind"), F.count_if(windy).alias("n_windy"), (F.try_divide(F.count_if(windy), F.count("wind")) * 100).alias("windy_pct"),
            F.avg("temp").alias("mean_temp"), F.max("temp").alias("max_temp"), F.count_if(F.col("temp") > 0).alias("n_warm"), F.count_if(windy | cold).alias("fail_either"), F.count_if(windy & cold).alias("fail_both")]
    out = M.with_percentiles(w, ["region"], "wind", {"median_wind": 0.5}, aggs)
    return out.join(M.with_percentiles(w, ["region"], "temp", {"median_temp": 0.5}, [F.lit(1).alias("_")]).drop("_"), "region")


#: Bin of a scene by the month's rough angle, in SQL.
MONTH_BIN = ", mb AS (SELECT *, MAP {3: 75, 4: 67, 5: 60, 6: 57, 7: 58, 8: 63, 9: 71, 10: 79}[month(acquired)] AS ang FROM rg), bn AS (SELECT *, CASE WHEN ang IS NULL THEN 'sza_unknown' WHEN ang < 65 THEN 'sza_lt65' WHEN ang < 70 THEN 'sza_65_70' WHEN ang < 75 THEN 'sza_70_75' ELSE 'sza_gt75' END AS bin FROM mb)"


def _binned(spark, sf):
    table = F.create_map(*[F.lit(x) for kv in {3: 75, 4: 67, 5: 60, 6: 57, 7: 58, 8: 63, 9: 71, 10: 79}.items() for x in kv])
    return _scenes(spark, sf).withColumn("bin", N.sza_bin(table[F.month("acquired")].cast("string")))


ALL_BINS = (*V.BINS, "sza_unknown")


@query("A32_month_by_bin", MONTH_BIN + " SELECT CAST(month(acquired) AS INT) AS month, " + ", ".join(f"count(*) FILTER (bin = '{b}') AS {b}" for b in ALL_BINS) + " FROM bn GROUP BY ALL", NAMES)
def month_by_bin(spark, sf):
    return _binned(spark, sf).groupBy(F.month("acquired").alias("month")).pivot("bin", list(ALL_BINS)).count().na.fill(0, list(ALL_BINS))


@query("A55_catalogue_by_bin", MONTH_BIN + " SELECT region, bin, count(*) AS n, round(sum((id % 977) * CAST(0.5 AS DOUBLE)), 3) AS size_mb FROM bn GROUP BY ALL", NAMES)
def catalogue_by_bin(spark, sf):
    return _binned(spark, sf).groupBy("region", "bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum((F.col("id") % 977) * F.lit(0.5)), 3).alias("size_mb"))


@query("A56_coverage_audit", ", e AS (SELECT vec_id AS chip_id, embedding, unnest(range(64)) AS pos FROM embeddings WHERE len(embedding) = 64), ic AS (SELECT chip_id, avg(CAST(CAST(embedding[pos + 1] AS DOUBLE) + 0.5 >= 0.55 AS INT)) AS ic FROM e GROUP BY chip_id) SELECT region, count(*) AS n, count(*) FILTER (id % 11 > 0) AS present, count(acquired) AS dated, count(ic) AS covered, round(avg(ic), 6) AS mean_ic, round(max(ic), 6) AS max_ic, round(100.0 * count(*) FILTER (ic >= 0.4) / nullif(count(ic), 0), 6) AS fail_pct FROM rg LEFT JOIN ic ON chip_id = id % 600 AND id % 11 > 0 GROUP BY region", NAMES)
def coverage_audit(spark, sf):
    """Of each region: files that are there, names with a date, and the share of chips whose coverage fails."""
    ic = R.coverage(V.pixels(V.chips(spark, sf)), 0.55).select("chip_id", "ic")
    s = _scenes(spark, sf).withColumn("chip_id", F.when(F.col("id") % 11 > 0, F.col("id") % 600)).join(ic, "chip_id", "left")
    return s.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.count("chip_id").alias("present"), F.count("acquired").alias("dated"), F.count("ic").alias("covered"), F.avg("ic").alias("mean_ic"), F.max("ic").alias("max_ic"), (F.try_divide(F.count_if(F.col("ic") >= 0.4), F.count("ic")) * 100).alias("fail_pct"))


BANDS = ", lb AS (SELECT unnest(['b04', 'b03', 'b08']) AS band, unnest([b04, b03, b08]) AS v FROM px), st AS (SELECT band, avg(v) AS mean, CASE WHEN stddev_pop(v) < 1e-6 THEN 1 ELSE stddev_pop(v) END AS std FROM lb GROUP BY band)"


@query("A33_bands_normalised", BANDS + " SELECT band, round(any_value(mean), 6) AS mean, round(any_value(std), 6) AS std, round(min((v - mean) / std), 6) AS lo, round(max((v - mean) / std), 6) AS hi, round(avg(power((v - mean) / std, 2)), 6) AS power FROM lb JOIN st USING (band) GROUP BY band", PX)
def bands_normalised(spark, sf):
    """Mean and deviation of each band, and the ends and power of its values once normalised by them."""
    px = V.pixels(V.chips(spark, sf)).select(F.expr("stack(3, 'b04', b04, 'b03', b03, 'b08', b08) as (band, v)"))
    std = F.stddev_pop("v")
    s = materialise(px.groupBy("band").agg(F.avg("v").alias("mean"), F.when(std < 1e-6, 1.0).otherwise(std).alias("std")))
    z = px.join(F.broadcast(s), "band").withColumn("z", (F.col("v") - F.col("mean")) / F.col("std"))
    return z.groupBy("band").agg(F.min("mean").alias("mean"), F.min("std").alias("std"), F.min("z").alias("lo"), F.max("z").alias("hi"), F.avg(F.col("z") * F.col("z")).alias("power"))


@query("A34_training_weights", ", c AS (SELECT cls, count(*) AS n FROM cells GROUP BY cls) SELECT CAST(cls AS INT) AS cls, n, round(1 / (n + CAST(1e-6 AS DOUBLE)) / sum(1 / (n + CAST(1e-6 AS DOUBLE))) OVER () * count(*) OVER (), 6) AS weight, round(CAST(sum(n) FILTER (cls = 0) OVER () AS DOUBLE) / (sum(n) FILTER (cls > 0) OVER () + CAST(1e-6 AS DOUBLE)), 6) AS pos_weight FROM c", PX)
def training_weights(spark, sf):
    """Inverse shares scaled to a mean of 1, and the weight of the positive class for a binary model: negative by positive cells."""
    c = V.cells(spark, sf).groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    t = c.agg(F.sum(1 / (F.col("n") + F.lit(1e-6))).alias("inv"), F.count(F.lit(1)).alias("k"), F.sum(F.when(F.col("cls") == 0, F.col("n"))).alias("neg"), F.sum(F.when(F.col("cls") > 0, F.col("n"))).alias("pos"))
    return c.join(F.broadcast(t)).select("cls", "n", (1 / (F.col("n") + F.lit(1e-6)) / F.col("inv") * F.col("k")).alias("weight"), (F.col("neg") / (F.col("pos") + F.lit(1e-6))).alias("pos_weight"))


@query("A40_removed_sizes", ", f AS (SELECT unnest([source, 'total']) AS source, max_rl FROM inv) SELECT source, count(*) AS before, count(*) FILTER (max_rl >= 400) AS after, count(*) FILTER (max_rl < 400) AS removed, round(100.0 * count(*) FILTER (max_rl < 400) / count(*), 6) AS removed_pct, count(*) FILTER (max_rl < 100) AS below_100, count(*) FILTER (max_rl < 200) AS below_200, count(*) FILTER (max_rl < 300) AS below_300, count(*) FILTER (max_rl < 400) AS below_400 FROM f GROUP BY source", INVENTORY)
def removed_sizes(spark, sf):
    """A size cut by source and in total, with the root lengths of what it removes."""
    rl = F.col("max_rl")
    f = V.inventory(spark, sf).withColumn("source", F.explode(F.array("source", F.lit("total"))))
    f = f.groupBy("source").agg(F.count(F.lit(1)).alias("before"), F.count_if(rl >= 400).alias("after"), F.count_if(rl < 400).alias("removed"), *[F.count_if(rl < k).alias(f"below_{k}") for k in (100, 200, 300, 400)])
    return f.withColumn("removed_pct", F.col("removed") / F.col("before") * 100)


@query("A40_per_image", COMP.format(cond="b08 >= 0.55") + ", o AS (SELECT g, l, count(*) AS n FROM lab GROUP BY ALL) SELECT chip_id, count(l) AS before, count(*) FILTER (n >= 3) AS after, coalesce(max(n) FILTER (n < 3), 0) AS largest_removed FROM (SELECT DISTINCT chip_id FROM px) LEFT JOIN o ON g = chip_id GROUP BY chip_id", PX)
def per_image(spark, sf):
    """Objects of each image before and after a cut at three cells, and the largest one that went."""
    o = O.sizes(_labels(spark, sf, "b08 >= 0.55")).select(F.col("grid").alias("chip_id"), "px")
    n = V.chips(spark, sf).select("chip_id").join(o, "chip_id", "left").groupBy("chip_id")
    return n.agg(F.count("px").alias("before"), F.count_if(F.col("px") >= 3).alias("after"), F.coalesce(F.max(F.when(F.col("px") < 3, F.col("px"))), F.lit(0)).alias("largest_removed"))


@query("A58_small_polygons", COMP.format(cond="p >= 0.5") + ", o AS (SELECT g, l, count(*) AS n FROM lab GROUP BY ALL) SELECT sza_bin, count(*) AS n, round(avg(CAST(n < 4 AS INT)), 6) AS small_share, round(sum(n) FILTER (n < 4) / sum(n), 6) AS small_area FROM o JOIN (SELECT DISTINCT chip_id, sza_bin FROM px) ON chip_id = g GROUP BY sza_bin", PX)
def small_polygons(spark, sf):
    """Share of the model's objects below four cells, by number and by area."""
    o = O.sizes(_labels(spark, sf, "p >= 0.5")).select(F.col("grid").alias("chip_id"), "px").join(V.chips(spark, sf).select("chip_id", "sza_bin"), "chip_id")
    small = F.col("px") < 4
    return o.groupBy("sza_bin").agg(F.count(F.lit(1)).alias("n"), F.avg(small.cast("int")).alias("small_share"), (F.sum(F.when(small, F.col("px"))) / F.sum("px")).alias("small_area"))


@query("A45_global_statistics", ", asg AS (SELECT DISTINCT labeler, assignment FROM sb), dn AS (SELECT DISTINCT labeler, assignment, verdict FROM stt WHERE status = 'accepted') SELECT (SELECT count(*) FROM customer) AS total_chips, count(*) AS total_assigned, count(*) FILTER (dn.verdict IS NOT NULL AND dn.verdict <> 'skipped') AS total_complete, count(*) FILTER (dn.verdict = 'skipped') AS total_skipped, count(*) FILTER (dn.verdict IS NULL) AS total_pending, (SELECT count(DISTINCT labeler) FROM sb) AS labeler_count FROM asg LEFT JOIN dn USING (labeler, assignment)", SUBS)
def global_statistics(spark, sf):
    s = V.submissions(spark, sf)
    done = _checked(spark, sf).where("status = 'accepted'").select("labeler", "assignment", "verdict")
    a = s.select("labeler", "assignment").distinct().join(done, ["labeler", "assignment"], "left")
    n = a.agg(F.count(F.lit(1)).alias("total_assigned"), F.count_if(F.col("verdict") != "skipped").alias("total_complete"), F.count_if(F.col("verdict") == "skipped").alias("total_skipped"), F.count_if(F.col("verdict").isNull()).alias("total_pending"))
    chips, who = V.table(spark, sf, "customer").agg(F.count(F.lit(1)).alias("total_chips")), s.agg(F.countDistinct("labeler").alias("labeler_count"))
    return n.join(F.broadcast(chips)).join(F.broadcast(who))


@query("A47_totals", EXP + " SELECT 'verdict' AS kind, verdict AS name, count(*) AS n FROM rs GROUP BY verdict UNION ALL SELECT 'action', action, count(*) FROM de GROUP BY action UNION ALL SELECT 'complete', 'chips', count(DISTINCT assignment) FROM rs", SUBS)
def totals(spark, sf):
    """Verdicts of accepted submissions, actions of their decisions, and complete chips."""
    rs = _checked(spark, sf).where("status = 'accepted'")
    one = lambda df, kind, c: df.groupBy(F.col(c).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    chips = rs.agg(F.countDistinct("assignment").alias("n")).select(F.lit("complete").alias("kind"), F.lit("chips").alias("name"), "n")
    return one(rs, "verdict", "verdict").unionByName(one(_decisions(spark, sf), "action", "action")).unionByName(chips)


@query("A62_audit_by_manifest", ", mf AS (SELECT sza_bin, count(*) AS n_chips, sum(n_objects)::BIGINT AS n_objects, count(DISTINCT source) AS n_sources FROM inv GROUP BY sza_bin), nw AS (SELECT sza_bin, count(*) AS n_chips, sum(n_objects)::BIGINT AS n_objects, count(DISTINCT source) AS n_sources FROM inv WHERE sza_bin <> 'sza_lt65' OR chip % 50 > 0 GROUP BY sza_bin), lm AS (UNPIVOT mf ON n_chips, n_objects, n_sources INTO NAME field VALUE expected), ln AS (UNPIVOT nw ON n_chips, n_objects, n_sources INTO NAME field VALUE actual) SELECT sza_bin, field, expected, actual, coalesce(expected = actual, false) AS ok FROM lm FULL JOIN ln USING (sza_bin, field)", INVENTORY)
def audit_by_manifest(spark, sf):
    """Counts that a manifest recorded against those of the chips there are now (some of one bin are lost)."""
    inv = V.inventory(spark, sf)

    def header(rows, value):
        h = rows.groupBy("sza_bin").agg(F.count(F.lit(1)).alias("n_chips"), F.sum("n_objects").alias("n_objects"), F.countDistinct("source").alias("n_sources"))
        return h.select("sza_bin", F.expr(f"stack(3, 'n_chips', n_chips, 'n_objects', n_objects, 'n_sources', n_sources) as (field, {value})"))

    both = materialise(header(inv, "expected")).join(header(inv.where("sza_bin <> 'sza_lt65' or chip % 50 > 0"), "actual"), ["sza_bin", "field"], "full_outer")
    return both.withColumn("ok", F.coalesce(F.col("expected") == F.col("actual"), F.lit(False)))


@query("O3_pivot_difference", MET + " SELECT method, " + ", ".join(f"round(avg(abs_rl) FILTER (sza_bin = '{b}' AND region = 'KQ') - avg(abs_rl) FILTER (sza_bin = '{b}' AND region = 'SK'), 6) AS {b}" for b in V.BINS) + " FROM m GROUP BY method", PAIRS)
def pivot_difference(spark, sf):
    """Two pivots of mean errors (methods by bins), one region's less the other's."""
    s = _pairs(spark, sf).groupBy("region", "method", "sza_bin").agg(F.avg("abs_rl").alias("mae"))
    a, b = (M.pivoted(s.where(F.col("region") == r), "method", "sza_bin", V.BINS, "mae") for r in ("KQ", "SK"))
    return a.join(b.withColumnsRenamed({c: f"_{c}" for c in V.BINS}), "method", "full_outer").select("method", *[(F.col(c) - F.col(f"_{c}")).alias(c) for c in V.BINS])
