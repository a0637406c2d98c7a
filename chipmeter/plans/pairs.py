"""Queries over matched pairs and over inventories of chips."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import objects as O
from ..operators import sampling as S
from ..sources import views as V
from ..sources.scratch import materialise
from .common import INVENTORY, PAIRS, rounded

Q, SQL = {}, {}


def query(name: str, sql: str | None = None, views: str = PAIRS):
    def put(f):
        Q[name] = lambda spark, sf: rounded(f(spark, sf))
        if sql:
            SQL[name] = "WITH " + views.strip() + sql
        return f

    return put


def _pairs(spark, sf):
    return M.pair_metrics(V.pair_rows(spark, sf))


MET = ", m AS (SELECT *, sqrt(a_ref) AS rl_ref, sqrt(a_pred) AS rl_pred, 100 * (a_pred - a_ref) / nullif(a_ref, 0) AS re_pct, abs(a_pred - a_ref) AS abs_area, power(a_pred - a_ref, 2) AS sq_area, abs(sqrt(a_pred) - sqrt(a_ref)) AS abs_rl FROM pr)"
BUCKET = "CAST(CASE WHEN rl_ref >= 640 THEN 640 WHEN rl_ref >= 320 THEN 320 WHEN rl_ref >= 160 THEN 160 WHEN rl_ref >= 80 THEN 80 ELSE 40 END AS INT)"


@query("A12_pair_metrics", MET + " SELECT ref_id, pred_id, round(re_pct, 6) AS re_pct, round(abs_area, 6) AS abs_area, round(abs_rl, 6) AS abs_rl FROM m")
def pair_metrics(spark, sf):
    return _pairs(spark, sf).select("ref_id", "pred_id", "re_pct", "abs_area", "abs_rl")


@query("A11_pair_summary", MET + ", d AS (SELECT method, sza_bin FROM (SELECT unnest(['TR', 'OT', 'UNet', 'UNet_TR']) AS method), (SELECT unnest(['sza_lt65', 'sza_65_70', 'sza_70_75', 'sza_gt75']) AS sza_bin)) SELECT method, sza_bin, count(iou) AS n, round(avg(iou), 6) AS mean_iou, round(median(iou), 6) AS median_iou, round(avg(abs_area), 3) AS mae_area, round(avg(abs_rl), 6) AS mae_rl, round(avg(sq_area) / 1e6, 3) AS mse_area_m FROM d LEFT JOIN m USING (method, sza_bin) GROUP BY ALL")
def pair_summary(spark, sf):
    """Every method and bin, also those without pairs; the squared area error is in millions."""
    aggs = [F.count(F.lit(1)).alias("n"), F.avg("iou").alias("mean_iou"), F.round(F.avg("abs_area"), 3).alias("mae_area"), F.avg("abs_rl").alias("mae_rl"), F.round(F.avg("sq_area") / 1e6, 3).alias("mse_area_m")]
    s = M.with_percentiles(_pairs(spark, sf), ["method", "sza_bin"], "iou", {"median_iou": 0.5}, aggs)
    domain = spark.createDataFrame([(m, b) for m in ("TR", "OT", "UNet", "UNet_TR") for b in V.BINS], "method string, sza_bin string")
    return M.completed(s, domain, ["n"])


@query("A16_area_ratio_to_baseline", ", s AS (SELECT method, sza_bin, avg(a_pred) AS mean, sum(a_pred) AS total FROM pr GROUP BY ALL) SELECT s.method, s.sza_bin, round(CASE WHEN b.mean > 0 THEN s.mean / b.mean END, 6) AS mean_ratio, round(CASE WHEN b.total > 0 THEN s.total / b.total END, 6) AS total_ratio FROM s LEFT JOIN s b ON b.sza_bin = s.sza_bin AND b.method = 'TR'")
def area_ratio(spark, sf):
    s = V.pair_rows(spark, sf).groupBy("method", "sza_bin").agg(F.avg("a_pred").alias("mean"), F.sum("a_pred").alias("total"))
    out = M.ratio_to(s, ["sza_bin"], "method", "TR", "mean").withColumnRenamed("ratio", "mean_ratio")
    out = M.ratio_to(out, ["sza_bin"], "method", "TR", "total").withColumnRenamed("ratio", "total_ratio")
    return out.select("method", "sza_bin", "mean_ratio", "total_ratio")


@query("A17_error_by_size", MET + f" SELECT method, {BUCKET} AS bucket, count(*) AS n, round(avg(re_pct), 6) AS mean_re, round(median(re_pct), 6) AS median_re, round(quantile_cont(re_pct, 0.25), 6) AS p25, round(quantile_cont(re_pct, 0.75), 6) AS p75, round(avg(abs_rl), 6) AS mae_rl FROM m GROUP BY ALL")
def error_by_size(spark, sf):
    p = _pairs(spark, sf).withColumn("bucket", M.size_bucket(F.col("rl_ref")))
    aggs = [F.count(F.lit(1)).alias("n"), F.avg("re_pct").alias("mean_re"), F.avg("abs_rl").alias("mae_rl")]
    return M.with_percentiles(p, ["method", "bucket"], "re_pct", {"p25": 0.25, "median_re": 0.5, "p75": 0.75}, aggs)


def _by_degree(spark, sf):
    return M.with_percentiles(_pairs(spark, sf), ["method", "sza_deg"], "re_pct", {"med": 0.5, "p25": 0.25, "p75": 0.75}, [F.count(F.lit(1)).alias("n")])


DEG = MET + ", g AS (SELECT method, sza_deg, count(*) AS n, median(re_pct) AS med, quantile_cont(re_pct, 0.25) AS p25, quantile_cont(re_pct, 0.75) AS p75 FROM m GROUP BY ALL)"
FILL = DEG + ", d AS (SELECT method, CAST(unnest(range(lo, hi + 1)) AS INT) AS sza_deg FROM (SELECT method, min(sza_deg) AS lo, max(sza_deg) AS hi FROM g GROUP BY method)), f AS (SELECT d.method, d.sza_deg, coalesce(g.med, a.med + (b.med - a.med) * (d.sza_deg - a.sza_deg) / CAST(b.sza_deg - a.sza_deg AS DOUBLE)) AS filled FROM d LEFT JOIN g ON g.method = d.method AND g.sza_deg = d.sza_deg LEFT JOIN g a ON a.method = d.method AND a.sza_deg = d.sza_deg - 1 LEFT JOIN g b ON b.method = d.method AND b.sza_deg = d.sza_deg + 1)"


@query("A18_error_by_degree", DEG + " SELECT method, sza_deg, n, round(med, 6) AS med, round(p25, 6) AS p25, round(p75, 6) AS p75 FROM g")
def error_by_degree(spark, sf):
    return _by_degree(spark, sf)


@query("A19_low_sample_flag", DEG + " SELECT method, sza_deg, n, n < 1000 AS low FROM g")
def low_sample(spark, sf):
    return V.pair_rows(spark, sf).groupBy("method", "sza_deg").agg(F.count(F.lit(1)).alias("n")).withColumn("low", F.col("n") < 1000)


@query("W8_gap_fill", FILL + " SELECT method, sza_deg, round(filled, 6) AS filled FROM f")
def gap_fill(spark, sf):
    return M.gap_fill(_by_degree(spark, sf), ["method"], "sza_deg", "med")


@query("W9_centred_mean", FILL + " SELECT method, sza_deg, round(avg(filled) OVER (PARTITION BY method ORDER BY sza_deg ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM f")
def centred_mean(spark, sf):
    return M.centred_mean(gap_fill(spark, sf), ["method"], "sza_deg", "filled").select("method", "sza_deg", "smooth")


@query("A57_mean_relative_error", MET + " SELECT method, count(*) AS n, round(avg(re_pct), 6) AS mre, count(*) FILTER (rl_ref > 100) AS n_large, round(avg(re_pct) FILTER (rl_ref > 100), 6) AS mre_large FROM m GROUP BY method")
def mean_relative_error(spark, sf):
    big = F.col("rl_ref") > 100
    return _pairs(spark, sf).groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.avg("re_pct").alias("mre"), F.count_if(big).alias("n_large"), F.avg(F.when(big, F.col("re_pct"))).alias("mre_large"))


@query("A59_area_regression", " SELECT method, count(*) AS n, round(corr(a_pred, a_ref), 6) AS r, round(regr_slope(a_pred, a_ref), 6) AS slope, round(regr_intercept(a_pred, a_ref), 3) AS intercept FROM pr GROUP BY method")
def area_regression(spark, sf):
    return V.pair_rows(spark, sf).groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.corr("a_pred", "a_ref").alias("r"), F.regr_slope("a_pred", "a_ref").alias("slope"), F.round(F.regr_intercept("a_pred", "a_ref"), 3).alias("intercept"))


@query("A60_bias_by_area_bin", MET + f", b AS (SELECT method, {BUCKET} AS bucket, avg(re_pct) AS bias, quantile_cont(re_pct, 0.1) AS p10, quantile_cont(re_pct, 0.9) AS p90 FROM m GROUP BY ALL) SELECT b.method, b.bucket, round(b.bias, 6) AS bias, round(b.p10, 6) AS p10, round(b.p90, 6) AS p90, round(b.bias - t.bias, 6) AS delta FROM b LEFT JOIN b t ON t.bucket = b.bucket AND t.method = 'TR'")
def bias_by_area(spark, sf):
    p = _pairs(spark, sf).withColumn("bucket", M.size_bucket(F.col("rl_ref")))
    b = M.with_percentiles(p, ["method", "bucket"], "re_pct", {"p10": 0.1, "p90": 0.9}, [F.avg("re_pct").alias("bias")])
    t = b.where("method = 'TR'").select("bucket", F.col("bias").alias("base"))
    return b.join(t, "bucket", "left").select("method", "bucket", "bias", "p10", "p90", (F.col("bias") - F.col("base")).alias("delta"))


@query("A44_set_area_error", ", c AS (SELECT ref_id, method, (sum(a_pred) - sum(a_ref)) / nullif(sum(a_ref), 0) AS err FROM pr WHERE sqrt(a_ref) >= 100 GROUP BY ALL) SELECT method, count(*) AS n, round(avg(err), 6) AS err FROM c GROUP BY method")
def set_area_error(spark, sf):
    c = V.pair_rows(spark, sf).where("sqrt(a_ref) >= 100").groupBy("ref_id", "method").agg(F.try_divide(F.sum("a_pred") - F.sum("a_ref"), F.sum("a_ref")).alias("err"))
    return c.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.avg("err").alias("err"))


def _mae(spark, sf):
    return _pairs(spark, sf).groupBy("method", "sza_bin").agg(F.avg("abs_rl").alias("mae"))


WIDE = "round(avg(abs_rl) FILTER (sza_bin = 'sza_lt65'), 6) AS sza_lt65, round(avg(abs_rl) FILTER (sza_bin = 'sza_65_70'), 6) AS sza_65_70, round(avg(abs_rl) FILTER (sza_bin = 'sza_70_75'), 6) AS sza_70_75, round(avg(abs_rl) FILTER (sza_bin = 'sza_gt75'), 6) AS sza_gt75"


@query("O3_pivot_method_bin", MET + f" SELECT method, {WIDE} FROM m GROUP BY method")
def pivot(spark, sf):
    return M.pivoted(_mae(spark, sf), "method", "sza_bin", V.BINS, "mae")


@query("O3_melt_back", MET + " SELECT method, sza_bin, round(avg(abs_rl), 6) AS mae FROM m GROUP BY ALL")
def melt(spark, sf):
    return M.melted(pivot(spark, sf), "method", V.BINS, "sza_bin", "mae")


@query("O1_ordered_category_sort", MET + " SELECT method, sza_bin, CAST(list_position(['sza_lt65', 'sza_65_70', 'sza_70_75', 'sza_gt75'], sza_bin) AS INT) AS bin_rank, round(avg(abs_rl), 6) AS mae FROM m GROUP BY ALL ORDER BY method, bin_rank")
def ordered(spark, sf):
    rank = F.array_position(F.array(*map(F.lit, V.BINS)), F.col("sza_bin")).cast("int")
    return _mae(spark, sf).withColumn("bin_rank", rank).orderBy("method", "bin_rank")


@query("O2_best_delta", MET + ", s AS (SELECT method, sza_bin, avg(abs_rl) AS mae FROM m GROUP BY ALL) SELECT s.method, s.sza_bin, round(b.mae - s.mae, 6) AS gain FROM s JOIN s b ON b.sza_bin = s.sza_bin AND b.method = 'TR' ORDER BY b.mae - s.mae DESC, s.method, s.sza_bin LIMIT 1")
def best_delta(spark, sf):
    s = _mae(spark, sf)
    b = s.where("method = 'TR'").select("sza_bin", F.col("mae").alias("base"))
    return s.join(b, "sza_bin").select("method", "sza_bin", (F.col("base") - F.col("mae")).alias("gain")).orderBy(F.desc("gain"), "method", "sza_bin").limit(1)


@query("J19_metric_comparison", MET + ", a AS (SELECT sza_deg, avg(abs_rl) AS v FROM m WHERE method = 'TR' AND sza_deg < 80 GROUP BY sza_deg), b AS (SELECT sza_deg, avg(abs_rl) AS v FROM m WHERE method = 'OT' AND sza_deg > 60 GROUP BY sza_deg) SELECT coalesce(a.sza_deg, b.sza_deg) AS sza_deg, round(a.v, 6) AS base, round(b.v, 6) AS other, round(b.v - a.v, 6) AS delta FROM a FULL JOIN b ON a.sza_deg = b.sza_deg")
def comparison(spark, sf):
    p = _pairs(spark, sf)
    a = p.where("method = 'TR' and sza_deg < 80").groupBy("sza_deg").agg(F.avg("abs_rl").alias("base"))
    b = p.where("method = 'OT' and sza_deg > 60").groupBy("sza_deg").agg(F.avg("abs_rl").alias("other"))
    return a.join(b, "sza_deg", "full_outer").withColumn("delta", F.col("other") - F.col("base"))


@query("A14_pair_detection_stats", " SELECT method, region, count(DISTINCT ref_id) AS n_ref, count(*) AS n_pred, count(*) FILTER (iou >= 0.5) AS n_matched, round(CAST(count(*) FILTER (iou >= 0.5) AS DOUBLE) / nullif(count(DISTINCT ref_id), 0), 6) AS match_rate, round(avg(iou) FILTER (iou >= 0.5), 6) AS mean_iou FROM pr GROUP BY ALL")
def pair_detection(spark, sf):
    hit = F.col("iou") >= 0.5
    out = V.pair_rows(spark, sf).groupBy("method", "region").agg(F.countDistinct("ref_id").alias("n_ref"), F.count(F.lit(1)).alias("n_pred"), F.count_if(hit).alias("n_matched"), F.avg(F.when(hit, F.col("iou"))).alias("mean_iou"))
    return out.withColumn("match_rate", F.try_divide("n_matched", "n_ref"))


INV = INVENTORY


@query("A20_relative_abundance", " SELECT coalesce(sza_bin, 'all') AS sza_bin, count(*) FILTER (n_objects = 0) AS n0, count(*) FILTER (n_objects >= 1) AS n1, count(*) FILTER (n_objects >= 5) AS n5 FROM inv GROUP BY ROLLUP (sza_bin)", INV)
def abundance(spark, sf):
    n = F.col("n_objects")
    out = V.inventory(spark, sf).rollup("sza_bin").agg(F.count_if(n == 0).alias("n0"), F.count_if(n >= 1).alias("n1"), F.count_if(n >= 5).alias("n5"))
    return out.withColumn("sza_bin", F.coalesce("sza_bin", F.lit("all")))


@query("A21_descriptive_table", " SELECT coalesce(sza_bin, 'all') AS sza_bin, sum(n_objects)::BIGINT AS n_objects, count(*) AS n_chips, round(avg(max_rl), 6) AS mean_rl, round(median(max_rl), 6) AS median_rl, round(max(max_rl), 6) AS max_rl FROM inv GROUP BY ROLLUP (sza_bin)", INV)
def descriptive(spark, sf):
    inv = V.inventory(spark, sf).withColumn("sza_bin", F.explode(F.array("sza_bin", F.lit("all"))))
    aggs = [F.sum("n_objects").alias("n_objects"), F.count(F.lit(1)).alias("n_chips"), F.avg("max_rl").alias("mean_rl"), F.max("max_rl").alias("max_rl")]
    return M.with_percentiles(inv, ["sza_bin"], "max_rl", {"median_rl": 0.5}, aggs)


@query("A23_root_length_stats", " SELECT source, count(*) AS n, round(avg(max_rl), 6) AS mean, round(stddev_samp(max_rl), 6) AS std, round(quantile_cont(max_rl, 0.25), 6) AS p25, round(median(max_rl), 6) AS median, round(quantile_cont(max_rl, 0.75), 6) AS p75, max(max_rl) AS most FROM inv GROUP BY source", INV)
def rl_stats(spark, sf):
    aggs = [F.count(F.lit(1)).alias("n"), F.avg("max_rl").alias("mean"), F.stddev_samp("max_rl").alias("std"), F.max("max_rl").alias("most")]
    return M.with_percentiles(V.inventory(spark, sf), ["source"], "max_rl", {"p25": 0.25, "median": 0.5, "p75": 0.75}, aggs)


@query("A40_size_filter_report", ", f AS (SELECT coalesce(source, 'total') AS source, count(*) AS before, count(*) FILTER (max_rl >= 400) AS after FROM inv GROUP BY ROLLUP (source)) SELECT source, before, after, before - after AS removed, round(100.0 * (before - after) / before, 6) AS removed_pct FROM f", INV)
def size_filter(spark, sf):
    f = V.inventory(spark, sf).rollup("source").agg(F.count(F.lit(1)).alias("before"), F.count_if(F.col("max_rl") >= 400).alias("after")).withColumn("source", F.coalesce("source", F.lit("total")))
    gone = F.col("before") - F.col("after")
    return f.withColumns({"removed": gone, "removed_pct": gone / F.col("before") * 100})


#: Shares of all chips for test and validation.
TEST, VAL = 0.1, 0.15
SPLIT = ", rk AS (SELECT *, row_number() OVER (PARTITION BY sza_bin ORDER BY md5('42|' || chip), chip) AS rn FROM inv), tt AS (SELECT greatest(1, CAST(round_even(count(*) * CAST(0.1 AS DOUBLE), 0) AS BIGINT)) // greatest(1, count(DISTINCT sza_bin) FILTER (sza_bin <> 'unknown')) AS per, greatest(1, CAST(round_even(count(*) * CAST(0.15 AS DOUBLE), 0) AS BIGINT)) AS nv FROM inv), te AS (SELECT rk.*, sza_bin <> 'unknown' AND rn <= greatest(1, per) AS test, nv FROM rk, tt), sp AS (SELECT *, CASE WHEN test THEN 'test' WHEN row_number() OVER (PARTITION BY test ORDER BY md5('43|' || chip), chip) <= nv THEN 'val' ELSE 'train' END AS split FROM te)"


def _split(spark, sf):
    return S.stratified_split(V.inventory(spark, sf), TEST, VAL, V.BINS)


@query("W1_stratified_split", SPLIT + " SELECT chip, sza_bin, split FROM sp", INV)
def split(spark, sf):
    return _split(spark, sf).select("chip", "sza_bin", "split")


@query("A22_null_positive_ratio", SPLIT + ", g AS (SELECT split, sza_bin, count(*) FILTER (n_objects = 0) AS n_null, count(*) FILTER (n_objects > 0) AS n_pos FROM sp GROUP BY GROUPING SETS ((split, sza_bin), (sza_bin))) SELECT split, sza_bin, n_null, n_pos, round(CAST(n_null AS DOUBLE) / nullif(n_pos, 0), 6) AS ratio, round(100.0 * n_null / (n_null + n_pos), 6) AS null_pct FROM g", INV)
def null_ratio(spark, sf):
    g = _split(spark, sf).groupingSets([["split", "sza_bin"], ["sza_bin"]], "split", "sza_bin").agg(F.count_if(F.col("n_objects") == 0).alias("n_null"), F.count_if(F.col("n_objects") > 0).alias("n_pos"))
    return g.withColumns({"ratio": F.try_divide("n_null", "n_pos"), "null_pct": F.col("n_null") / (F.col("n_null") + F.col("n_pos")) * 100})


@query("A37_counts_pivot", SPLIT + " SELECT sza_bin, count(*) FILTER (n_objects = 0) AS gt0, count(*) FILTER (n_objects > 0) AS gt_plus FROM sp WHERE split = 'test' GROUP BY sza_bin", INV)
def counts_pivot(spark, sf):
    t = _split(spark, sf).where("split = 'test'").withColumn("k", F.when(F.col("n_objects") > 0, "gt_plus").otherwise("gt0"))
    return t.groupBy("sza_bin").pivot("k", ["gt0", "gt_plus"]).count().na.fill(0)


@query("A38_manifest_counts", SPLIT + " SELECT split, count(*) AS n, count(*) FILTER (n_objects > 0) AS n_pos, count(*) FILTER (source = 'expert') AS n_expert FROM sp GROUP BY split", INV)
def manifest_counts(spark, sf):
    return _split(spark, sf).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_objects") > 0).alias("n_pos"), F.count_if(F.col("source") == "expert").alias("n_expert"))


#: Identity of lines ``ln`` by group ``g`` in SQL: 4,096 sorted buckets, each hashed, then the hashes.
IDENTITY = "{name} AS (SELECT g, sha256(string_agg(b || h, chr(10) ORDER BY b || h)) AS hash FROM (SELECT g, left(md5(ln), 3) AS b, sha256(string_agg(ln, chr(10) ORDER BY ln)) AS h FROM {source} GROUP BY ALL) GROUP BY g)"


@query("A39_dataset_identity_hash", SPLIT + ", li AS (SELECT split AS g, chip || '|' || sza_bin || '|' || split AS ln FROM sp), " + IDENTITY.format(name="ih", source="li") + " SELECT g AS split, hash FROM ih", INV)
def identity(spark, sf):
    return S.identity_hash(_split(spark, sf), ["split"], F.concat_ws("|", F.col("chip").cast("string"), "sza_bin", "split"))


BAL = SPLIT + ", tr AS (SELECT * FROM sp WHERE split = 'train'), nb AS (SELECT sza_bin, least(count(*) FILTER (n_objects > 0), count(*) FILTER (n_objects = 0)) AS low FROM tr WHERE sza_bin <> 'unknown' GROUP BY sza_bin), bl AS (SELECT tr.chip, tr.sza_bin, tr.n_objects, tr.max_rl, low, row_number() OVER (PARTITION BY tr.sza_bin, tr.n_objects > 0 ORDER BY md5('42|' || chip), chip) AS r FROM tr JOIN nb USING (sza_bin)), kept AS (SELECT * FROM bl WHERE low < 5 OR r <= floor(low * 1.5))"


#: Most of one class for one of the other, and fewest chips of a size bin that are balanced.
RATIO, LEAST_SIZE = 1.5, 3


def _balanced(spark, sf):
    return S.class_balance(_split(spark, sf).where("split = 'train'"), RATIO, V.BINS)


@query("W2_class_balance", BAL + " SELECT chip, sza_bin, n_objects > 0 AS positive, CASE WHEN low < 5 THEN 'skipped' ELSE 'balanced' END AS action FROM kept", INV)
def balance(spark, sf):
    return _balanced(spark, sf).select("chip", "sza_bin", "positive", "action")


SZ = BAL + ", z AS (SELECT *, CASE WHEN max_rl < 100 THEN 'rl_40_100' WHEN max_rl < 300 THEN 'rl_100_300' ELSE 'rl_300_plus' END AS size_bin FROM kept WHERE n_objects > 0), zn AS (SELECT *, count(*) OVER (PARTITION BY sza_bin, size_bin) AS cn, row_number() OVER (PARTITION BY sza_bin, size_bin ORDER BY md5('42|' || chip), chip) AS q FROM z)"


def _sized(spark, sf):
    return _balanced(spark, sf).where("positive").withColumn("size_bin", O.size_bin(F.col("max_rl")))


def _copies_sql(target: str) -> str:
    return f", tg AS (SELECT *, {target} AS target FROM zn), cp AS (SELECT chip, sza_bin, size_bin, unnest(range(0, CAST(target // cn + CASE WHEN q <= target % cn THEN 1 ELSE 0 END AS BIGINT))) AS copy FROM tg) SELECT sza_bin, size_bin, CAST(copy AS INT) AS copy, count(*) AS n, sum(chip)::BIGINT AS chips FROM cp GROUP BY ALL"


#: Marks of a stratum whose smallest size bin has ``m`` chips, in SQL.
MARKS = "greatest(m, 3) AS lo, greatest(floor(m * 1.5), floor(greatest(m, 3) * 1.5)) AS hi"


@query("W3_size_band", SZ + f", mk AS (SELECT sza_bin, {MARKS} FROM (SELECT sza_bin, min(cn) AS m FROM zn GROUP BY sza_bin)), zb AS (SELECT zn.*, lo, hi FROM zn JOIN mk USING (sza_bin))" + _copies_sql("CAST(CASE WHEN cn <= lo THEN lo WHEN cn > hi THEN hi ELSE cn END AS BIGINT)").replace("FROM zn", "FROM zb"), INV)
def size_band(spark, sf):
    z = materialise(_sized(spark, sf))
    by = ["sza_bin", "size_bin"]
    t = S.size_targets(z.groupBy(*by).agg(F.count(F.lit(1)).alias("c")), RATIO, LEAST_SIZE).select(*by, "target")
    return S.to_targets(z, t, by).groupBy(*by, "copy").agg(F.count(F.lit(1)).alias("n"), F.sum("chip").alias("chips"))


@query("W4_oversample_cap", SZ.replace("), zn AS", "), zm AS (SELECT sza_bin, max(c) AS most FROM (SELECT sza_bin, size_bin, count(*) AS c FROM z GROUP BY ALL) GROUP BY sza_bin), zn AS").replace("FROM z)", "FROM z JOIN zm USING (sza_bin))") + _copies_sql("least(most, 4 * cn)"), INV)
def oversample(spark, sf):
    z = _sized(spark, sf)
    by = ["sza_bin", "size_bin"]
    n = z.groupBy(*by).agg(F.count(F.lit(1)).alias("c"))
    most = n.groupBy("sza_bin").agg(F.max("c").alias("most"))
    t = n.join(most, "sza_bin").select(*by, F.least("most", 4 * F.col("c")).alias("target"))
    return S.to_targets(z, t, by).groupBy(*by, "copy").agg(F.count(F.lit(1)).alias("n"), F.sum("chip").alias("chips"))


#: Stage 2 by counts: targets of the size band, and the first rule that leaves a bin alone.
STAGE2 = SZ + f", c1 AS (SELECT sza_bin, size_bin, count(*) AS c FROM z GROUP BY ALL), mk AS (SELECT sza_bin, {MARKS} FROM (SELECT sza_bin, min(c) AS m FROM c1 GROUP BY sza_bin)), c2 AS (SELECT c1.*, CAST(CASE WHEN c <= lo THEN lo WHEN c > hi THEN hi ELSE c END AS BIGINT) AS target FROM c1 JOIN mk USING (sza_bin)), b2 AS (SELECT sza_bin, count(*) AS bins, min(c) AS low, sum(c)::BIGINT AS pos, sum(target)::BIGINT AS cand FROM c2 GROUP BY sza_bin), n2 AS (SELECT sza_bin, count(*) FILTER (n_objects = 0) AS nulls FROM kept GROUP BY sza_bin), r1 AS (SELECT sza_bin, coalesce(bins, 0) AS bins, coalesce(low, 0) AS low, coalesce(pos, 0) AS pos, coalesce(cand, 0) AS cand, coalesce(nulls, 0) AS nulls FROM (SELECT unnest(['sza_lt65', 'sza_65_70', 'sza_70_75', 'sza_gt75']) AS sza_bin) LEFT JOIN b2 USING (sza_bin) LEFT JOIN n2 USING (sza_bin)), r2 AS (SELECT *, CASE WHEN bins < 2 THEN 'one_bin' WHEN low < 3 THEN 'few' WHEN nulls <= CAST(1.5 AS DOUBLE) * pos AND nulls > CAST(1.5 AS DOUBLE) * cand THEN 'ratio' ELSE '' END AS skipped_reason FROM r1)"


def _stage2(balanced):
    """Counts of size bins with their targets, and each bin's reason to be left alone ('' if none)."""
    b = materialise(balanced.select("sza_bin", "positive", "max_rl"))
    c = b.where("positive").groupBy("sza_bin", O.size_bin(F.col("max_rl")).alias("size_bin")).agg(F.count(F.lit(1)).alias("c"))
    c = materialise(S.size_targets(c, RATIO, LEAST_SIZE))
    nulls = b.groupBy("sza_bin").agg(F.count_if(~F.col("positive")).alias("nulls"))
    return c, S.size_skip_rules(c, nulls, RATIO, LEAST_SIZE, V.BINS)


@query("W5_size_skip_rules", STAGE2 + " SELECT sza_bin, bins, low, pos, cand, nulls, skipped_reason FROM r2", INV)
def size_skip(spark, sf):
    return _stage2(_balanced(spark, sf))[1]


@query("W6_balance_report", STAGE2 + ", g1 AS (SELECT unnest(['GT0', 'GT+']) AS group_name), s1 AS (SELECT t.sza_bin, CASE WHEN t.n_objects > 0 THEN 'GT+' ELSE 'GT0' END AS group_name, count(*) AS o, count(k.chip) AS b FROM tr t LEFT JOIN kept k USING (chip) GROUP BY ALL), h1 AS (SELECT sza_bin, group_name, coalesce(o, 0) AS o, coalesce(b, 0) AS b FROM (SELECT unnest(['sza_lt65', 'sza_65_70', 'sza_70_75', 'sza_gt75']) AS sza_bin) CROSS JOIN g1 LEFT JOIN s1 USING (sza_bin, group_name)), l1 AS (SELECT sza_bin, min(o) AS low FROM h1 GROUP BY sza_bin) SELECT 'stage1_gt_balance' AS stage, sza_bin, group_name, o AS original_count, b AS balanced_count, CASE WHEN low < 5 THEN 'skipped' WHEN b < o THEN 'undersampled' ELSE 'unchanged' END AS action, CASE WHEN low < 5 THEN 'few' ELSE '' END AS skipped_reason FROM h1 JOIN l1 USING (sza_bin) UNION ALL SELECT 'stage2_positive_area_balance', r2.sza_bin, s.x, coalesce(c, 0), CASE WHEN skipped_reason <> '' THEN coalesce(c, 0) ELSE coalesce(target, 0) END, CASE WHEN skipped_reason <> '' THEN 'skipped' WHEN c IS NULL THEN 'absent' WHEN target > c THEN 'oversampled' WHEN target < c THEN 'undersampled' ELSE 'unchanged' END, skipped_reason FROM r2 CROSS JOIN (SELECT unnest(['rl_40_100', 'rl_100_300', 'rl_300_plus']) AS x) s LEFT JOIN c2 ON c2.sza_bin = r2.sza_bin AND c2.size_bin = s.x", INV)
def balance_report(spark, sf):
    """Both stages: counts before and after, what was done, and why a bin was left alone."""
    train = materialise(_split(spark, sf).where("split = 'train'"))
    kept = materialise(S.class_balance(train, RATIO, V.BINS))
    t = train.where(F.col("sza_bin").isin(*V.BINS)).select("sza_bin", F.when(F.col("n_objects") > 0, "GT+").otherwise("GT0").alias("group_name"), F.lit("o").alias("side"))
    b = kept.select("sza_bin", F.when(F.col("positive"), "GT+").otherwise("GT0").alias("group_name"), F.lit("b").alias("side"))
    one = t.unionByName(b).groupBy("sza_bin", "group_name").agg(F.count_if(F.col("side") == "o").alias("o"), F.count_if(F.col("side") == "b").alias("b"))
    one = M.completed(one, spark.createDataFrame([(x,) for x in V.BINS], "sza_bin string").select("sza_bin", F.explode(F.array(F.lit("GT0"), F.lit("GT+"))).alias("group_name")), ["o", "b"])
    low = one.groupBy("sza_bin").agg((F.min("o") < 5).alias("few"))
    act = F.when(F.col("few"), "skipped").when(F.col("b") < F.col("o"), "undersampled").otherwise("unchanged")
    names = ["stage", "sza_bin", "group_name", "original_count", "balanced_count", "action", "skipped_reason"]
    first = one.join(low, "sza_bin").select(F.lit("stage1_gt_balance"), "sza_bin", "group_name", "o", "b", act, F.when(F.col("few"), "few").otherwise("")).toDF(*names)
    c, r = _stage2(kept)
    two = r.select("sza_bin", "skipped_reason", F.explode(F.array(*map(F.lit, ("rl_40_100", "rl_100_300", "rl_300_plus")))).alias("size_bin")).join(c, ["sza_bin", "size_bin"], "left")
    left = F.col("skipped_reason") != ""
    act = F.when(left, "skipped").when(F.col("c").isNull(), "absent").when(F.col("target") > F.col("c"), "oversampled").when(F.col("target") < F.col("c"), "undersampled").otherwise("unchanged")
    n = lambda col: F.coalesce(col, F.lit(0))
    second = two.select(F.lit("stage2_positive_area_balance"), "sza_bin", "size_bin", n("c"), F.when(left, n("c")).otherwise(n("target")), act, "skipped_reason").toDF(*names)
    return first.unionByName(second)


@query("W7_custom_ratio", SPLIT + ", rt(sza_bin, k) AS (VALUES ('sza_lt65', 40), ('sza_65_70', 30), ('sza_70_75', 20)), p AS (SELECT chip, sza_bin, k, row_number() OVER (PARTITION BY sza_bin ORDER BY md5('7|' || chip), chip) AS r FROM sp JOIN rt USING (sza_bin) WHERE split = 'train' AND n_objects > 0) SELECT chip, sza_bin FROM p WHERE r <= k", INV)
def custom_ratio(spark, sf):
    k = spark.createDataFrame([("sza_lt65", 40), ("sza_65_70", 30), ("sza_70_75", 20)], "sza_bin string, k int")
    t = _split(spark, sf).where("split = 'train' and n_objects > 0").join(F.broadcast(k), "sza_bin")
    return S.first_by(t, ["sza_bin"], [S.seeded(7, "chip"), "chip"], 40).where("rank <= k").select("chip", "sza_bin")


#: Training chips of listed bins and their counts, in SQL.
STRATA = SPLIT + ", tb AS (SELECT *, n_objects > 0 AS positive FROM sp WHERE split = 'train' AND sza_bin <> 'unknown')"


def _training(spark, sf):
    return materialise(_split(spark, sf).where(F.col("split") == "train").where(F.col("sza_bin").isin(*V.BINS)).withColumn("positive", F.col("n_objects") > 0))


@query("W7_fixed_total", STRATA + ", c AS (SELECT sza_bin, positive, count(*) AS n, sum(count(*)) OVER ()::BIGINT AS t FROM tb GROUP BY ALL), f AS (SELECT *, least(n, 114 * n // t) AS fl, 114 * n % t AS rest FROM c), k AS (SELECT *, fl + CASE WHEN row_number() OVER (ORDER BY rest DESC, sza_bin, positive) <= least(114, t) - sum(fl) OVER () THEN 1 ELSE 0 END AS quota FROM f), r AS (SELECT chip, sza_bin, positive, quota, row_number() OVER (PARTITION BY sza_bin, positive ORDER BY md5('11|' || chip), chip) AS rn FROM tb JOIN k USING (sza_bin, positive)) SELECT chip, sza_bin, positive FROM r WHERE rn <= quota", INV)
def fixed_total(spark, sf):
    """114 training chips, with each bin's and class's share of all."""
    t = _training(spark, sf)
    by = ["sza_bin", "positive"]
    q = S.apportioned(t.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), by, 114, "n")
    return S.drawn(t, by, q, 11).select("chip", *by)


@query("W7_equal_bins", STRATA + ", c AS (SELECT count(*) // 4 AS per FROM tb), r AS (SELECT chip, sza_bin, row_number() OVER (PARTITION BY sza_bin ORDER BY md5('12|' || chip), chip) AS rn FROM tb) SELECT chip, sza_bin FROM r, c WHERE rn <= per", INV)
def equal_bins(spark, sf):
    """The same number from each bin, all chips divided by the bins; a bin with fewer gives all it has."""
    t = _training(spark, sf)
    n = t.groupBy("sza_bin").agg(F.count(F.lit(1)).alias("n"))
    per = n.agg(F.floor(F.sum("n") / len(V.BINS)).alias("per"))
    return S.drawn(t, ["sza_bin"], n.join(F.broadcast(per)).select("sza_bin", F.least("n", "per").alias("quota")), 12).select("chip", "sza_bin")


@query("W7_equal_bins_filled", STRATA + ", tr2 AS (SELECT * FROM tb WHERE sza_bin <> 'sza_lt65' OR chip % 4 = 0), b AS (SELECT sza_bin, count(*) AS n FROM tr2 GROUP BY sza_bin), w AS (SELECT unnest(range(0, (SELECT max(n) + 1 FROM b))) AS v), lv AS (SELECT max(v) AS v FROM w WHERE (SELECT sum(least(n, w.v)) FROM b) <= 400), fl AS (SELECT sza_bin, n, least(n, v) AS fl, n > v AS more FROM b, lv), qb AS (SELECT sza_bin, fl + CASE WHEN more AND row_number() OVER (PARTITION BY more ORDER BY sza_bin) <= least(400, (SELECT sum(n) FROM b)) - (SELECT sum(fl) FROM fl) THEN 1 ELSE 0 END AS quota FROM fl), r AS (SELECT chip, sza_bin, quota, row_number() OVER (PARTITION BY sza_bin ORDER BY md5('13|' || chip), chip) AS rn FROM tr2 JOIN qb USING (sza_bin)) SELECT chip, sza_bin FROM r WHERE rn <= quota", INV)
def equal_bins_filled(spark, sf):
    """400 chips from bins of the same size where one has too few; the others fill up what it lacks."""
    t = _training(spark, sf).where("sza_bin <> 'sza_lt65' or chip % 4 = 0")
    n = t.groupBy("sza_bin").agg(F.count(F.lit(1)).alias("n"), F.lit(1).alias("w"))
    return S.drawn(t, ["sza_bin"], S.apportioned(n, ["sza_bin"], 400, "w"), 13).select("chip", "sza_bin")


#: Positive and null chips of each bin, in relation to each other.
RATIOS = {"sza_lt65": (1.0, 0.5), "sza_65_70": (1.0, 1.0), "sza_70_75": (1.0, 1.0), "sza_gt75": (1.0, 2.0)}


@query("W7_ratio_table", STRATA + ", rt(sza_bin, p, z) AS (VALUES ('sza_lt65', 2, 1), ('sza_65_70', 1, 1), ('sza_70_75', 1, 1), ('sza_gt75', 1, 2)), c AS (SELECT sza_bin, p, z, count(*) FILTER (positive) AS np, count(*) FILTER (NOT positive) AS nn FROM tb JOIN rt USING (sza_bin) GROUP BY ALL), q AS (SELECT sza_bin, CASE WHEN np * z <= nn * p THEN np ELSE nn * p // z END AS qp, CASE WHEN np * z <= nn * p THEN np * z // p ELSE nn END AS qz FROM c), r AS (SELECT chip, sza_bin, positive, CASE WHEN positive THEN qp ELSE qz END AS quota, row_number() OVER (PARTITION BY sza_bin, positive ORDER BY md5('14|' || chip), chip) AS rn FROM tb JOIN q USING (sza_bin)) SELECT chip, sza_bin, positive FROM r WHERE rn <= quota", INV)
def ratio_table(spark, sf):
    t = _training(spark, sf)
    c = t.groupBy("sza_bin").agg(F.count_if("positive").alias("np"), F.count_if(~F.col("positive")).alias("nn"))
    q = S.ratio_quotas(c, spark.createDataFrame([(b, *r) for b, r in RATIOS.items()], "sza_bin string, gt_plus double, gt_zero double"))
    q = q.select("sza_bin", F.explode(F.array(F.struct(F.lit(True).alias("positive"), F.col("q_plus").alias("quota")), F.struct(F.lit(False).alias("positive"), F.col("q_zero").alias("quota")))).alias("q")).select("sza_bin", "q.*")
    return S.drawn(t, ["sza_bin", "positive"], q, 14).select("chip", "sza_bin", "positive")


@query("W10_top_n_per_group", " SELECT chip, source, CAST(r AS INT) AS rank FROM (SELECT chip, source, row_number() OVER (PARTITION BY source ORDER BY max_rl, n_objects DESC, md5('42|' || chip)) AS r FROM inv) WHERE r <= 20", INV)
def top_n(spark, sf):
    return S.first_by(V.inventory(spark, sf), ["source"], ["max_rl", F.desc("n_objects"), S.seeded(42, "chip")], 20).select("chip", "source", "rank")


@query("W11_proportional_quota", ", n AS (SELECT source, count(*) AS c, sum(count(*)) OVER () AS t FROM inv GROUP BY source), k AS (SELECT source, CASE WHEN source = 'crowd' THEN round_even(100.0 * c / t, 0) ELSE 100 - (SELECT round_even(100.0 * c / t, 0) FROM n WHERE source = 'crowd') END AS q FROM n) SELECT chip, source FROM (SELECT chip, source, q, row_number() OVER (PARTITION BY source ORDER BY md5('42|' || chip), chip) AS r FROM inv JOIN k USING (source)) WHERE r <= q", INV)
def quota(spark, sf):
    inv = V.inventory(spark, sf)
    n = inv.agg(F.count_if(F.col("source") == "crowd").alias("c"), F.count(F.lit(1)).alias("t")).select(F.bround(100.0 * F.col("c") / F.col("t")).cast("int").alias("crowd"))
    out = S.first_by(inv, ["source"], [S.seeded(42, "chip"), "chip"], 100).join(F.broadcast(n))
    return out.where(F.col("rank") <= F.when(F.col("source") == "crowd", F.col("crowd")).otherwise(100 - F.col("crowd"))).select("chip", "source")


@query("W12_append_nulls", SPLIT + ", a AS (SELECT chip, split FROM sp WHERE n_objects > 0 UNION ALL SELECT chip, 'train' FROM sp WHERE n_objects = 0), li AS (SELECT 0 AS g, chip || '|' || split AS ln FROM a), " + IDENTITY.format(name="ih", source="li") + " SELECT chip, split, row_number() OVER (PARTITION BY split ORDER BY chip) - 1 AS position, (SELECT hash FROM ih) AS dataset_hash FROM a", INV)
def append_nulls(spark, sf):
    """Positions after null chips went to training, and the new identity hash of the whole set."""
    s = materialise(_split(spark, sf))
    a = s.where("n_objects > 0").select("chip", "split").unionByName(s.where("n_objects = 0").select("chip", F.lit("train").alias("split")))
    whole = S.identity_hash(a, [], F.concat_ws("|", F.col("chip").cast("string"), "split")).withColumnRenamed("hash", "dataset_hash")
    return S.with_positions(a, "split", "chip").select("chip", "split", "position").join(F.broadcast(whole))


@query("W20_seeded_batches", ", s AS (SELECT chip, row_number() OVER (ORDER BY md5('5|' || chip), chip) AS rn FROM inv WHERE n_objects > 0) SELECT chip, CAST(floor((rn - 1) / 150.0) AS INT) AS batch FROM s WHERE rn <= 3000", INV)
def batches(spark, sf):
    top = V.inventory(spark, sf).where("n_objects > 0").withColumn("k", S.seeded(5, "chip")).orderBy("k", "chip").limit(20 * 150)  # the shuffle has 20 batches of 150
    return S.ranked(top, [], ["k", "chip"]).select("chip", F.floor((F.col("rn") - 1) / 150).cast("int").alias("batch"))


@query("J22_domain_completion", ", d AS (SELECT b, m FROM (SELECT unnest(['sza_lt65', 'sza_65_70', 'sza_70_75', 'sza_gt75']) AS b), (SELECT unnest(['crowd', 'expert', 'model']) AS m)) SELECT b AS sza_bin, m AS source, count(chip) AS n, round(avg(max_rl), 6) AS mean FROM d LEFT JOIN inv ON sza_bin = b AND source = m GROUP BY ALL", INV)
def completion(spark, sf):
    s = V.inventory(spark, sf).groupBy("sza_bin", "source").agg(F.count(F.lit(1)).alias("n"), F.avg("max_rl").alias("mean"))
    domain = spark.range(1).select(F.explode(F.array(*map(F.lit, V.BINS))).alias("sza_bin")).select("sza_bin", F.explode(F.array(*map(F.lit, ("crowd", "expert", "model")))).alias("source"))
    return M.completed(s, domain, ["n"])


@query("A65_dataset_comparability", SPLIT + ", l1 AS (SELECT split AS g, CAST(chip AS VARCHAR) AS ln FROM sp), l2 AS (SELECT split AS g, CAST(chip AS VARCHAR) AS ln FROM sp WHERE split <> 'train' OR n_objects > 0), " + IDENTITY.format(name="v", source="l1") + ", " + IDENTITY.format(name="w", source="l2") + " SELECT v.g AS split, v.hash = w.hash AS unchanged, (SELECT count(*) FROM l1 WHERE l1.g = v.g) - (SELECT count(*) FROM l2 WHERE l2.g = v.g) AS removed FROM v JOIN w USING (g)", INV)
def comparability(spark, sf):
    s = materialise(_split(spark, sf))
    h = lambda d: S.identity_hash(d, ["split"], F.col("chip").cast("string")).join(d.groupBy("split").agg(F.count(F.lit(1)).alias("n")), "split")
    a, b = h(s), h(s.where("split <> 'train' or n_objects > 0")).toDF("split", "g", "m")
    return a.join(b, "split").select("split", (F.col("hash") == F.col("g")).alias("unchanged"), (F.col("n") - F.col("m")).alias("removed"))


@query("P27_positive_only_training", SPLIT + " SELECT chip, split FROM sp WHERE split <> 'train' OR n_objects > 0", INV)
def positive_only(spark, sf):
    return _split(spark, sf).where("split <> 'train' or n_objects > 0").select("chip", "split")


@query("J1_positional_join", SPLIT + ", m AS (SELECT chip, split, row_number() OVER (PARTITION BY split ORDER BY chip) - 1 AS pos, max_rl FROM sp), l AS (SELECT split, row_number() OVER (PARTITION BY split ORDER BY chip) - 1 AS pos, chip AS log_chip FROM sp) SELECT split, pos, log_chip, round(max_rl, 6) AS max_rl FROM m JOIN l USING (split, pos)", INV)
def positional(spark, sf):
    s = materialise(_split(spark, sf))
    place = lambda df: S.with_positions(df, "split", "chip").withColumnRenamed("position", "pos")
    masks, log = place(s.select("split", "chip", "max_rl")).select("split", "pos", "max_rl"), place(s.select("split", "chip")).select("split", "pos", F.col("chip").alias("log_chip"))
    return S.positional_join(masks, log, "split").select("split", "pos", "log_chip", "max_rl")
