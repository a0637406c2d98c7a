"""Queries over names, labelling records, weather, geometry, catalogues and training logs."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import geometry as G
from ..operators import labelling as L
from ..operators import names as N
from ..operators import sampling as S
from ..sources import views as V
from ..sources.scratch import scratch_folder
from ..streaming import submissions as T
from .common import rounded

Q, SQL = {}, {}

NAMES = """
nm0 AS (SELECT o_orderkey AS id, o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN 'S2A' ELSE 'S2B' END || '_MSIL1C_' || strftime(DATE '2019-01-01' + CAST(o_orderkey % 1500 AS INT), '%Y%m%d') || 'T' || lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || '3012_N0500_R' || lpad(CAST(o_orderkey % 143 AS VARCHAR), 3, '0') || '_T' || ['25WER', '24VWQ', '22WEA', '99XXX'][o_custkey % 4 + 1] || '_X' AS st FROM orders),
nm AS (SELECT id, st || CASE WHEN id % 17 = 0 THEN '' ELSE '_r' || lpad(CAST(id % 40 * 256 AS VARCHAR), 4, '0') || '_c' || lpad(CAST(id % 37 * 256 AS VARCHAR), 4, '0') END || CASE WHEN id % 19 = 0 THEN '_png.rf.0123456789abcdef0123456789abcdef' ELSE '' END || '.tif' AS name FROM nm0),
ns AS (SELECT id, name, regexp_replace(regexp_replace(name, '_png\\.rf\\.[0-9a-f]{32}', ''), '\\.tif$', '') AS s FROM nm),
np AS (SELECT *, coalesce(nullif(regexp_extract(s, '^(.*)_r(\\d+)_c(\\d+)$', 1), ''), s) AS stem, TRY_CAST(nullif(regexp_extract(s, '^(.*)_r(\\d+)_c(\\d+)$', 2), '') AS INT) AS "row", TRY_CAST(nullif(regexp_extract(s, '^(.*)_r(\\d+)_c(\\d+)$', 3), '') AS INT) AS col FROM ns),
sc AS (SELECT *, nullif(regexp_extract(s, '^(S2[AB])_', 1), '') AS satellite, strptime(regexp_extract(s, '_(\\d{8})T', 1) || regexp_extract(s, '_\\d{8}T(\\d{6})_', 1), '%Y%m%d%H%M%S') AS acquired, CAST(regexp_extract(s, '_R(\\d{3})_', 1) AS INT) AS orbit, regexp_extract(s, '_T(\\d{2}[A-Z]{3})_', 1) AS tile FROM np),
rg AS (SELECT *, CASE tile WHEN '25WER' THEN 'KQ' WHEN '24VWQ' THEN 'SK' WHEN '22WEA' THEN 'SK' ELSE 'unknown' END AS region FROM sc)""".replace("\\\\", "\\")

SUBS = """
sb AS (SELECT event_id, ts, event_id % 400 AS assignment, user_id AS labeler, CASE event_type WHEN 'click' THEN 'accepted' WHEN 'error' THEN 'rejected' WHEN 'purchase' THEN 'edited' WHEN 'view' THEN 'skipped' ELSE 'bogus' END AS verdict,
 list_filter([['', 'sea-ice', 'cloud', 'dark-water', 'ambiguous', '', 'land-edge', 'melange', '', 'odd', 'sea-ice'][event_id % 11 + 1], CASE WHEN event_id % 5 = 0 THEN 'dark-water' ELSE '' END], lambda x: x <> '') AS tags FROM events),
ge AS (SELECT event_id, assignment, 1 AS k, CAST(event_id % 8 + 1 AS INT) AS prediction, ['accepted', 'rejected', 'modified', 'modified'][event_id % 4 + 1] AS action, CASE WHEN event_id % 41 = 0 THEN 'ship' ELSE 'iceberg' END AS class, event_id % 7 AS side FROM sb WHERE verdict = 'edited'
 UNION ALL SELECT event_id, assignment, 2, CASE WHEN event_id % 3 > 0 THEN CAST(event_id % 5 + 1 AS INT) END, CASE WHEN event_id % 3 = 0 THEN 'added' WHEN event_id % 31 = 1 THEN 'moved' ELSE 'accepted' END, 'iceberg', event_id % 11 FROM sb WHERE verdict = 'edited'),
pd AS (SELECT DISTINCT l_orderkey % 400 AS assignment, CAST(l_linenumber AS INT) AS prediction FROM lineitem),
ft AS (SELECT event_id, arg_min(why, k) AS why FROM (SELECT event_id, k, CASE WHEN action NOT IN ('accepted', 'rejected', 'added', 'modified') THEN 'bad_action' WHEN class NOT IN ('iceberg') THEN 'bad_class' WHEN ge.prediction IS NOT NULL AND pd.prediction IS NULL THEN 'orphan' END AS why FROM ge LEFT JOIN pd ON pd.assignment = ge.assignment AND pd.prediction = ge.prediction) WHERE why IS NOT NULL GROUP BY event_id),
ck AS (SELECT sb.*, CASE WHEN verdict NOT IN ('accepted', 'rejected', 'edited', 'skipped') THEN 'bad_verdict' WHEN why IS NOT NULL THEN why WHEN len(list_filter(tags, lambda x: x NOT IN ('sea-ice', 'ambiguous', 'cloud', 'land-edge', 'melange', 'dark-water'))) > 0 THEN 'bad_tag' END AS bad FROM sb LEFT JOIN ft USING (event_id)),
ac AS (SELECT assignment, ts AS t0, event_id AS e0 FROM (SELECT *, row_number() OVER (PARTITION BY assignment ORDER BY ts, event_id) AS rn FROM ck WHERE bad IS NULL) WHERE rn = 1),
stt AS (SELECT ck.*, CASE WHEN event_id = e0 THEN 'accepted' WHEN ts > t0 OR (ts = t0 AND event_id > e0) THEN 'conflict' ELSE bad END AS status FROM ck LEFT JOIN ac USING (assignment))"""


def query(name: str, sql: str | None = None, views: str = ""):
    def put(f):
        Q[name] = lambda spark, sf: rounded(f(spark, sf))
        if sql:
            SQL[name] = ("WITH RECURSIVE " + views.strip() + sql.removeprefix("" if views else ",")) if views or sql.startswith(",") else sql
        return f

    return put


def _parts(spark, sf):
    n = V.scene_names(spark, sf).withColumn("s", N.without_suffix(F.col("name")))
    return n.withColumn("p", N.chip_parts(F.col("s"))).select("id", "name", "s", "p.stem", "p.row", "p.col")


def _scenes(spark, sf):
    n = _parts(spark, sf).withColumn("q", N.scene_parts(F.col("s")))
    return n.select("*", "q.satellite", "q.acquired", "q.orbit", "q.tile").drop("q").withColumn("region", N.region_of(F.col("tile")))


@query("P1_parse_chip_name", ' SELECT id, stem, "row", col FROM np', NAMES)
def parse_chip(spark, sf):
    return _parts(spark, sf).select("id", "stem", "row", "col")


@query("P2_strip_export_suffix", " SELECT id, s FROM ns", NAMES)
def strip_suffix(spark, sf):
    return _parts(spark, sf).select("id", "s")


@query("P3_chip_key", " SELECT id, CASE WHEN \"row\" IS NULL THEN 'null_' || stem ELSE printf('%s_r%04d_c%04d', stem, \"row\", col) END AS key FROM np", NAMES)
def chip_key(spark, sf):
    return _parts(spark, sf).select("id", N.chip_key(F.col("stem"), F.col("row"), F.col("col")).alias("key"))


@query("P4_parse_scene", " SELECT id, satellite, strftime(acquired, '%Y-%m-%d %H:%M:%S') AS acquired, CAST(hour(acquired) AS INT) AS hour, orbit, tile FROM sc", NAMES)
def parse_scene(spark, sf):
    return _scenes(spark, sf).select("id", "satellite", F.date_format("acquired", "yyyy-MM-dd HH:mm:ss").alias("acquired"), F.hour("acquired").alias("hour"), "orbit", "tile")


@query("P5_tile_region", " SELECT region, count(*) AS n FROM rg GROUP BY region", NAMES)
def tile_region(spark, sf):
    return _scenes(spark, sf).groupBy("region").agg(F.count(F.lit(1)).alias("n"))


ANG = ", an AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN '?' ELSE CAST(55 + o_orderkey % 30 AS VARCHAR) END AS sza, ['sza_lt65', 'sza_65_70', 'sza_70_75', 'sza_gt75'][o_custkey % 4 + 1] AS stored FROM orders), bn AS (SELECT *, CASE WHEN TRY_CAST(sza AS DOUBLE) IS NULL THEN 'sza_unknown' WHEN TRY_CAST(sza AS DOUBLE) < 65 THEN 'sza_lt65' WHEN TRY_CAST(sza AS DOUBLE) < 70 THEN 'sza_65_70' WHEN TRY_CAST(sza AS DOUBLE) < 75 THEN 'sza_70_75' ELSE 'sza_gt75' END AS bin FROM an)"


def _angles(spark, sf):
    o = V.table(spark, sf, "orders")
    sza = F.when(F.col("o_orderkey") % 11 == 0, "?").otherwise((55 + F.col("o_orderkey") % 30).cast("string"))
    return o.select(F.col("o_orderkey").alias("id"), sza.alias("sza"), V.bin_of("o_custkey").alias("stored")).withColumn("bin", N.sza_bin(F.col("sza")))


@query("P6_sza_bin", ANG + " SELECT id, bin FROM bn")
def sza_bins(spark, sf):
    return _angles(spark, sf).select("id", "bin")


@query("P7_month_estimate", " SELECT id, coalesce(CAST(MAP {3: 75, 4: 67, 5: 60, 6: 57, 7: 58, 8: 63, 9: 71, 10: 79}[month(acquired)] AS VARCHAR), '?') AS sza FROM sc", NAMES)
def month_estimate(spark, sf):
    table = F.create_map(*[F.lit(x) for kv in {3: "75", 4: "67", 5: "60", 6: "57", 7: "58", 8: "63", 9: "71", 10: "79"}.items() for x in kv])
    return _scenes(spark, sf).select("id", F.coalesce(table[F.month("acquired")], F.lit("?")).alias("sza"))


@query("P8_rebin_audit", ANG + " SELECT CASE WHEN bin = 'sza_unknown' THEN 'error' WHEN bin = stored THEN 'keep' ELSE 'move' END AS outcome, count(*) AS n FROM bn GROUP BY outcome")
def rebin(spark, sf):
    outcome = F.when(F.col("bin") == "sza_unknown", "error").when(F.col("bin") == F.col("stored"), "keep").otherwise("move")
    return _angles(spark, sf).groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


SUN = ", t AS (SELECT id, epoch(acquired) / 86400.0::DOUBLE - 10957.5 AS n, 60.0 + id % 20 AS lat, -50.0 + id % 30 AS lon FROM sc), a AS (SELECT *, radians((((357.528::DOUBLE + 0.9856003::DOUBLE * n) % 360) + 360) % 360) AS g FROM t), b AS (SELECT *, radians(((((280.460::DOUBLE + 0.9856474::DOUBLE * n) % 360) + 360) % 360) + 1.915::DOUBLE * sin(g) + 0.020::DOUBLE * sin(2 * g)) AS l, radians(23.439::DOUBLE - 0.0000004::DOUBLE * n) AS e, radians((((280.46061837::DOUBLE + 360.98564736629::DOUBLE * n + lon) % 360) + 360) % 360) AS sd FROM a), c AS (SELECT *, atan2(cos(e) * sin(l), cos(l)) AS ra, asin(sin(e) * sin(l)) AS de FROM b)"


@query("P9_solar_zenith", SUN + " SELECT id, round(degrees(acos(greatest(-1, least(1, sin(radians(lat)) * sin(de) + cos(radians(lat)) * cos(de) * cos(sd - ra))))), 4) AS zenith FROM c", NAMES)
def zenith(spark, sf):
    s = _scenes(spark, sf)
    z = N.solar_zenith(F.col("acquired"), (F.lit(60.0) + F.col("id") % 20), (F.lit(-50.0) + F.col("id") % 30))
    return s.select("id", F.round(z, 4).alias("zenith"))


@query("S10_region_from_path", " SELECT id, coalesce(list_filter(string_split('data/' || region || '/' || CASE WHEN id % 3 = 0 THEN 'sza_lt65' ELSE 'other' END || '/' || name, '/'), lambda x: list_contains(['sza_lt65', 'sza_65_70', 'sza_70_75', 'sza_gt75'], x))[1], 'unknown') AS bin FROM rg", NAMES)
def from_path(spark, sf):
    p = F.concat_ws("/", F.lit("data"), "region", F.when(F.col("id") % 3 == 0, "sza_lt65").otherwise("other"), "name")
    return _scenes(spark, sf).select("id", F.coalesce(F.get(F.array_intersect(F.split(p, "/"), F.array(*map(F.lit, V.BINS))), F.lit(0)), F.lit("unknown")).alias("bin"))


@query("S11_basename_index", " SELECT stem, max(id) AS id FROM np GROUP BY stem", NAMES)
def basename(spark, sf):
    """Stem to the last path that has it."""
    rows = _parts(spark, sf)
    last = rows.withColumn("rn", F.row_number().over(W.partitionBy("stem").orderBy(F.desc("id")))).where("rn = 1")
    return last.select("stem", "id")


@query("J21_prefix_lookup", ", ct AS (SELECT DISTINCT left(s, 19) AS pre, min(id) OVER (PARTITION BY left(s, 19)) AS first FROM np WHERE id % 5 > 0) SELECT id, first, CASE WHEN first IS NULL THEN 'KQ' ELSE 'found' END AS region FROM np LEFT JOIN ct ON pre = left(s, 19)", NAMES)
def prefix_lookup(spark, sf):
    rows = _parts(spark, sf).withColumn("pre", F.substring("s", 1, 19))
    table = rows.where("id % 5 > 0").groupBy("pre").agg(F.min("id").alias("first"))
    return rows.join(table, "pre", "left").select("id", "first", F.when(F.col("first").isNull(), "KQ").otherwise("found").alias("region"))


@query("A32_chips_by_month", " SELECT CAST(month(acquired) AS INT) AS month, count(*) FILTER (region = 'KQ') AS \"KQ\", count(*) FILTER (region = 'SK') AS \"SK\" FROM rg GROUP BY ALL", NAMES)
def by_month(spark, sf):
    return _scenes(spark, sf).groupBy(F.month("acquired").alias("month")).pivot("region", ["KQ", "SK"]).count().na.fill(0)


@query("A55_catalogue_counts", " SELECT region, satellite, count(*) AS n, sum(length(name))::BIGINT AS size FROM rg GROUP BY ALL", NAMES)
def catalogue_counts(spark, sf):
    return _scenes(spark, sf).groupBy("region", "satellite").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("name")).alias("size"))


@query("A56_provenance_audit", " SELECT region, count(*) AS n, count(acquired) AS dated, count(\"row\") AS placed, round(avg(CAST(\"row\" IS NULL AS INT)), 6) AS share_missing FROM rg GROUP BY region", NAMES)
def provenance(spark, sf):
    return _scenes(spark, sf).groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.count("acquired").alias("dated"), F.count("row").alias("placed"), F.avg(F.col("row").isNull().cast("int")).alias("share_missing"))


@query("W15_first_by_date", ", r AS (SELECT region, id, row_number() OVER (PARTITION BY region, month(acquired) ORDER BY acquired, id) AS a, row_number() OVER (PARTITION BY region, month(acquired) % 4 ORDER BY acquired, id) AS b FROM rg) SELECT 'window' AS form, region, id, CAST(a AS INT) AS rank FROM r WHERE a <= 5 UNION ALL SELECT 'bin', region, id, CAST(b AS INT) FROM r WHERE b <= 30", NAMES)
def first_by_date(spark, sf):
    """The first 5 of each region and window (month), and the first 30 of each region and bin."""
    s = _scenes(spark, sf).withColumn("month", F.month("acquired"))
    first = lambda by, most, form: S.first_by(s, ["region", by], ["acquired", "id"], most).select(F.lit(form).alias("form"), "region", "id", "rank")
    s = s.withColumn("bin", F.col("month") % 4)
    return first("month", 5, "window").unionByName(first("bin", 30, "bin"))


@query("W16_dedupe_keep_first", " SELECT stem, min(id) AS id FROM np GROUP BY stem", NAMES)
def keep_first(spark, sf):
    return _parts(spark, sf).groupBy("stem").agg(F.min("id").alias("id"))


@query("W13_running_position", " SELECT id, row_number() OVER (PARTITION BY tile ORDER BY id) - 1 AS position FROM sc", NAMES)
def running_position(spark, sf):
    return S.with_positions(_scenes(spark, sf).select("id", "tile"), "tile", "id").select("id", "position")


@query("P23_catalogue_selection", ", wi(w, m0, m1) AS (VALUES ('spring', 3, 5), ('autumn', 9, 10)) SELECT id, w FROM rg JOIN wi ON month(acquired) BETWEEN m0 AND m1 WHERE region <> 'unknown' AND id % 100 <= 20", NAMES)
def selection(spark, sf):
    win = spark.createDataFrame([("spring", 3, 5), ("autumn", 9, 10)], "w string, m0 int, m1 int")
    s = _scenes(spark, sf).where("region <> 'unknown' and id % 100 <= 20")  # cloud cover of 20 percent at most
    return s.join(F.broadcast(win), F.month("acquired").between(F.col("m0"), F.col("m1"))).select("id", "w")


def _checked(spark, sf):
    return L.checked(V.submissions(spark, sf), V.predictions(spark, sf))


@query("P24_submission_checks", " SELECT event_id, status FROM stt", SUBS)
def checks(spark, sf):
    return _checked(spark, sf).select("event_id", "status")


@query("A47_verdict_totals", " SELECT verdict, status, count(*) AS n FROM stt GROUP BY GROUPING SETS ((verdict), (status))", SUBS)
def verdict_totals(spark, sf):
    return _checked(spark, sf).groupingSets([["verdict"], ["status"]], "verdict", "status").agg(F.count(F.lit(1)).alias("n"))


@query("A45_labeler_progress", ", al AS (SELECT DISTINCT user_id AS labeler, event_id % 400 AS assignment FROM events) SELECT al.labeler, count(*) AS n_assigned, count(s.event_id) AS n_done, round(100.0 * count(s.event_id) / count(*), 6) AS pct FROM al LEFT JOIN stt s ON s.status = 'accepted' AND s.labeler = al.labeler AND s.assignment = al.assignment GROUP BY al.labeler", SUBS)
def labeler_progress(spark, sf):
    s = V.submissions(spark, sf)
    done = _checked(spark, sf).where("status = 'accepted'").select("labeler", "assignment", F.lit(1).alias("d"))
    out = s.select("labeler", "assignment").distinct().join(done, ["labeler", "assignment"], "left").groupBy("labeler").agg(F.count(F.lit(1)).alias("n_assigned"), F.count("d").alias("n_done"))
    return out.withColumn("pct", F.col("n_done") / F.col("n_assigned") * 100)


EXP = ", rs AS (SELECT * FROM stt WHERE status = 'accepted'), de AS (SELECT assignment, event_id, prediction, verdict AS action, (assignment + prediction) % 9 AS side FROM rs JOIN pd USING (assignment) WHERE verdict IN ('accepted', 'rejected') UNION ALL SELECT rs.assignment, event_id, prediction, action, side FROM rs JOIN ge USING (event_id) WHERE verdict = 'edited')"


def _results(spark, sf):
    return _checked(spark, sf).where("status = 'accepted'").select(F.col("assignment").alias("chip"), "event_id", "verdict", "labeler", "tags", "edits")


def _decisions(spark, sf):
    return L.decisions(_results(spark, sf), V.predictions(spark, sf))


@query("P25_verdict_expansion", EXP + " SELECT assignment AS chip, prediction, action FROM de", SUBS)
def expansion(spark, sf):
    return _decisions(spark, sf).select("chip", "prediction", "action")


@query("A46_action_counts", EXP + " SELECT assignment AS chip, count(*) FILTER (action = 'accepted') AS accepted, count(*) FILTER (action = 'rejected') AS rejected, count(*) FILTER (action = 'added') AS added, count(*) FILTER (action = 'modified') AS modified FROM de GROUP BY ALL", SUBS)
def action_counts(spark, sf):
    return _decisions(spark, sf).groupBy("chip").pivot("action", list(L.ACTIONS)).count().na.fill(0)


@query("P26_reference_filter", EXP + ", kr AS (SELECT * FROM rs WHERE verdict IN ('accepted', 'edited')), gone AS (SELECT DISTINCT assignment % 100 AS scene FROM kr WHERE len(list_filter(tags, lambda x: x IN ('cloud', 'ambiguous', 'land-edge', 'melange'))) > 0) SELECT assignment AS chip, prediction, action, round(10.0 * side, 6) AS root_length FROM de WHERE event_id IN (SELECT event_id FROM kr) AND action IN ('accepted', 'added', 'modified') AND assignment % 100 NOT IN (SELECT scene FROM gone) AND side * 10 >= 40", SUBS)
def reference_filter(spark, sf):
    """Four assignments show one scene: a tag that drops on any of its kept results drops the scene."""
    scene = (F.col("chip") % 100).alias("scene")
    results = _results(spark, sf)
    decided = L.decisions(results, V.predictions(spark, sf))
    return L.reference_objects(results.select("*", scene), decided.select("*", scene), fold="scene").select("chip", "prediction", "action", "root_length")


@query("J20_results_assignments", ", rs AS (SELECT * FROM stt WHERE status = 'accepted') SELECT rs.assignment, c_custkey, c_nationkey, verdict FROM rs JOIN customer ON c_custkey = rs.assignment JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey < 3", SUBS)
def results(spark, sf):
    r = _checked(spark, sf).where("status = 'accepted'")
    c, n = V.table(spark, sf, "customer"), V.table(spark, sf, "nation").where("n_regionkey < 3")
    return r.join(c, r.assignment == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select("assignment", "c_custkey", "c_nationkey", "verdict")


@query("A52_labeler_agreement", ", v AS (SELECT DISTINCT assignment, labeler, first_value(verdict) OVER (PARTITION BY assignment, labeler ORDER BY ts, event_id) AS verdict FROM ck WHERE bad IS NULL) SELECT a.assignment % 20 AS grp, count(*) AS n, round(avg(CAST(a.verdict = b.verdict AS INT)), 6) AS agree FROM v a JOIN v b ON a.assignment = b.assignment AND a.labeler < b.labeler GROUP BY ALL", SUBS)
def agreement(spark, sf):
    s = _checked(spark, sf).where("bad is null")
    v = s.groupBy("assignment", "labeler").agg(F.min_by("verdict", F.struct("ts", "event_id")).alias("verdict"))
    n = v.groupBy("assignment", "verdict").agg(F.count(F.lit(1)).alias("c"))  # equal pairs come from counts, not from pairs
    t = n.groupBy("assignment").agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("same"), F.sum("c").alias("all"))
    g = t.groupBy((F.col("assignment") % 20).alias("grp")).agg(F.sum("same").alias("same"), F.sum(F.col("all") * (F.col("all") - 1) / 2).alias("pairs")).where("pairs > 0")
    return g.select("grp", F.col("pairs").cast("long").alias("n"), (F.col("same") / F.col("pairs")).alias("agree"))


@query("W17_round_robin", ", un AS (SELECT c_custkey AS chip FROM customer WHERE c_custkey NOT IN (SELECT assignment FROM stt WHERE status = 'accepted')), lb AS (SELECT user_id AS labeler, row_number() OVER (ORDER BY user_id) - 1 AS slot FROM (SELECT DISTINCT user_id FROM events)) SELECT chip, labeler FROM (SELECT chip, (row_number() OVER (ORDER BY md5(CAST(chip AS VARCHAR)), chip) - 1) % (SELECT count(*) FROM lb) AS slot FROM un) JOIN lb USING (slot)", SUBS)
def round_robin(spark, sf):
    s = V.submissions(spark, sf)
    taken = _checked(spark, sf).where("status = 'accepted'").select(F.col("assignment").alias("chip"))
    free = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("chip")).join(taken, "chip", "left_anti")
    return L.spread(free, s.select("labeler").distinct(), F.md5(F.col("chip").cast("string").cast("binary")))


@query("W18_priority_assignment", ", n AS (SELECT c_custkey AS chip, count(event_id) AS k FROM customer LEFT JOIN sb ON assignment = c_custkey GROUP BY ALL) SELECT chip, k FROM n WHERE chip NOT IN (SELECT assignment FROM sb WHERE labeler = 7) ORDER BY k, chip LIMIT 25", SUBS)
def priority(spark, sf):
    s = V.submissions(spark, sf)
    k = s.groupBy(F.col("assignment").alias("chip")).agg(F.count(F.lit(1)).alias("k"))
    c = V.table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("chip")).join(k, "chip", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    held = s.where("labeler = 7").select(F.col("assignment").alias("chip"))
    return c.join(held, "chip", "left_anti").orderBy("k", "chip").limit(25)  # one labeler's next 25 chips


@query("W19_next_pending", " SELECT labeler, arg_min(assignment, (ts, event_id)) AS assignment FROM stt WHERE status = 'conflict' GROUP BY labeler", SUBS)
def next_pending(spark, sf):
    return _checked(spark, sf).where("status = 'conflict'").groupBy("labeler").agg(F.min_by("assignment", F.struct("ts", "event_id")).alias("assignment"))


@query("U3_unassigned", " SELECT c_custkey AS chip FROM customer WHERE c_custkey NOT IN (SELECT assignment FROM sb)", SUBS)
def unassigned(spark, sf):
    taken = V.submissions(spark, sf).select(F.col("assignment").alias("chip"))
    return V.table(spark, sf, "customer").select(F.col("c_custkey").alias("chip")).join(taken, "chip", "left_anti")


@query("T1_first_submission_stream", ", g AS (SELECT assignment, count(*) AS n, count(*) FILTER (bad IS NULL) AS n_good FROM ck GROUP BY ALL) SELECT g.assignment, e0 AS winner, verdict, labeler, CASE WHEN e0 IS NULL THEN 'pending' ELSE 'complete' END AS status, n, n_good FROM g LEFT JOIN ac USING (assignment) LEFT JOIN sb ON event_id = e0", SUBS)
def submission_stream(spark, sf):
    stream = T.standing(V.submissions(_Streaming(spark), sf), V.predictions(spark, sf))
    return T.run_available(stream, scratch_folder(spark, "streams"), "complete")


@query("T2_progress_stream", ", d AS (SELECT date_trunc('day', ts) AS day, labeler, verdict FROM sb) SELECT strftime(day, '%Y-%m-%d') AS day, labeler, count(*) AS n, count(*) FILTER (verdict = 'accepted') AS n_accepted FROM d GROUP BY ALL", SUBS)
def progress_stream(spark, sf):
    stream = T.progress(V.submissions(_Streaming(spark), sf))
    out = T.run_available(stream, scratch_folder(spark, "streams"), "complete")
    return out.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "labeler", "n", "n_accepted")


class _Streaming:
    """Stands for a session whose table reads are streams, so that batch views serve streams unchanged."""

    def __init__(self, spark):
        self._spark = spark
        self.read = self

    def parquet(self, path):
        return T.source(self._spark, path.rpartition("/")[0])


WX = """
wx AS (SELECT user_id % 2 AS region, date_trunc('hour', ts) AS h, avg(value) / 5 AS wind, avg(CAST(event_id % 100 AS DOUBLE)) - 50 AS temp FROM events GROUP BY ALL),
aq AS (SELECT o_orderkey AS id, o_custkey % 2 AS region, (SELECT min(date_trunc('day', ts)) FROM events) + to_hours(CAST(o_orderkey % 720 AS INT)) AS tm FROM orders)"""


def _weather(spark, sf):
    e = V.table(spark, sf, "events")
    return e.groupBy((F.col("user_id") % 2).alias("region"), F.date_trunc("hour", "ts").alias("h")).agg((F.avg("value") / 5).alias("wind"), (F.avg((F.col("event_id") % 100).cast("double")) - 50).alias("temp"))


def _acquired(spark, sf):
    day = V.table(spark, sf, "events").agg(F.min(F.date_trunc("day", "ts")).alias("d0"))
    o = V.table(spark, sf, "orders").join(F.broadcast(day))
    return o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 2).alias("region"), F.timestamp_add("HOUR", (F.col("o_orderkey") % 720).cast("int"), F.col("d0")).alias("at"))


@query("J2_weather_join", " SELECT id, round(wind, 6) AS wind, round(temp, 6) AS temp FROM aq LEFT JOIN wx ON wx.region = aq.region AND wx.h = aq.tm", WX)
def weather_join(spark, sf):
    return _acquired(spark, sf).join(_weather(spark, sf).withColumnRenamed("h", "at"), ["region", "at"], "left").select("id", "wind", "temp")


#: Fixed value: the strongest wind (m/s) that passes.
MAX_WIND = 15.0
FLAGS = ", fl AS (SELECT id, aq.region, wind <= 15 AS pass_wind, temp > 0 AS pass_temp FROM aq LEFT JOIN wx ON wx.region = aq.region AND wx.h = aq.tm)"


@query("P22_weather_flags", FLAGS + " SELECT id, pass_wind, pass_temp, CASE WHEN pass_wind IS NULL OR pass_temp IS NULL THEN NULL ELSE pass_wind AND pass_temp END AS pass_both FROM fl", WX)
def weather_flags(spark, sf):
    w = _acquired(spark, sf).join(_weather(spark, sf).withColumnRenamed("h", "at"), ["region", "at"], "left")
    w = w.select("id", "region", (F.col("wind") <= MAX_WIND).alias("pass_wind"), (F.col("temp") > 0).alias("pass_temp"))
    both = F.when(F.col("pass_wind").isNotNull() & F.col("pass_temp").isNotNull(), F.col("pass_wind") & F.col("pass_temp"))
    return w.select("id", "pass_wind", "pass_temp", both.alias("pass_both"))


@query("A28_weather_counts", FLAGS + " SELECT count(*) FILTER (pass_wind) AS n_wind, count(*) FILTER (pass_temp) AS n_temp, count(*) FILTER (pass_wind AND pass_temp) AS n_both, count(*) FILTER (pass_wind AND NOT pass_temp) AS wind_only, count(*) FILTER (pass_wind IS NULL) AS unknown FROM fl", WX)
def weather_counts(spark, sf):
    w = weather_flags(spark, sf)
    return w.agg(F.count_if("pass_wind").alias("n_wind"), F.count_if("pass_temp").alias("n_temp"), F.count_if("pass_both").alias("n_both"), F.count_if(F.col("pass_wind") & ~F.col("pass_temp")).alias("wind_only"), F.count_if(F.col("pass_wind").isNull()).alias("unknown"))


@query("J11_nearest_hour", ", c AS (SELECT id, h, wind, abs(epoch(h) - epoch(tm)) AS d FROM aq JOIN wx ON wx.region = aq.region AND date_trunc('day', h) = date_trunc('day', tm)) SELECT id, round(first(wind ORDER BY d, h), 6) AS wind FROM c GROUP BY id", WX)
def nearest_hour(spark, sf):
    w = _weather(spark, sf).withColumn("day", F.to_date("h"))
    a = _acquired(spark, sf).withColumn("day", F.to_date("at")).join(w, ["region", "day"])
    return a.groupBy("id").agg(F.min_by("wind", F.struct(F.abs(F.unix_timestamp("h") - F.unix_timestamp("at")), "h")).alias("wind"))


@query("J24_scene_fan_out", ", s AS (SELECT DISTINCT region, tm FROM aq), v AS (SELECT s.region, s.tm, wx.wind FROM s LEFT JOIN wx ON wx.region = s.region AND wx.h = s.tm) SELECT id, round(v.wind, 6) AS wind FROM aq LEFT JOIN v ON v.region = aq.region AND v.tm = aq.tm", WX)
def fan_out(spark, sf):
    a = _acquired(spark, sf)
    once = a.select("region", "at").distinct().join(_weather(spark, sf).withColumnRenamed("h", "at"), ["region", "at"], "left")
    return a.join(once, ["region", "at"], "left").select("id", "wind")


RING = ", rr AS (SELECT c_custkey AS grid, CAST(c_custkey % 40 AS DOUBLE) AS x, CAST(c_nationkey AS DOUBLE) AS y, 3.0::DOUBLE + c_custkey % 7 AS k FROM customer WHERE c_custkey % 10 > 0)"


def _rings(spark, sf):
    c = V.table(spark, sf, "customer")
    x, y, k = (F.col("c_custkey") % 40).cast("double"), F.col("c_nationkey").cast("double"), F.lit(3.0) + F.col("c_custkey") % 7
    quad = F.array(*[v.cast("string") for v in (x, y, x + k, y, x + k, y + k, x, y + k)])
    coords = F.when(F.col("c_custkey") % 10 == 0, F.slice(quad, 1, 4)).otherwise(quad)
    return c.select(F.col("c_custkey").cast("long").alias("grid"), coords.alias("coords")).withColumn("ring", G.ring_from(F.col("coords")))


@query("P29_malformed_segmentation", " SELECT c_custkey % 10 = 0 AS dropped, count(*) AS n FROM customer GROUP BY ALL")
def malformed(spark, sf):
    return _rings(spark, sf).groupBy(F.col("ring").isNull().alias("dropped")).agg(F.count(F.lit(1)).alias("n"))


@query("A48_ring_area_bbox", RING + " SELECT grid, round(k * k, 6) AS area, round(x, 6) AS x0, round(x + k, 6) AS x1, round(y, 6) AS y0, round(y + k, 6) AS y1 FROM rr")
def ring_area(spark, sf):
    r = _rings(spark, sf).where("ring is not null")
    return r.select("grid", G.ring_area(F.col("ring")).alias("area"), G.ring_box(F.col("ring")).alias("b")).select("grid", "area", "b.*")


@query("J14_ring_to_pixels", RING + " SELECT grid, CAST(sum(least(x + k, 48) - x) * 0 + (least(x + k, 48) - x) * (least(y + k, 32) - y) AS BIGINT) AS n FROM rr GROUP BY grid, x, y, k")
def ring_pixels(spark, sf):
    return G.rasterise(_rings(spark, sf), 32, 48).groupBy("grid").agg(F.count(F.lit(1)).alias("n"))


@query("R11_object_boundary", RING + " SELECT grid, CAST(2 * ((least(x + k, 48) - x) + (least(y + k, 32) - y)) AS BIGINT) AS edges FROM rr")
def ring_boundary(spark, sf):
    return G.boundary(G.rasterise(_rings(spark, sf), 32, 48)).groupBy("grid").agg(F.count(F.lit(1)).alias("edges"))


@query("R10_map_to_pixel", " SELECT c_custkey AS id, CAST(floor((c_custkey % 40 * 13.0 - 5) / 10) AS INT) AS col, CAST(floor((500 - c_nationkey * 17.0) / 10) AS INT) AS \"row\" FROM customer")
def map_to_pixel(spark, sf):
    c = V.table(spark, sf, "customer")
    col, row = G.to_pixel(F.col("c_custkey") % 40 * 13.0, F.col("c_nationkey") * 17.0, F.lit(5.0), F.lit(500.0), 10.0)
    return c.select(F.col("c_custkey").alias("id"), col.alias("col"), row.alias("row"))


BOX = ", bx(region, minx, maxx, miny, maxy) AS (VALUES ('KQ-1', 0, 12, 0, 12), ('KQ-2', 10, 20, 8, 20), ('SK-1', 20, 35, 0, 10), ('SK-2', 5, 30, 10, 24)), hits AS (SELECT c_custkey AS id, region FROM customer JOIN bx ON c_custkey % 40 BETWEEN minx AND maxx AND c_nationkey BETWEEN miny AND maxy)"


@query("J10_point_in_box", BOX + " SELECT id, string_agg(DISTINCT left(region, 2), ',' ORDER BY left(region, 2)) AS regions FROM hits GROUP BY id")
def point_in_box(spark, sf):
    boxes = spark.createDataFrame([("KQ-1", 0, 12, 0, 12), ("KQ-2", 10, 20, 8, 20), ("SK-1", 20, 35, 0, 10), ("SK-2", 5, 30, 10, 24)], "region string, minx int, maxx int, miny int, maxy int")
    pts = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 40).alias("x"), F.col("c_nationkey").alias("y"))
    hit = G.in_boxes(pts, boxes).groupBy("id").agg(F.array_sort(F.collect_list("region")).alias("r"))
    return hit.select("id", F.array_join(F.array_distinct(F.transform("r", lambda r: F.split(r, "-")[0])), ",").alias("regions"))


RUN = ", rn AS (SELECT o_custkey % 10 AS run, o_orderkey % 100 AS epoch, max((o_totalprice::DOUBLE % 1000) / 1000) AS val_iou FROM orders GROUP BY ALL)"


def _runs(spark, sf):
    o = V.table(spark, sf, "orders")
    return o.groupBy((F.col("o_custkey") % 10).alias("run"), (F.col("o_orderkey") % 100).alias("epoch")).agg(F.max((F.col("o_totalprice").cast("double") % 1000) / 1000).alias("val_iou"))


@query("A49_best_last_epoch", RUN + " SELECT run, first(epoch ORDER BY val_iou DESC, epoch) AS best_epoch, round(max(val_iou), 6) AS best, max(epoch) AS last_epoch, round(arg_max(val_iou, epoch), 6) AS last FROM rn GROUP BY run")
def best_epoch(spark, sf):
    return _runs(spark, sf).groupBy("run").agg(F.max_by("epoch", F.struct(F.col("val_iou"), -F.col("epoch"))).alias("best_epoch"), F.max("val_iou").alias("best"), F.max("epoch").alias("last_epoch"), F.max_by("val_iou", "epoch").alias("last"))


@query("A61_run_leaderboard", RUN + ", l AS (SELECT run % 5 AS experiment, run, max(val_iou) AS v FROM rn GROUP BY ALL), q AS (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY run DESC) AS k FROM l) SELECT experiment, run, round(v, 6) AS v, CAST(rank() OVER (ORDER BY v DESC) AS INT) AS place FROM q WHERE k = 1")
def leaderboard(spark, sf):
    r = _runs(spark, sf).groupBy("run").agg(F.max("val_iou").alias("v")).withColumn("experiment", F.col("run") % 5)
    latest = r.withColumn("k", F.row_number().over(W.partitionBy("experiment").orderBy(F.desc("run")))).where("k = 1")
    return latest.select("experiment", "run", "v", F.rank().over(W.partitionBy(F.lit(0)).orderBy(F.desc("v"))).alias("place"))


@query("U1_union_sources", " SELECT s, count(*) AS n, count(a) AS with_a, count(b) AS with_b FROM (SELECT 'supplier' AS s, s_nationkey AS a, NULL AS b FROM supplier UNION ALL SELECT 'customer', NULL, c_nationkey FROM customer) GROUP BY s")
def union_sources(spark, sf):
    a = V.table(spark, sf, "supplier").select(F.lit("supplier").alias("s"), F.col("s_nationkey").alias("a"))
    b = V.table(spark, sf, "customer").select(F.lit("customer").alias("s"), F.col("c_nationkey").alias("b"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.count("a").alias("with_a"), F.count("b").alias("with_b"))


@query("U2_distinct_keys", " SELECT DISTINCT region, tile FROM rg", NAMES)
def distinct_keys(spark, sf):
    return _scenes(spark, sf).select("region", "tile").distinct()


@query("U5_dataset_difference", " SELECT k, side FROM (SELECT c_custkey AS k, 'left' AS side FROM customer WHERE c_custkey % 3 > 0 AND c_custkey % 5 = 0 UNION ALL SELECT c_custkey, 'right' FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 5 > 0)")
def difference(spark, sf):
    c = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    a, b = c.where("k % 3 > 0").withColumn("l", F.lit(1)), c.where("k % 5 > 0").withColumn("r", F.lit(1))
    return a.join(b, "k", "full_outer").where("l is null or r is null").select("k", F.when(F.col("l").isNotNull(), "left").otherwise("right").alias("side"))


@query("U6_version_differences", ", a AS (SELECT c_custkey AS k, c_nationkey AS nation, CAST(round(c_acctbal) AS BIGINT) AS bal FROM customer WHERE c_custkey % 7 > 0), b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS nation, CASE WHEN c_custkey % 6 = 0 THEN 0 ELSE CAST(round(c_acctbal) AS BIGINT) END AS bal FROM customer WHERE c_custkey % 11 > 0), j AS (SELECT coalesce(a.k, b.k) AS k, a.k AS ak, b.k AS bk, a.nation AS n1, b.nation AS n2, a.bal AS b1, b.bal AS b2 FROM a FULL JOIN b ON a.k = b.k) SELECT k, 'row' AS field, CASE WHEN ak IS NULL THEN 'added' ELSE 'removed' END AS change FROM j WHERE ak IS NULL OR bk IS NULL UNION ALL SELECT k, 'nation', 'changed' FROM j WHERE n1 <> n2 UNION ALL SELECT k, 'bal', 'changed' FROM j WHERE b1 <> b2")
def version_differences(spark, sf):
    c = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nation"), F.round("c_acctbal").cast("long").alias("bal"))
    a = c.where("k % 7 > 0").withColumn("in_a", F.lit(1))
    b = c.where("k % 11 > 0").select("k", F.when(F.col("k") % 4 == 0, F.col("nation") + 1).otherwise(F.col("nation")).alias("nation2"), F.when(F.col("k") % 6 == 0, 0).otherwise(F.col("bal")).alias("bal2"), F.lit(1).alias("in_b"))
    j = a.join(b, "k", "full_outer")
    change = F.array(
        F.struct(F.lit("row").alias("field"), F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").alias("change")),
        *[F.struct(F.lit(x).alias("field"), F.when(F.col(x) != F.col(f"{x}2"), "changed").alias("change")) for x in ("nation", "bal")],
    )
    return j.select("k", F.explode(change).alias("c")).where("c.change is not null").select("k", "c.field", "c.change")
