"""Queries over nearest arrays, rings of two layers, prefixes, requests served in turn, staged gates and histograms with edges from data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates
from ..operators import raster as R
from ..operators import search as X
from ..sources import views as V
from .common import PAIRS, PX, rounded
from .raster import COMP, OTSU
from .records import NAMES, SUBS, _parts, _scenes

Q, SQL = {}, {}


def query(name: str, sql: str, views: str = ""):
    def put(f):
        Q[name] = lambda spark, sf: rounded(f(spark, sf))
        SQL[name] = "WITH RECURSIVE " + (views.strip() + sql if views else sql.lstrip(", "))
        return f

    return put


#: Arrays in millionths: each chip in three variants with a ripple; two probes for every fifth chip, some of them shifted, some too far from all.
ARRAYS = """, ar AS (SELECT vec_id AS chip, list_transform(range(64), lambda i: CAST(floor((CAST(embedding[i + 1] AS DOUBLE) + 0.5) * 1e6) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64),
tb AS (SELECT chip * 3 + k AS key, list_transform(range(64), lambda i: v[i + 1] + k * 9000 * (1 - 2 * (i % 2))) AS v FROM ar, (SELECT unnest(range(3)) AS k)),
pb AS (SELECT chip * 2 + j AS probe, list_transform(range(64), lambda i: v[i + 1] + (12000 - 2000 * j) * (1 - 2 * (i % 2)) + CASE WHEN chip % 30 = 0 THEN 50000 WHEN chip % 20 = 0 THEN 15000 ELSE 0 END) AS v FROM ar, (SELECT unnest(range(2)) AS j) WHERE chip % 5 = 0),
al AS (SELECT probe, key, list_sum(list_transform(range(64), lambda i: abs(pb.v[i + 1] - tb.v[i + 1]))) / CAST(64 AS DOUBLE) AS mae FROM pb, tb),
nr AS (SELECT probe, min(mae) AS mae, arg_min(key, (mae, key)) AS key FROM al GROUP BY probe)"""


@query("J12_competing_arrays", ARRAYS + " SELECT probe, CASE WHEN mae < 20000 THEN key END AS key, CASE WHEN mae < 20000 THEN mae END AS mae, CASE WHEN mae >= 20000 THEN 'none' WHEN probe = min(probe) OVER (PARTITION BY key, mae < 20000) THEN 'matched' ELSE 'collision' END AS status FROM nr")
def competing_arrays(spark, sf):
    c = V.chips(spark, sf).select("chip_id", F.transform("b08", lambda x: F.floor(x * 1e6)).alias("v"))
    ripple = lambda v, by, shift=0: F.transform(v, lambda x, i: x + by * (1 - 2 * (i % 2)) + shift)
    table = c.select("chip_id", "v", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).select((F.col("chip_id") * 3 + F.col("k")).alias("key"), ripple("v", F.col("k") * 9000).alias("v"))
    p = c.where("chip_id % 5 = 0").select("chip_id", "v", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("j"))
    shift = F.when(F.col("chip_id") % 30 == 0, 50000).when(F.col("chip_id") % 20 == 0, 15000).otherwise(0)
    probes = p.select((F.col("chip_id") * 2 + F.col("j")).alias("probe"), ripple("v", 12000 - 2000 * F.col("j"), shift).alias("v"))
    return X.nearest_arrays(probes, table, 20000.0)


#: Triangles, hooks and notched arrows in map coordinates, every 97th of them large; even keys are one layer, odd ones the other.
SHAPES = """, sp AS (SELECT c_custkey AS id, CAST(c_custkey * 37 % 500 AS DOUBLE) AS x, CAST(c_custkey * 53 % 300 AS DOUBLE) AS y, CAST(CASE WHEN c_custkey % 97 = 0 THEN 80 ELSE 3 + c_custkey % 7 END AS DOUBLE) AS s FROM customer),
rn AS (SELECT id, x, y, s, CASE id % 3 WHEN 0 THEN [[x, y], [x + s, y], [x, y + s]] WHEN 1 THEN [[x, y], [x + s, y], [x + s, y + s / 4], [x + s / 4, y + s / 4], [x + s / 4, y + s], [x, y + s]] ELSE [[x, y], [x + s, y + s / 2], [x, y + s], [x + s / 4, y + s / 2]] END AS p FROM sp),
eg AS (SELECT id, p[i + 1][1] AS ax, p[i + 1][2] AS ay, p[(i + 1) % len(p) + 1][1] AS bx, p[(i + 1) % len(p) + 1][2] AS by_ FROM (SELECT id, p, unnest(range(len(p))) AS i FROM rn)),
bb AS (SELECT id, min(ax) AS x0, max(ax) AS x1, min(ay) AS y0, max(ay) AS y1 FROM eg GROUP BY id),
ce AS (SELECT id, r, c FROM (SELECT id, r, unnest(range(CAST(floor(x0) AS BIGINT), CAST(ceil(x1) AS BIGINT))) AS c FROM (SELECT *, unnest(range(CAST(floor(y0) AS BIGINT), CAST(ceil(y1) AS BIGINT))) AS r FROM bb))),
ic AS (SELECT id, r, c FROM ce JOIN eg USING (id) WHERE least(ay, by_) <= r + CAST(0.5 AS DOUBLE) AND r + CAST(0.5 AS DOUBLE) < greatest(ay, by_) AND ax + (r + CAST(0.5 AS DOUBLE) - ay) * (bx - ax) / (by_ - ay) <= c + CAST(0.5 AS DOUBLE) GROUP BY ALL HAVING count(*) % 2 = 1),
nc AS (SELECT id, count(*) AS n FROM ic GROUP BY id),
th AS (SELECT a.id AS a, b.id AS b FROM bb a JOIN bb b ON a.id % 2 = 0 AND b.id % 2 = 1 AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1),
sh AS (SELECT a, b, count(*) AS shared FROM th JOIN ic p ON p.id = a JOIN ic q ON q.id = b AND q.r = p.r AND q.c = p.c GROUP BY ALL)"""


@query("J6_ring_layers", SHAPES + " SELECT th.a, th.b, coalesce(shared, 0) AS shared, coalesce(x.n, 0) AS n_a, coalesce(y.n, 0) AS n_b, round(CAST(coalesce(shared, 0) AS DOUBLE) / nullif(coalesce(x.n, 0) + coalesce(y.n, 0) - coalesce(shared, 0), 0), 6) AS iou FROM th LEFT JOIN sh USING (a, b) LEFT JOIN nc x ON x.id = th.a LEFT JOIN nc y ON y.id = th.b")
def ring_layers(spark, sf):
    k = F.col("c_custkey").cast("long")
    sp = V.table(spark, sf, "customer").select(k.alias("id"), (k * 37 % 500).cast("double").alias("x"), (k * 53 % 300).cast("double").alias("y"), F.when(k % 97 == 0, 80).otherwise(3 + k % 7).cast("double").alias("s"))
    x, y, s = F.col("x"), F.col("y"), F.col("s")
    ring = lambda *pts: F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in pts])
    tri, hook = ring((x, y), (x + s, y), (x, y + s)), ring((x, y), (x + s, y), (x + s, y + s / 4), (x + s / 4, y + s / 4), (x + s / 4, y + s), (x, y + s))
    arrow = ring((x, y), (x + s, y + s / 2), (x, y + s), (x + s / 4, y + s / 2))
    r = sp.select("id", F.when(F.col("id") % 3 == 0, tri).when(F.col("id") % 3 == 1, hook).otherwise(arrow).alias("ring"))
    return X.ring_ious(r.where("id % 2 = 0"), r.where("id % 2 = 1"), 1 << 12, 1 << 12, tile=32.0)


@query("J21_any_prefix", ", sm AS (SELECT id, CASE WHEN id % 7 = 0 THEN 'Z' ELSE '' END || left(s, CAST(12 + id % 30 AS INT)) AS stem FROM np WHERE id % 3 = 0), ds AS (SELECT DISTINCT stem FROM sm), ft AS (SELECT ds.stem, min(rg.id) AS place, arg_min(rg.region, rg.id) AS v FROM ds JOIN rg ON rg.id % 5 > 0 AND starts_with(rg.s, ds.stem) GROUP BY ds.stem) SELECT sm.id, place, coalesce(v, 'KQ') AS region FROM sm LEFT JOIN ft USING (stem)", NAMES)
def any_prefix(spark, sf):
    """Stems of thirty lengths, some the start of another; catalogue order is that of ids."""
    stem = F.concat(F.when(F.col("id") % 7 == 0, "Z").otherwise(""), F.substring(F.col("s"), F.lit(1), (12 + F.col("id") % 30).cast("int")))
    stems = _parts(spark, sf).where("id % 3 = 0").select("id", stem.alias("stem"))
    names = _scenes(spark, sf).where("id % 5 > 0").select(F.col("id").alias("place"), F.col("s").alias("name"), F.col("region").alias("value"))
    return X.first_by_prefix(stems, names, "KQ").select("id", "place", F.col("value").alias("region"))


#: Requests in turn: number, labeler, region, bin (none: any), chips wanted.
REQUESTS = [(1, 7, None, None, 25), (2, 7, "KQ", None, 30), (3, 9, "SK", None, 30), (4, 9, "KQ", "sza_lt65", 10), (5, 7, None, None, 40), (6, 11, "SK", "sza_gt75", 15), (7, 7, "KQ", "sza_70_75", 12)]


def _requests_sql() -> str:
    """One request after the other, over what was held and all that the earlier ones took."""
    parts = []
    for i, (_, lab, region, bin_, n) in enumerate(REQUESTS):
        where = "".join([f" AND region = '{region}'" if region else "", f" AND sza_bin = '{bin_}'" if bin_ else ""])
        parts.append(f"h{i} AS (SELECT labeler, chip FROM hl{''.join(f' UNION ALL SELECT {REQUESTS[j][1]}, chip FROM g{j}' for j in range(i))}), g{i} AS (SELECT ch.chip FROM ch LEFT JOIN (SELECT chip, count(*) AS k FROM h{i} GROUP BY chip) USING (chip) WHERE chip NOT IN (SELECT chip FROM h{i} WHERE labeler = {lab}){where} ORDER BY coalesce(k, 0), chip LIMIT {n})")
    return ", ".join(parts) + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT {r[0]} AS request, {r[1]}::BIGINT AS labeler, chip FROM g{i}" for i, r in enumerate(REQUESTS)) + ")"


@query("W18_request_rounds", ", ch AS (SELECT c_custkey AS chip, CASE WHEN c_custkey % 2 = 0 THEN 'KQ' ELSE 'SK' END AS region, ['sza_lt65', 'sza_65_70', 'sza_70_75', 'sza_gt75'][c_custkey % 4 + 1] AS sza_bin FROM customer), hl AS (SELECT DISTINCT labeler, assignment AS chip FROM sb), " + _requests_sql(), SUBS)
def request_rounds(spark, sf):
    k = F.col("c_custkey").cast("long")
    chips = V.table(spark, sf, "customer").select(k.alias("chip"), F.when(k % 2 == 0, "KQ").otherwise("SK").alias("region"), V.bin_of(k).alias("sza_bin"))
    held = V.submissions(spark, sf).select("labeler", F.col("assignment").alias("chip")).distinct()
    return X.assigned(spark.createDataFrame(REQUESTS, "request int, labeler long, region string, sza_bin string, n int"), chips, held)


MASK = ", mk AS (SELECT chip_id, CASE WHEN (chip_id * 13 + k * 7) % 9 < chip_id % 4 THEN 3 ELSE 4 END AS v FROM (SELECT DISTINCT chip_id FROM px), (SELECT unnest(range(16)) AS k) WHERE chip_id % 31 > 0)"


@query("P20_staged_gate", OTSU.format(src="px", least=1) + COMP.format(cond="b08 > (SELECT t FROM ot WHERE ot.chip_id = cells.chip_id)") + MASK + """,
g AS (SELECT chip_id, avg(CAST(b08 >= 0.72 AS INT)) AS ic, quantile_cont(b08, 0.95) AS p95 FROM px GROUP BY chip_id), cl AS (SELECT chip_id, avg(CAST(v & 3 > 0 AS INT)) AS cloud FROM mk GROUP BY chip_id),
cc AS (SELECT g AS chip_id, max(n) AS most FROM (SELECT g, l, count(*) AS n FROM lab GROUP BY ALL) GROUP BY g),
al AS (SELECT chip_id, ic, cloud, p95, coalesce(t, 0) AS t, most, CASE WHEN chip_id % 41 = 0 THEN 1 WHEN chip_id % 37 = 0 THEN 2 WHEN ic >= 0.08 THEN 3 WHEN chip_id % 29 = 0 THEN 4 WHEN cloud IS NULL THEN 5 WHEN cloud >= 0.3 THEN 6 WHEN p95 >= 0.72 THEN 7 WHEN coalesce(t, 0) >= 0.5 AND most >= 25 THEN 8 ELSE 9 END AS st FROM g LEFT JOIN cl USING (chip_id) LEFT JOIN ot USING (chip_id) LEFT JOIN cc USING (chip_id))
SELECT chip_id, ['skip', 'skip', 'reject', 'skip', 'skip', 'reject', 'reject', 'reject', 'accept'][st] AS decision, ['unparseable_filename', 'too_few_bands', 'ic_frac', 'no_safe_zip', 'no_qa60', 'cloud_frac', 'b08_p95', 'otsu_cc', ''][st] AS note,
 round(CASE WHEN st >= 3 THEN ic END, 6) AS ic_frac, round(CASE WHEN st >= 6 THEN cloud END, 6) AS cloud_frac, round(CASE WHEN st >= 7 THEN p95 END, 6) AS p95, round(CASE WHEN st >= 8 THEN t END, 6) AS otsu, CASE WHEN st >= 8 AND t >= 0.5 THEN most END AS max_px FROM al""", PX)  # fmt: skip
def staged_gate(spark, sf):
    k = F.col("chip_id")
    chips = V.chips(spark, sf).select(k, F.when(k % 41 > 0, k.cast("string")).alias("stem"), F.when(k % 37 == 0, 2).otherwise(3).alias("bands"), F.when(k % 29 > 0, k.cast("string")).alias("scene"))
    cell = chips.where("chip_id % 31 > 0").select("chip_id", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("k"))
    masks = cell.select("chip_id", F.when((k * 13 + F.col("k") * 7) % 9 < k % 4, 3).otherwise(4).alias("v"))
    return gates.null_chips(chips, V.pixels(V.chips(spark, sf)), masks, 0.72, 0.08, 0.3, 0.5, 25, V.SIDE)[0]


@query("A31_log_histogram", ", tp AS (SELECT max(a_pred) AS top, (log10(max(a_pred)) - log10(CAST(1600 AS DOUBLE))) / 40 AS step FROM pr), hn AS (SELECT CAST(least(floor((log10(a_pred) - log10(CAST(1600 AS DOUBLE))) / step), 39) AS INT) AS bin, count(*) AS n FROM pr, tp WHERE a_pred >= 1600 GROUP BY ALL) SELECT CAST(b AS INT) AS bin, round(power(10, log10(CAST(1600 AS DOUBLE)) + b * step), 2) AS low, round(power(10, log10(CAST(1600 AS DOUBLE)) + (b + 1) * step), 2) AS high, coalesce(n, 0) AS n FROM (SELECT unnest(range(40)) AS b) CROSS JOIN tp LEFT JOIN hn ON bin = b", PAIRS)
def log_histogram(spark, sf):
    h = R.log_histogram(V.pair_rows(spark, sf), "a_pred", 1600, 40)
    return h.select("bin", F.round("low", 2).alias("low"), F.round("high", 2).alias("high"), "n")


@query("A30_belt_distributions", ', m AS (SELECT chip_id, "row" AS r, col AS c FROM cells WHERE cls = 1), kn AS (SELECT x.*, CASE WHEN cls = 1 THEN \'object\' WHEN EXISTS (SELECT 1 FROM m WHERE m.chip_id = x.chip_id AND abs(m.r - x."row") <= 1 AND abs(m.c - x.col) <= 1) THEN \'belt\' END AS kind FROM cells x), ks AS (SELECT sza_bin, kind, CAST(least(floor(b08 / 0.05), 19) AS INT) AS bin FROM kn WHERE kind IS NOT NULL AND b08 BETWEEN 0 AND 1), tt AS (SELECT sza_bin, count(*) FILTER (kind = \'object\') AS o, count(*) FILTER (kind = \'belt\') AS b FROM ks GROUP BY ALL), dn AS (SELECT tt.*, CAST(unnest(range(20)) AS INT) AS bin FROM tt), hh AS (SELECT sza_bin, bin, count(*) FILTER (kind = \'object\') AS o, count(*) FILTER (kind = \'belt\') AS b FROM ks GROUP BY ALL) SELECT dn.sza_bin, dn.bin, coalesce(hh.o, 0) AS n_object, round(coalesce(hh.o, 0) / nullif(dn.o * 0.05, 0), 6) AS d_object, coalesce(hh.b, 0) AS n_belt, round(coalesce(hh.b, 0) / nullif(dn.b * 0.05, 0), 6) AS d_belt FROM dn LEFT JOIN hh USING (sza_bin, bin)', PX)
def belt_distributions(spark, sf):
    """Brightness of objects and of the belt around them, on the same edges."""
    px = V.cells(spark, sf)
    obj = px.where("cls = 1")
    belt = R.belt(obj.select(F.col("chip_id").alias("grid"), "row", "col"), 1, V.SIDE, V.SIDE).withColumnRenamed("grid", "chip_id")
    rows = obj.select("sza_bin", "b08", F.lit("object").alias("kind")).unionByName(px.join(belt, ["chip_id", "row", "col"]).select("sza_bin", "b08", F.lit("belt").alias("kind")))
    return R.densities(rows, "b08", "kind", ("object", "belt"), ["sza_bin"], 0.0, 1.0, 20)
