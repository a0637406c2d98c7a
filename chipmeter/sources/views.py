"""The library's input tables as views over the given tables: chips, grids, pairs, inventories, names and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Illumination bins in their order, regions, detection methods.
BINS = ("sza_lt65", "sza_65_70", "sza_70_75", "sza_gt75")
REGIONS = ("KQ", "SK")
SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bin_of(number) -> F.Column:
    """One of the four bins by a whole number."""
    return F.element_at(F.array(*map(F.lit, BINS)), (F.pmod(number, F.lit(4)) + 1).cast("int"))


def chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chip_id, sza_bin, region, source and three bands of 8x8 cells, row by row."""
    e = table(spark, sf_dir, "embeddings")
    b08 = F.transform("embedding", lambda x: F.nanvl(x.cast("double"), F.lit(0.0)) + 0.5)
    rows = e.where(F.size("embedding") == SIDE * SIDE).select(F.col("vec_id").alias("chip_id"), F.col("label").cast("int").alias("label"), b08.alias("b08"))
    return rows.select(
        "chip_id", bin_of("label").alias("sza_bin"), F.when(F.col("label") % 2 == 1, "SK").otherwise("KQ").alias("region"),
        F.when(F.col("label") < 5, "expert").otherwise("crowd").alias("source"), "b08", F.reverse("b08").alias("b03"),
        F.concat(F.slice("b08", 33, 32), F.slice("b08", 1, 32)).alias("b04"),
    )


def pixels(chip_rows: DataFrame, side: int = SIDE) -> DataFrame:
    """One row for each cell: chip columns, row, col and the bands."""
    keys = [c for c in chip_rows.columns if c not in ("b08", "b03", "b04")]
    out = chip_rows.select(*keys, F.posexplode(F.arrays_zip("b08", "b03", "b04")).alias("pos", "v"))
    return out.select(*keys, F.floor(F.col("pos") / side).cast("int").alias("row"), (F.col("pos") % side).alias("col"), "v.b08", "v.b03", "v.b04")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of all chips with their true class (0 background, 1 object, 2 shadow) and a probability ``p``."""
    px = pixels(chips(spark, sf_dir))
    cls = F.when(F.col("b08") >= 0.60, 1).when(F.col("b08") >= 0.57, 2).otherwise(0)
    z = (F.col("b08") - 0.5) * 8 + (F.col("b03") - 0.5) * 4
    return px.withColumns({"cls": cls, "p": 1 / (1 + F.exp(-z))})


def large_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreground cells (grid, row, col) of 128x128 scenes with winding components; several hundred line items a scene and more."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.floor(F.col("l_suppkey") % F.lit(40)).cast("long").alias("grid"), (F.col("l_orderkey") % 128).cast("int").alias("row"),
        ((F.col("l_partkey") + 37 * F.col("l_linenumber")) % 128).cast("int").alias("col"),
    ).distinct()


def pair_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched object pairs: method, region, sza_deg, a_ref and a_pred (m2), iou."""
    li = table(spark, sf_dir, "lineitem")
    a_ref = 400 * F.col("l_quantity").cast("double") * F.col("l_quantity").cast("double")
    return li.select(
        F.col("l_orderkey").alias("ref_id"), F.col("l_linenumber").alias("pred_id"),
        F.when(F.col("l_returnflag") == "A", "OT").when(F.col("l_returnflag") == "N", "TR").otherwise("UNet").alias("method"),
        F.when(F.col("l_linestatus") == "O", "KQ").otherwise("SK").alias("region"), bin_of("l_suppkey").alias("sza_bin"),
        (55 + 2 * (F.col("l_partkey") % 15)).cast("int").alias("sza_deg"), a_ref.alias("a_ref"),
        (a_ref * (F.lit(0.7) + (F.col("l_orderkey") % 97) / F.lit(150.0))).alias("a_pred"), (F.lit(0.3) + 7 * F.col("l_discount").cast("double")).alias("iou"),
    )


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chips with their bin (every 23rd unknown), number of objects and largest root length (m; some sizes are rare)."""
    p = table(spark, sf_dir, "part")
    n = F.when(F.col("p_size") % 3 == 0, 0).otherwise((F.col("p_partkey") * 7 + F.col("p_size")) % 6).cast("int")
    return p.select(
        F.col("p_partkey").cast("long").alias("chip"), F.when(F.col("p_partkey") % 23 == 0, "unknown").otherwise(bin_of("p_size")).alias("sza_bin"), n.alias("n_objects"),
        F.when((F.col("p_size") == 1) & (F.col("p_partkey") % 16 > 0), 120).otherwise(20 * F.col("p_size")).cast("double").alias("max_rl"), F.when(F.col("p_partkey") % 3 == 0, "crowd").otherwise("expert").alias("source"),
    )


def scene_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chip file names: every 17th has no offsets, every 19th an export suffix."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    day = F.date_format(F.date_add(F.lit("2019-01-01").cast("date"), (k % 1500).cast("int")), "yyyyMMdd")
    hour = F.lpad((k % 24).cast("string"), 2, "0")
    stem = F.concat(
        F.when(k % 2 == 0, "S2A").otherwise("S2B"), F.lit("_MSIL1C_"), day, F.lit("T"), hour, F.lit("3012_N0500_R"), F.lpad((k % 143).cast("string"), 3, "0"),
        F.lit("_T"), F.element_at(F.array(*map(F.lit, ("25WER", "24VWQ", "22WEA", "99XXX"))), (F.col("o_custkey") % 4 + 1).cast("int")), F.lit("_X"),
    )
    offset = F.concat(F.lit("_r"), F.lpad((k % 40 * 256).cast("string"), 4, "0"), F.lit("_c"), F.lpad((k % 37 * 256).cast("string"), 4, "0"))
    suffix = F.when(k % 19 == 0, F.lit("_png.rf.0123456789abcdef0123456789abcdef")).otherwise("")
    return o.select(k.alias("id"), F.concat(stem, F.when(k % 17 == 0, "").otherwise(offset), suffix, F.lit(".tif")).alias("name"))


def _square(side: Column) -> Column:
    """A ring of four points, all of them the same if ``side`` is 0."""
    s, zero = side.cast("double"), F.lit(0.0)
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((zero, zero), (s, zero), (s, s), (zero, s))])


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelling submissions: event_id, ts, assignment, labeler, verdict and tags (some not allowed), edits (prediction, action,
    class, ring; some not allowed or of another chip's prediction) of edited ones."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    verdict = F.create_map(*[F.lit(x) for kv in {"click": "accepted", "error": "rejected", "purchase": "edited", "view": "skipped", "signup": "bogus"}.items() for x in kv])
    one_of = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    tags = F.array_compact(F.array(one_of((None, "sea-ice", "cloud", "dark-water", "ambiguous", None, "land-edge", "melange", None, "odd", "sea-ice"), k), F.when(k % 5 == 0, "dark-water")))
    edit = lambda p, a, c, side: F.struct(p.cast("int").alias("prediction"), a.alias("action"), c.alias("class"), _square(side).alias("ring"))
    edits = F.array(
        edit(k % 8 + 1, one_of(("accepted", "rejected", "modified", "modified"), k), F.when(k % 41 == 0, "ship").otherwise("iceberg"), k % 7),
        edit(F.when(k % 3 > 0, k % 5 + 1), F.when(k % 3 == 0, "added").when(k % 31 == 1, "moved").otherwise("accepted"), F.lit("iceberg"), k % 11),
    )
    out = e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), (k % 400).alias("assignment"), F.col("user_id").alias("labeler"), F.coalesce(verdict[F.col("event_type")], F.lit("bogus")).alias("verdict"), tags.alias("tags"))
    return out.withColumn("edits", F.when(F.col("verdict") == "edited", edits).otherwise(F.array().cast("array<struct<prediction:int,action:string,class:string,ring:array<struct<x:double,y:double>>>>")))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted polygons: chip (as assignments are numbered), prediction, class, ring."""
    p = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 400).alias("chip"), F.col("l_linenumber").cast("int").alias("prediction")).distinct()
    return p.select("chip", "prediction", F.lit("iceberg").alias("class"), _square((F.col("chip") + F.col("prediction")) % 9).alias("ring"))
