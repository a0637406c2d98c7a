"""Readers and writers of the library's files: partitioned objects, CSV logs, manifests and annotation collections."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.geometry import ring_box
from ..operators.sampling import ranked
from .scratch import materialise

COLLECTION = "images array<struct<id:long,file_name:string,width:int,height:int>>, annotations array<struct<id:long,image_id:long,category_id:int,segmentation:array<array<double>>,bbox:array<double>,area:double,iscrowd:int>>, categories array<struct<id:int,name:string>>"


def write_objects(objects: DataFrame, path: str, by: Sequence[str] = ("sza_bin", "method")) -> None:
    """Object tables in a folder for each bin and method."""
    objects.write.mode("overwrite").partitionBy(*by).parquet(path)


def read_objects(spark: SparkSession, path: str, class_name: str | None = None) -> DataFrame:
    """Object tables with bin and method from their folders; filters on those prune folders."""
    out = spark.read.parquet(path)
    return out if class_name is None else out.where(F.col("class_name") == class_name)


def write_csv(rows: DataFrame, path: str) -> None:
    """With a header, also for no rows at all; NULL is the empty field."""
    rows.write.mode("overwrite").option("header", "true").option("nullValue", "").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").option("nullValue", "").csv(path)


def write_skips(parts: Sequence[DataFrame], schema: T.StructType, path: str) -> None:
    """Skip logs of several gates in one file with all their columns."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    write_csv(out.select(*[F.col(f.name).cast(f.dataType) if f.name in out.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]), path)


def manifest_lines(chips: DataFrame) -> DataFrame:
    """One JSON document for each row."""
    return chips.select(F.to_json(F.struct("*")).alias("value"))


def read_manifest(lines: DataFrame, schema: str, required: Sequence[str]) -> DataFrame:
    """Rows of a manifest; a document without one of the required keys raises an error."""
    rows = lines.select(F.from_json("value", schema).alias("m")).select("m.*")
    for c in required:
        rows = rows.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"manifest without {c}")).cast(rows.schema[c].dataType)).otherwise(F.col(c)))
    return rows


ANNOTATION = re.search("annotations (array<.*?>>), categories", COLLECTION)[1]


def collection_of(images: DataFrame, annotations: DataFrame, categories: Sequence[tuple[int, str]]) -> DataFrame:
    """Annotation documents, one for each image, with its annotations nested: image_id, value (JSON). ``segmentation`` may be missing."""
    if "segmentation" not in annotations.columns:
        annotations = annotations.withColumn("segmentation", F.lit(None).cast("array<array<double>>"))
    a = annotations.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("id", "image_id", "category_id", "segmentation", "bbox", "area", "iscrowd"))).alias("annotations"))
    cats = F.array(*[F.struct(F.lit(k).alias("id"), F.lit(n).alias("name")) for k, n in categories])
    out = images.join(a, images.id == a.image_id, "left")
    empty = F.array().cast(ANNOTATION)
    doc = F.struct(F.array(F.struct("id", "file_name", "width", "height")).alias("images"), F.coalesce("annotations", empty).alias("annotations"), cats.alias("categories"))
    return out.select(F.col("id").alias("image_id"), F.to_json(doc).alias("value"))


def annotations_of(images: DataFrame, polygons: DataFrame, category: int = 1, least_area: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Images (grid, file_name, width, height) and outer rings of objects (grid, label, hole, area, ring) with sequential ids from 1:
    images by file name, annotations by image, then label. Boxes are x, y, width, height; images without objects stay."""
    named = materialise(ranked(images, [], ["file_name", "grid"]).select(F.col("rn").alias("id"), "grid", "file_name", "width", "height"))
    own = polygons.where(~F.col("hole") & (F.col("area") >= least_area)).join(named.select("grid", F.col("id").alias("image_id")), "grid")
    box = ring_box(F.col("ring"))
    flat = F.flatten(F.transform("ring", lambda p: F.array(p["x"], p["y"])))
    own = own.select("image_id", "label", F.array(flat).alias("segmentation"), F.array(box["x0"], box["y0"], box["x1"] - box["x0"], box["y1"] - box["y0"]).alias("bbox"), F.round("area", 2).alias("area"))
    own = ranked(own, [], ["image_id", "label"]).select(F.col("rn").alias("id"), "image_id", F.lit(category).alias("category_id"), "segmentation", "bbox", "area", F.lit(0).alias("iscrowd"))
    return named, own


def write_collection(images: DataFrame, annotations: DataFrame, categories: Sequence[tuple[int, str]], path: str) -> None:
    """A collection in a folder of JSON files: each line is a document of one image with its annotations and all categories."""
    collection_of(images, annotations, categories).select("value").write.text(path)


def scan_collection(spark: SparkSession, path: str, wanted: str, default: int = 2, whole_files: bool = False) -> tuple[DataFrame, DataFrame]:
    """Images and annotations of the JSON files under ``path``: a document a line, or (``whole_files``) a file. See :func:`read_collection`."""
    docs = spark.read.schema(COLLECTION).option("multiLine", str(whole_files).lower()).json(path)
    return _split(docs, wanted, default)


def read_collection(docs: DataFrame, wanted: str, default: int = 2) -> tuple[DataFrame, DataFrame]:
    """Images and annotations of JSON documents; ``wanted`` marks the category of that name, or the default id if there is none."""
    return _split(docs.select(F.from_json("value", COLLECTION).alias("c")).select("c.*"), wanted, default)


def _split(c: DataFrame, wanted: str, default: int) -> tuple[DataFrame, DataFrame]:
    named = F.filter("categories", lambda k: k["name"] == wanted)
    target = F.coalesce(F.get(named, F.lit(0))["id"], F.lit(default))
    images = c.select(F.explode("images").alias("i")).select("i.*").distinct()
    anns = c.select(target.alias("target"), F.explode("annotations").alias("a")).select("a.*", (F.col("a.category_id") == F.col("target")).alias("wanted"))
    return images, anns


#: Imported chips: predictions lie inside the row, so a chip and its predictions come or stay away together.
CHIPS = "filename string, stem string, region string, prediction_count int, predictions array<struct<class:string,area_m2:double>>, sza_bin string, batch string"


def read_chips(spark: SparkSession, path: str) -> DataFrame:
    """The table of imported chips; empty if nothing has been imported."""
    spark.createDataFrame([], CHIPS).write.mode("append").partitionBy("sza_bin", "batch").parquet(path)
    return spark.read.schema(CHIPS).parquet(path)


def import_chips(files: DataFrame, grids: DataFrame, predictions: DataFrame, path: str, batch: str) -> DataFrame:
    """Append chips that aren't there yet; returns files with ``outcome``: skipped (the name is there, or a file with it comes first by region and bin), no_tif,
    or imported, and ``no_predictions`` where an imported one has none.

    files (filename, region, sza_bin), grids (stem) that exist, predictions (stem, class, area_m2). A file's grid has its stem, or its stem without a
    band suffix. A batch owns its partitions: writing overwrites only these, so an import that broke off can be repeated under its
    name, a repeated one adds nothing, and what other imports wrote is never touched.
    """
    spark = files.sparkSession
    have = read_chips(spark, path)
    stem = F.regexp_replace("filename", r"\.png$", "")
    first = F.row_number().over(W.partitionBy("filename").orderBy("region", "sza_bin"))
    f = files.select("filename", "region", "sza_bin").withColumn("nth", first)
    names = F.array(F.struct(F.lit(0).alias("rank"), stem.alias("stem")), F.struct(F.lit(1).alias("rank"), F.regexp_replace(stem, r"_B\d+$", "").alias("stem")))
    f = f.withColumn("c", F.explode(names))
    f = f.join(grids.select(F.col("stem").alias("has")).distinct(), F.col("c.stem") == F.col("has"), "left")
    f = f.groupBy("filename", "region", "sza_bin", "nth").agg(F.min_by("has", F.when(F.col("has").isNotNull(), F.col("c.rank"))).alias("stem"))
    own = predictions.groupBy("stem").agg(F.array_sort(F.collect_list(F.struct("class", "area_m2"))).alias("predictions"))
    known = have.groupBy("filename").agg(F.max((F.col("batch") != batch).cast("int")).alias("other"))  # 0: by this batch alone
    f = f.join(known, "filename", "left").join(own, "stem", "left")
    outcome = F.when((F.col("nth") > 1) | F.col("other").isNotNull(), "skipped").when(F.col("stem").isNull(), "no_tif").otherwise("imported")
    f = materialise(f.withColumn("outcome", outcome))
    if f.where("outcome = 'imported'").limit(1).count():
        rows = f.where("nth = 1 and stem is not null and coalesce(other, 0) = 0")  # with those that an earlier try of this batch left
        rows = rows.select("filename", "stem", "region", F.coalesce(F.size("predictions"), F.lit(0)).alias("prediction_count"), "predictions", "sza_bin", F.lit(batch).alias("batch"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sza_bin", "batch").parquet(path)
    return f.select("filename", "region", "sza_bin", "outcome", (F.col("outcome").eqNullSafe("imported") & F.col("predictions").isNull()).alias("no_predictions"))


def preferred(own: DataFrame, merged: DataFrame) -> DataFrame:
    """Rows of a chip's own file (stem, ...) if it has one, else those of the merged file (source_file, ...) that name it, with or without ``.tif``.

    Adds ``used``. Stems come from both sides; a merged row for a chip with a file of its own is left out.
    """
    rest = [c for c in own.columns if c != "stem"]
    named = merged.withColumn("stem", F.regexp_replace("source_file", r"\.tif$", "")).select("stem", *rest)
    named = named.join(own.select("stem").distinct(), "stem", "left_anti")
    return own.withColumn("used", F.lit("own")).unionByName(named.withColumn("used", F.lit("merged")))


#: The six tables of a labelling campaign, with their keys and parents.
CAMPAIGN = {
    "chips": ("id long, filename string, region string, sza_bin string", ("filename",), {}),
    "predictions": ("id long, chip_id long, class_name string, area_m2 double", ("id",), {"chip_id": "chips"}),
    "labelers": ("id long, name string, is_admin boolean", ("name",), {}),
    "assignments": ("id long, chip_id long, labeler_id long, status string", ("chip_id", "labeler_id"), {"chip_id": "chips", "labeler_id": "labelers"}),
    "annotation_results": ("id long, assignment_id long, chip_verdict string, tags string, submitted_at timestamp", ("assignment_id",), {"assignment_id": "assignments"}),
    "polygon_decisions": ("id long, result_id long, prediction_id long, action string", ("id",), {"result_id": "annotation_results", "prediction_id": "predictions"}),
}


def read_campaign(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The six tables under ``path`` with their schemas; a column of another type is an error when it is read."""
    return {name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, (schema, _, _) in CAMPAIGN.items()}


def campaign_faults(tables: dict[str, DataFrame]) -> DataFrame:
    """For each table: rows, rows whose key another row has too, and rows that name a parent that isn't there (null names none)."""
    out = None
    for name, (_, key, parents) in CAMPAIGN.items():
        t = tables[name]
        twice = t.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
        one = twice.select(F.lit(name).alias("name"), "n", (F.col("n") - F.col("keys")).alias("n_repeated"))
        loose = None
        for c, parent in parents.items():
            lost = t.where(F.col(c).isNotNull()).join(tables[parent].select(F.col("id").alias(c)), c, "left_anti").select(F.lit(1).alias("x"))
            loose = lost if loose is None else loose.unionByName(lost)
        n = loose.agg(F.count("x").alias("n_loose")) if loose is not None else t.sparkSession.range(1).select(F.lit(0).cast("long").alias("n_loose"))
        one = one.join(F.broadcast(n))
        out = one if out is None else out.unionByName(one)
    return out
