"""A cascade of gates: each one is computed for the chips that passed those before it only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialise
from .objects import components, sizes
from .raster import otsu


def null_chips(chips: DataFrame, px: DataFrame, masks: DataFrame, bright: float, most_bright: float, most_cloud: float, least_otsu: float, least_px: int, width: int) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Whether a chip holds no objects: chip_id, decision (accept, reject, skip), note (the first reason), and what was measured until then.

    chips (chip_id, stem or null, bands, scene or null), px (chip_id, row, col, b08), masks (chip_id, v: cells of the scene's cloud mask in the chip's
    window). In order: a name that can't be read, too few bands, share of bright cells (>=), no archive of the scene, no cloud mask, share of cells with a
    cloud bit (v & 3) (>=), 95th percentile (>=), and, where the chip's own threshold isn't below ``least_otsu``, the largest component above it (>=). Also returns the
    chips that reach each stage: coverage, cloud, p95, otsu, component.
    """
    own = chips.select("chip_id", F.when(F.col("stem").isNull(), "unparseable_filename").when(F.col("bands") < 3, "too_few_bands").alias("note"), "scene")
    done = [own.where("note is not null").select("chip_id", F.lit("skip").alias("decision"), "note")]
    left = materialise(own.where("note is null").select("chip_id", "scene"))
    stages = {"coverage": left}

    def split(rows: DataFrame, decision: str, note) -> DataFrame:
        """Chips without a note go on; the others are decided."""
        rows = materialise(rows.withColumn("note", note))
        done.append(rows.where("note is not null").select("chip_id", F.when(F.col("note").startswith("no_"), "skip").otherwise(decision).alias("decision"), "note", *[c for c in ("ic_frac", "cloud_frac", "p95", "otsu", "max_px") if c in rows.columns]))
        return rows.where("note is null").drop("note")

    cells = px.select("chip_id", "row", "col", "b08")
    ic = cells.join(left.select("chip_id"), "chip_id", "left_semi").groupBy("chip_id").agg(F.avg((F.col("b08") >= bright).cast("int")).alias("ic_frac"))
    left = split(left.join(ic, "chip_id"), "reject", F.when(F.col("ic_frac") >= most_bright, "ic_frac"))
    left = stages["cloud"] = split(left, "skip", F.when(F.col("scene").isNull(), "no_safe_zip"))
    cloud = masks.join(left.select("chip_id"), "chip_id", "left_semi").groupBy("chip_id").agg(F.avg((F.col("v").bitwiseAND(3) > 0).cast("int")).alias("cloud_frac"))
    left = left.join(cloud, "chip_id", "left")
    left = stages["p95"] = split(left, "reject", F.when(F.col("cloud_frac").isNull(), "no_qa60").when(F.col("cloud_frac") >= most_cloud, "cloud_frac"))
    some = cells.join(left.select("chip_id"), "chip_id", "left_semi")
    left = left.join(some.groupBy("chip_id").agg(F.percentile("b08", F.lit(0.95)).alias("p95")), "chip_id")
    left = stages["otsu"] = split(left, "reject", F.when(F.col("p95") >= bright, "b08_p95"))
    some = materialise(cells.join(left.select("chip_id"), "chip_id", "left_semi"))
    left = materialise(left.join(otsu(some).select("chip_id", F.coalesce("threshold", F.lit(0.0)).alias("otsu")), "chip_id"))
    stages["component"] = left.where(F.col("otsu") >= least_otsu)
    fg = some.join(stages["component"].select("chip_id", "otsu"), "chip_id").where("b08 > otsu").select(F.col("chip_id").alias("grid"), "row", "col")
    top = sizes(components(fg, width)).groupBy(F.col("grid").alias("chip_id")).agg(F.max("px").alias("max_px"))
    left = split(left.join(top, "chip_id", "left"), "reject", F.when(F.col("max_px") >= least_px, "otsu_cc"))
    out = left.select("chip_id", F.lit("accept").alias("decision"), F.lit("").alias("note"), "ic_frac", "cloud_frac", "p95", "otsu", "max_px")
    for part in done:
        out = out.unionByName(part, allowMissingColumns=True)
    return out, stages
