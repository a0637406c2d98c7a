"""A labelling campaign: checks, verdicts, progress, agreement, reference objects and assignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .geometry import ring_area
from .sampling import ranked

#: What submissions may hold, and what makes or drops reference objects.
VERDICTS = ("accepted", "rejected", "edited", "skipped")
ACTIONS = ("accepted", "rejected", "added", "modified")
CLASSES = ("iceberg",)
TAGS = ("sea-ice", "ambiguous", "cloud", "land-edge", "melange", "dark-water")
DROP_TAGS = ("cloud", "ambiguous", "land-edge", "melange")
KEEP_VERDICTS = ("accepted", "edited")
KEEP_ACTIONS = ("accepted", "added", "modified")


def _among(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values))


def with_faults(submissions: DataFrame, predictions: DataFrame) -> DataFrame:
    """Submissions with ``bad``, the first rule that they break, or null; works on streams too.

    Rules in their order: the verdict is allowed; each decision of an edited submission, one after the other, has an allowed action
    and class, and its prediction, if it names one, belongs to the chip; all tags are allowed. predictions (chip, prediction).
    """
    own = predictions.groupBy(F.col("chip").alias("assignment")).agg(F.collect_set("prediction").alias("own"))

    def fault(e: Column) -> Column:
        known = F.coalesce(F.array_contains("own", e["prediction"]), F.lit(False))
        return F.when(~e["action"].isin(*ACTIONS), "bad_action").when(~e["class"].isin(*CLASSES), "bad_class").when(e["prediction"].isNotNull() & ~known, "orphan")

    edits = F.get(F.filter(F.transform("edits", fault), lambda f: f.isNotNull()), 0)
    bad = F.coalesce(
        F.when(F.col("verdict").isNull() | ~F.col("verdict").isin(*VERDICTS), "bad_verdict"), F.when(F.col("verdict") == "edited", edits),
        F.when(F.size(F.array_except("tags", _among(TAGS))) > 0, "bad_tag"),
    )
    return submissions.join(own, "assignment", "left").withColumn("bad", bad).drop("own")


def checked(submissions: DataFrame, predictions: DataFrame) -> DataFrame:
    """``status`` of every submission: conflict (its assignment has a good one already), accepted, or the rule it breaks; also ``bad``.

    The first good submission of an assignment comes from one aggregation, which combines before it moves.
    """
    rows = with_faults(submissions, predictions)
    first = rows.where("bad is null").groupBy("assignment").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    own = F.struct("ts", "event_id")
    status = F.when(own > F.col("first"), "conflict").when(own == F.col("first"), "accepted").otherwise(F.col("bad"))
    return rows.join(first, "assignment", "left").withColumn("status", status).drop("first")


def decisions(results: DataFrame, predictions: DataFrame) -> DataFrame:
    """One decision per polygon: accepted and rejected verdicts go to all predictions of the chip, edited ones are as the labeler
    gave them, skipped ones give none. results (chip, verdict, edits, ...), predictions (chip, prediction, class, ring)."""
    others = [c for c in results.columns if c not in ("chip", "edits")]
    all_of = results.where(F.col("verdict").isin("accepted", "rejected")).join(predictions, "chip")
    all_of = all_of.select("chip", *others, "prediction", F.col("verdict").alias("action"), "class", "ring")
    given = results.where("verdict = 'edited'").select("chip", *others, F.explode("edits").alias("e"))
    return all_of.unionByName(given.select("chip", *others, "e.prediction", "e.action", "e.class", "e.ring"))


def reference_objects(results: DataFrame, decided: DataFrame, cell_m: float = 10.0, least_root_m: float = 40.0, fold: str = "chip") -> DataFrame:
    """Decisions that make reference objects, with ``root_length``: kept verdicts and actions, rings of three different points and
    more, at least ``least_root_m`` long. A chip (``fold``) goes if any of its kept results has a tag of ``DROP_TAGS``."""
    kept = F.col("verdict").isin(*KEEP_VERDICTS)
    gone = results.where(kept & F.arrays_overlap("tags", _among(DROP_TAGS))).select(fold).distinct()
    root = F.sqrt(ring_area(F.col("ring")) * cell_m * cell_m)
    out = decided.where(kept & F.col("action").isin(*KEEP_ACTIONS) & (F.size(F.array_distinct("ring")) >= 3)).join(gone, fold, "left_anti")
    return out.withColumn("root_length", root).where(F.col("root_length") >= least_root_m)


def spread(chips: DataFrame, labelers: DataFrame, order: Column) -> DataFrame:
    """Chips dealt out in turn to the labelers in the order of their names; the labelers are few (checked)."""
    if labelers.limit(100_001).count() > 100_000:
        raise ValueError("more than 100,000 labelers")
    n = labelers.select("labeler", (F.row_number().over(W.orderBy("labeler")) - 1).alias("slot"))
    total = n.agg(F.count(F.lit(1)).alias("n"))
    dealt = ranked(chips.withColumn("_order", order), [], ["_order", "chip"])
    return dealt.join(F.broadcast(total)).withColumn("slot", (F.col("rn") - 1) % F.col("n")).join(F.broadcast(n), "slot").select("chip", "labeler")
