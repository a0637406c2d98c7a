"""Positions, splits, balancing and quotas. Random choices are ranks of an md5 of seed and key, the same on every run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import materialise, sized


def seeded(seed: int, key: str | Column) -> Column:
    """Sort key of a seeded shuffle."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat_ws("|", F.lit(str(seed)), k.cast("string")).cast("binary"))


def ranked(rows: DataFrame, by: list[str], order: list[str], whole: bool = False) -> DataFrame:
    """``rn``, the rank from 1 within each group ``by`` (all rows, if empty) by the columns ``order``; with ``whole`` also ``global_index``,
    the place from 0 in the order of ``by`` and ``order``.

    Rows are dealt by ranges and numbered in their partition. Where each group starts in each partition, and how many of its rows
    lie in the partitions before, is one row for each of these; it goes back to the rows by a broadcast of checked size. So a
    few large groups are spread over all tasks.
    """
    at = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    part = F.spark_partition_id()
    at = materialise(at.withColumns({"_part": part, "_in": F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)}))
    names = {c: f"_g_{c}" for c in by}
    starts = materialise(at.groupBy("_part", *by).agg(F.min("_in").alias("_start"), F.count(F.lit(1)).alias("_n")))
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1) if by else W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = starts.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_start") + 1)
    if whole and by:
        parts = starts.groupBy("_part").agg(F.sum("_n").alias("_n"))  # one row for each partition
        parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
        starts = starts.join(parts, "_part")
    starts = sized(starts.drop("_start", "_n").withColumnsRenamed({"_part": "_p", **names}))
    on = [at._part == starts._p] + [at[c].eqNullSafe(starts[n]) for c, n in names.items()]
    out = at.join(starts, on).withColumn("rn", F.col("_in") + F.col("_shift"))
    if whole:
        out = out.withColumn("global_index", F.col("_before") + F.col("_in") if by else F.col("rn") - 1)
    return out.drop("_part", "_in", "_p", "_shift", "_before", *names.values())


def with_positions(rows: DataFrame, part: str, order: str) -> DataFrame:
    """``position`` within each part and ``global_index`` over all parts, both from 0."""
    return ranked(rows, [part], [order], whole=True).withColumn("position", F.col("rn") - 1).drop("rn")


def stratified_split(chips: DataFrame, test_share: float, val_share: float, strata: Sequence[str], seed: int = 42, stratum: str = "sza_bin", key: str = "chip") -> DataFrame:
    """``split`` for every chip: the same number for test from each of ``strata`` that occurs, ``test_share`` of all chips together, then
    ``val_share`` of all chips for validation from the whole remainder, the rest for training.

    Both draws are ranks by seeded hash. A stratum with fewer chips gives all of them; chips of other strata never reach test.
    """
    listed = F.col(stratum).isin(*strata)
    total, present = chips.agg(F.count(F.lit(1)), F.countDistinct(F.when(listed, F.col(stratum)))).first()
    each = max(1, max(1, round(total * test_share)) // max(1, present))
    rows = ranked(chips.withColumn("_key", seeded(seed, key)), [stratum], ["_key", key]).drop("_key")
    rows = materialise(rows.withColumn("split", F.when(listed & (F.col("rn") <= each), "test")).drop("rn"))
    rest = ranked(rows.where("split is null").withColumn("_key", seeded(seed + 1, key)), [], ["_key", key])
    val = F.when(F.col("rn") <= max(1, round(total * val_share)), "val").otherwise("train")
    rest = rest.withColumn("split", val)
    return rows.where("split is not null").unionByName(rest.select(rows.columns))


def class_balance(chips: DataFrame, ratio: float, strata: Sequence[str], least: int = 5, seed: int = 42, stratum: str = "sza_bin", key: str = "chip") -> DataFrame:
    """Chips that stay when the larger of positive and null chips is cut to ``ratio`` times the smaller, in each stratum.

    Strata whose smaller class has fewer than ``least`` chips stay as they are; chips of strata that aren't listed go. Adds ``action``.
    """
    pos = chips.where(F.col(stratum).isin(*strata)).withColumn("positive", F.col("n_objects") > 0)
    n = pos.groupBy(stratum).agg(F.count_if("positive").alias("np"), F.count_if(~F.col("positive")).alias("nn"))
    low = F.least("np", "nn")
    n = sized(n.select(stratum, F.when(low < least, None).otherwise(F.floor(low * ratio)).cast("long").alias("cap")))
    out = ranked(pos.withColumn("_key", seeded(seed, key)), [stratum, "positive"], ["_key", key]).drop("_key").join(n, stratum)
    out = out.where(F.col("cap").isNull() | (F.col("rn") <= F.col("cap")))
    return out.withColumn("action", F.when(F.col("cap").isNull(), "skipped").otherwise("balanced")).drop("cap", "rn")


def size_targets(counts: DataFrame, ratio: float, least: int, stratum: str = "sza_bin") -> DataFrame:
    """``target`` of each size bin: bins up to the lower mark grow to it, bins above the upper mark are drawn down to it.

    The marks come from each stratum's smallest bin that occurs: the lower one is its count, ``least`` at the least; the upper one
    is ``ratio`` times the count or the lower mark, whichever is more. counts (stratum, size_bin, c).
    """
    low = counts.groupBy(stratum).agg(F.min("c").alias("_min"))
    low = low.withColumn("_low", F.greatest(F.col("_min"), F.lit(least)))
    low = low.withColumn("_high", F.greatest(F.floor(F.col("_min") * ratio), F.floor(F.col("_low") * ratio)))
    target = F.when(F.col("c") <= F.col("_low"), F.col("_low")).when(F.col("c") > F.col("_high"), F.col("_high")).otherwise(F.col("c"))
    return counts.join(low, stratum).withColumn("target", target.cast("long")).drop("_min", "_low", "_high")


def to_targets(rows: DataFrame, targets: DataFrame, by: list[str], seed: int = 42, key: str = "chip") -> DataFrame:
    """Rows of each group copied or drawn until the group has ``target`` rows: whole copies, then the first by seeded rank.

    ``targets`` (by..., target) has a row for each group to change; other groups stay as they are. Adds ``copy`` from 0.
    """
    n = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).join(targets, by, "left")
    n = sized(n.select(*by, F.coalesce("target", "n").alias("target"), "n"))
    out = ranked(rows.withColumn("_key", seeded(seed, key)), by, ["_key", key]).drop("_key").join(n, by)
    copies = F.floor(F.col("target") / F.col("n")) + F.when(F.col("rn") <= F.col("target") % F.col("n"), 1).otherwise(0)
    out = out.withColumn("copies", copies.cast("int")).where("copies > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies", "rn", "n", "target")


def apportioned(counts: DataFrame, by: list[str], total: int, weight: str) -> DataFrame:
    """``quota`` of each stratum out of ``total``, in proportion to ``weight`` (whole numbers above 0), at most its ``n`` rows.

    What a stratum lacks goes to the others by their weights; what rounding leaves goes to the largest remainders (ties by the strata's
    order). Everything is in whole numbers. The strata are few (checked), as they are ordered in one task: a stratum is full when the level that the
    others need lies above n / weight, so one pass over them in the order of n / weight finds the level.
    """
    if counts.limit(100_001).count() > 100_000:
        raise ValueError("more than 100,000 strata")
    up = W.orderBy(F.col("n") / F.col(weight), *by).rowsBetween(W.unboundedPreceding, -1)
    c = counts.withColumns({"_n": F.coalesce(F.sum("n").over(up), F.lit(0)), "_w": F.sum(weight).over(W.partitionBy(F.lit(0))) - F.coalesce(F.sum(weight).over(up), F.lit(0))})
    need = F.greatest(F.lit(total) - F.col("_n"), F.lit(0))
    open_ = need * F.col(weight) <= F.col("n") * F.col("_w")  # the level need / _w is within this stratum's rows, and within those of all that follow
    level = F.min(F.when(open_, F.struct((-F.col("_w")).alias("w"), need.alias("need")))).over(W.partitionBy(F.lit(0)))
    c = c.withColumns({"_l": level, "_full": ~open_})
    share = F.col("_l.need") * F.col(weight)
    c = c.withColumn("_floor", F.when(F.col("_full"), F.col("n")).otherwise(F.expr("_l.need * " + weight + " div -_l.w")))
    c = c.withColumn("_rest", F.when(F.col("_full"), F.lit(0)).otherwise(share % -F.col("_l.w")))
    left = F.least(F.lit(total), F.sum("n").over(W.partitionBy(F.lit(0)))) - F.sum("_floor").over(W.partitionBy(F.lit(0)))
    place = F.row_number().over(W.orderBy(F.desc("_rest"), *by))
    return c.withColumn("quota", (F.col("_floor") + F.when(place <= left, 1).otherwise(0)).cast("long")).select(*counts.columns, "quota")


def ratio_quotas(counts: DataFrame, ratios: DataFrame, stratum: str = "sza_bin") -> DataFrame:
    """Quotas of positive and null chips in the ratio of each stratum, as many as both classes allow.

    counts (stratum, np, nn), ratios (stratum, gt_plus, gt_zero); strata without ratios get none. A ratio of 0 asks for none of a class."""
    level = F.least(*[F.coalesce(F.try_divide(F.col(n).cast("double"), F.col(r)), F.lit(float("inf"))) for n, r in (("np", "gt_plus"), ("nn", "gt_zero"))])
    c = counts.join(ratios, stratum).withColumn("_level", level)
    quota = lambda r: F.when(F.col(r) > 0, F.floor(F.col("_level") * F.col(r) + 1e-9)).otherwise(0).cast("long")
    return c.select(stratum, quota("gt_plus").alias("q_plus"), quota("gt_zero").alias("q_zero"))


def drawn(rows: DataFrame, by: list[str], quotas: DataFrame, seed: int, key: str = "chip") -> DataFrame:
    """The first ``quota`` rows of each group by seeded rank; groups without a quota go."""
    out = ranked(rows.withColumn("_key", seeded(seed, key)), by, ["_key", key]).drop("_key")
    return out.join(sized(quotas.select(*by, "quota")), by).where("rn <= quota").drop("rn", "quota")


def first_by(rows: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    """The first ``most`` rows of each group."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= most)


def size_skip_rules(counts: DataFrame, nulls: DataFrame, ratio: float, least: int, strata: Sequence[str], stratum: str = "sza_bin") -> DataFrame:
    """Why a stratum's sizes are not balanced, '' if they are: fewer than two size bins occur (one_bin), a bin with fewer than ``least`` chips
    (few), or balancing would leave more null chips than ``ratio`` times the positive ones where there were not (ratio).

    counts (stratum, size_bin, c, target), nulls (stratum, nulls); one row for each of ``strata``, also without chips."""
    names = counts.sparkSession.createDataFrame([(x,) for x in strata], f"{stratum} string")
    b = counts.groupBy(stratum).agg(F.count(F.lit(1)).alias("bins"), F.min("c").alias("low"), F.sum("c").alias("pos"), F.sum("target").alias("cand"))
    b = F.broadcast(names).join(b, stratum, "left").join(nulls, stratum, "left")
    b = b.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("bins", "low", "pos", "cand", "nulls")})
    broken = (F.col("nulls") <= F.lit(ratio) * F.col("pos")) & (F.col("nulls") > F.lit(ratio) * F.col("cand"))
    return b.withColumn("skipped_reason", F.when(F.col("bins") < 2, "one_bin").when(F.col("low") < least, "few").when(broken, "ratio").otherwise(""))


def identity_hash(rows: DataFrame, by: list[str], line: Column) -> DataFrame:
    """``hash`` of each group's lines, whatever their order: lines are sorted in 4,096 buckets by the start of their md5, each
    bucket has a sha256 of its lines, and the group that of its buckets' in order. So no task holds a group's lines."""
    b = rows.select(*by, line.alias("line")).withColumn("bucket", F.substring(F.md5(F.col("line").cast("binary")), 1, 3))
    sha = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n").cast("binary"), 256)
    parts = b.groupBy(*by, "bucket").agg(sha("line").alias("part")).withColumn("part", F.concat("bucket", "part"))
    return parts.groupBy(*by).agg(sha("part").alias("hash"))


def positional_join(left: DataFrame, right: DataFrame, part: str) -> DataFrame:
    """Rows of the same place (``part``, ``pos``); an error if a part's rows differ in number."""
    n = lambda df, name: df.groupBy(part).agg(F.count(F.lit(1)).alias(name))
    odd = n(left, "l").join(n(right, "r"), part, "full_outer").where("l is distinct from r").first()
    if odd:
        raise ValueError(f"{odd[part]}: {odd.l} rows on the left, {odd.r} on the right")
    return left.join(right, [part, "pos"])
