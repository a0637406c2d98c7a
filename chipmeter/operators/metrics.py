"""Error metrics of matched object pairs and their summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import materialise, sized

#: Lower ends of the reference size buckets (root length, m); the first one also holds what is smaller.
SIZE_EDGES = (40, 80, 160, 320, 640)


def pair_metrics(pairs: DataFrame) -> DataFrame:
    """Relative error in percent, absolute area and root length errors, squared area error."""
    d = F.col("a_pred") - F.col("a_ref")
    return pairs.withColumns({
        "rl_ref": F.sqrt("a_ref"), "rl_pred": F.sqrt("a_pred"), "re_pct": F.try_divide(d, F.col("a_ref")) * 100, "abs_area": F.abs(d), "sq_area": d * d,
    }).withColumn("abs_rl", F.abs(F.col("rl_pred") - F.col("rl_ref")))


def size_bucket(rl: Column, edges: Sequence[int] = SIZE_EDGES) -> Column:
    """Lower end of the bucket that a root length falls in."""
    out = F.lit(edges[0])
    for e in edges[1:]:
        out = F.when(rl >= e, F.lit(e)).otherwise(out)
    return out.cast("int")


def gap_fill(rows: DataFrame, by: Sequence[str], x: str, value: str) -> DataFrame:
    """Every whole x between a group's first and last, values in between on straight lines; nothing beyond the ends."""
    by = list(by)
    span = rows.groupBy(*by).agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    dense = span.select(*by, F.explode(F.sequence("lo", "hi")).alias(x)).join(rows.select(*by, x, value), [*by, x], "left")
    back = W.partitionBy(*by).orderBy(x).rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(*by).orderBy(x).rowsBetween(0, W.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(x).alias("x"), F.col(value).alias("v")))
    dense = dense.withColumns({"a": F.last(known, True).over(back), "b": F.first(known, True).over(ahead)})
    part = F.try_divide(F.col(x) - F.col("a.x"), F.col("b.x") - F.col("a.x"))
    return dense.select(*by, x, F.coalesce(value, F.col("a.v") + (F.col("b.v") - F.col("a.v")) * part).alias("filled"))


def centred_mean(rows: DataFrame, by: Sequence[str], order: str, value: str, reach: int = 2) -> DataFrame:
    return rows.withColumn("smooth", F.avg(value).over(W.partitionBy(*by).orderBy(order).rowsBetween(-reach, reach)))


def ratio_to(summary: DataFrame, by: Sequence[str], key: str, base: str, value: str) -> DataFrame:
    """A summary with its value divided by that of the base method in the same group; NULL where the base is zero or absent."""
    b = summary.where(F.col(key) == base).select(*by, F.col(value).alias("base"))
    return summary.join(b, list(by), "left").withColumn("ratio", F.when(F.col("base") > 0, F.col(value) / F.col("base"))).drop("base")


def pivoted(summary: DataFrame, row: str, col: str, values: Sequence[str], value: str) -> DataFrame:
    return summary.groupBy(row).pivot(col, list(values)).agg(F.first(value))


def melted(wide: DataFrame, row: str, cols: Sequence[str], key: str, value: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("double").alias("v")) for c in cols])
    return wide.select(row, F.explode(pairs).alias("p")).select(row, F.col("p.k").alias(key), F.col("p.v").alias(value)).where(F.col(value).isNotNull())


def completed(summary: DataFrame, domain: DataFrame, zero: Sequence[str] = ()) -> DataFrame:
    """All keys of a small domain table, with zeros in the named columns and NULL elsewhere where the summary has no row."""
    out = domain.join(summary, domain.columns, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero})


#: Relative error of the ranks that bracket a percentile.
ACCURACY = 10_000


def with_percentiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float], aggs: list[Column], accuracy: int = ACCURACY) -> DataFrame:
    """One row for each group with ``aggs`` and exact percentiles of ``value``, interpolated between neighbours; NULL where a group has no value.

    Two scans, no sort of all rows and no table of them. The first one makes ``aggs`` and, from sketches that combine in the tasks, two
    values around each percentile whose ranks are off by n / accuracy at most. The second one counts: a value between such a pair by itself,
    all values between pairs together, each as one row with a count for a group, however often it occurs. Cumulative counts then select the
    neighbours of each rank; a window's task sees 4 n / accuracy different values for each percentile at most. Columns of ``by`` must not be null.
    """
    qs = sorted(set(shares.values()))
    near = [max(0.0, q - 2 / accuracy) for q in qs] + [min(1.0, q + 2 / accuracy) for q in qs]
    sketch = F.percentile_approx(value, F.array(*map(F.lit, near)), F.lit(accuracy))
    ends = materialise(rows.groupBy(*by).agg(*aggs, F.count(value).alias("_n"), sketch.alias("_near")))
    few = sized(ends.select(*by, "_n", "_near"))
    v = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    v = v.join(few, by) if by else v.join(F.broadcast(ends.select("_n", "_near")))
    k = len(qs)
    slot = F.lit(0)
    for i in range(k):  # number of pairs that lie below the value
        slot = slot + (F.get("_near", F.lit(k + i)) < F.col("_v")).cast("int")
    inside = F.col("_v") >= F.get("_near", F.col("_slot"))
    v = v.withColumn("_slot", slot).withColumn("_one", F.when((F.col("_slot") < k) & inside, F.col("_v")))
    c = v.groupBy(*by, "_n", "_slot", "_one").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    order = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    c = c.withColumn("_to", F.sum("_c").over(order.orderBy("_slot", F.asc_nulls_first("_one")).rowsBetween(W.unboundedPreceding, 0)))

    def at(rank: Column) -> Column:
        """The value of a rank: a value counted by itself, or the first or last one of those counted together."""
        start = F.col("_to") - F.col("_c")
        lost = F.raise_error(F.lit("a percentile lies outside its bracket")).cast("double")
        own = F.when((F.col("_one").isNotNull()) | (rank == F.col("_to")), F.col("_hi")).when(rank == start + 1, F.col("_lo")).otherwise(lost)
        return F.max(F.when((rank > start) & (rank <= F.col("_to")), own))

    place = {name: (F.col("_n") - 1) * F.lit(q) + 1 for name, q in shares.items()}
    found = c.groupBy(*by).agg(*[x for name, p in place.items() for x in (at(F.floor(p)).alias(f"_l_{name}"), at(F.ceil(p)).alias(f"_h_{name}"), F.max(p - F.floor(p)).alias(f"_p_{name}"))])
    found = found.select(*by, *[(F.col(f"_l_{n}") + (F.col(f"_h_{n}") - F.col(f"_l_{n}")) * F.col(f"_p_{n}")).alias(n) for n in shares])
    out = ends.drop("_n", "_near")
    return out.join(found, by, "left") if by else out.join(F.broadcast(found), how="left")
