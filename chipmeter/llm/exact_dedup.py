"""Operator 1, exact dedup: local, salted and global combining of digest groups, with contents compared at each.

Texts are equal when they are identical after deleting ASCII white space. Of equal texts the row with the most
code points stays, then the one with the smallest doc_id (null ids last). A null text counts as empty.
An empty table gives an empty result.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, materialise, packed, text_or_empty

#: A digest group is spread over so many salts; each salt's part is combined by itself first.
SALTS = 32
#: Rows of a class from which the join back is salted too, and most such classes to broadcast.
HOT, BROADCAST_HOT = 1000, 200_000


def normalised(text: str | Column = "text") -> Column:
    return F.translate(text_or_empty(text), SPACES, "")


def digest(norm: Column) -> Column:
    return F.sha2(norm.cast("binary"), 256)


def _rank(text: str, doc_id: str) -> Column:
    """Smallest first: longest text, then smallest id, null ids last; one number, so that hash aggregation can hold it."""
    fill = F.lit(Decimal(10**20))
    short = (F.lit(2**31 - 1).cast("long") - F.length(text_or_empty(text))).cast("decimal(10,0)")
    ident = F.coalesce(F.col(doc_id).cast("decimal(20,0)") + F.lit(Decimal(2**63)), fill - 1)
    return (short * fill + ident).cast("decimal(38,0)")


def _id_of(rank: Column) -> Column:
    fill = F.lit(Decimal(10**20))
    ident = (rank % fill).cast("decimal(21,0)")
    return F.when(ident < fill - 1, (ident - F.lit(Decimal(2**63))).cast("long"))


def groups(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """rows (dig, content, rank) to one row for each class of equal contents: best rank, group_size.

    Level 1 is the map-side part of the first aggregation: each task keeps one row for each distinct
    (digest, content) it has read. Level 2 merges those of one salt, level 3 the salts' winners. All three group by the
    content itself beside its digest, so unequal texts with one digest stay apart.
    The salt comes from the task, so copies in one task meet before the shuffle, and a hot class sends
    each reducer one row for each task at most.
    """
    salted = rows.groupBy((F.spark_partition_id() % salts).alias("salt"), "dig", "content").agg(
        F.min("rank").alias("rank"), F.count(F.lit(1)).alias("n")
    )
    return salted.groupBy("dig", "content").agg(F.min("rank").alias("best"), F.sum("n").alias("group_size"))


def decisions(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", digest_of=digest, salts: int = SALTS, hot: int = HOT) -> DataFrame:
    """For each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 (the digest) and rank.

    Rows go back to their class by digest. Where a digest has several contents (never seen with sha256, tested with
    a weak digest), the content is part of the join key too. Rows of a large class are salted for that, and their class is
    repeated for each salt. Several identical rows (same id, same length) are all marked
    as kept here; :func:`deduplicate` keeps one of them.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), normalised(text).alias("content"), _rank(text, doc_id).alias("rank"))
    rows = rows.withColumn("dig", digest_of(F.col("content")))
    classes = materialise(groups(rows, salts).select("dig", "best", "group_size"))
    clash = [r.dig for r in classes.groupBy("dig").count().where("count > 1").limit(1001).collect()]
    if clash:
        mixed = F.lit(True) if len(clash) > 1000 else F.col("dig").isin(clash)
        key = F.when(mixed, F.col("content")).alias("content_key")
        classes = groups(rows, salts).select("dig", key, "best", "group_size")
    else:
        key = F.lit(None).cast("string").alias("content_key")
        classes = classes.select("dig", "best", "group_size", F.lit(None).cast("string").alias("content_key"))
    salt = F.lit(0)
    large = materialise(classes.where(F.col("group_size") > hot).select("dig").distinct())
    many = large.count()
    if many:
        large = large.withColumn("large", F.lit(True))
        large = F.broadcast(large) if many <= BROADCAST_HOT else large
        classes = classes.join(large, "dig", "left").withColumn("salt", F.explode(F.when(F.col("large"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
        # the salt is the task that read the row: behind a join by digest all rows of a class would have one
        rows = rows.withColumn("task", (F.spark_partition_id() % salts).cast("int")).join(large, "dig", "left")
        salt = F.when(F.col("large"), F.col("task")).otherwise(0)
    else:
        classes = classes.withColumn("salt", F.lit(0))
    left = rows.select("doc_id", "rank", "dig", key, salt.alias("salt"))
    on = [left.dig == classes.dig, left.salt == classes.salt] + ([left.content_key.eqNullSafe(classes.content_key)] if clash else [])
    return left.join(classes, on).select(
        "doc_id", _id_of(F.col("best")).alias("keep_id"), "group_size", (F.col("rank") == F.col("best")).alias("kept"),
        left.dig.alias("text_sha256"), "rank",
    )


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, all their columns unchanged; one row for each class, also of identical rows."""
    best = materialise(decisions(docs, text, doc_id, salts=salts).where("kept").groupBy("text_sha256", "rank").agg(F.count(F.lit(1)).alias("_rows")))
    best = best.select(F.col("text_sha256").alias("dig"), "rank", "_rows")
    keyed = packed(docs, dig=digest(normalised(text)), rank=_rank(text, doc_id))
    single = keyed.join(best.where("_rows = 1"), ["dig", "rank"], "left_semi").select("row.*")
    if best.where("_rows > 1").limit(1).count() == 0:
        return single
    repeated = keyed.join(best.where("_rows > 1"), ["dig", "rank"], "left_semi")
    return single.unionByName(repeated.dropDuplicates(["dig", "rank"]).select("row.*"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return decisions(docs).drop("rank")


ORACLE = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS len, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY len DESC, doc_id) AS rn,
        first_value(doc_id) OVER (PARTITION BY norm ORDER BY len DESC, doc_id) AS keep_id,
        count(*) OVER (PARTITION BY norm) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""
