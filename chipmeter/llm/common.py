"""Small helpers that the text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import materialise

#: The ASCII white space that separates words in the contracts, as code points 9 to 13 and 32.
SPACES = "\t\n\x0b\x0c\r "
#: Null ids sort behind every other id.
LAST_ID = 2**63 - 1


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def id_remainder(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo ``parts``: fixes which rows are held out."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(parts))


def order_id(doc_id: str | Column = "doc_id") -> Column:
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(col.cast("long"), F.lit(LAST_ID))


def packed(df: DataFrame, **added: Column) -> DataFrame:
    """``row``, a struct of all columns of ``df``, beside the added ones, so that no names clash; ``row.*`` unpacks it."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(k) for k, c in added.items()])


def bounded_sample(df: DataFrame, label: str, key: Column, per_class: int) -> DataFrame:
    """About ``per_class`` rows of each value of ``label``, at most 1.5 times as many, the same ones on every run.

    Class counts come from one aggregation; a row stays if a hash of its key falls under its class's rate,
    so nothing is sorted and no class is gathered in one task. The number of classes must be small (checked: 1,000).
    """
    counts = df.where(F.col(label).isNotNull()).groupBy(label).count().limit(1001).collect()
    if len(counts) > 1000:
        raise ValueError(f"{label} has more than 1,000 values")
    if not counts:
        return df.limit(0)
    grain = 1_000_000
    rate = F.lit(0)
    for value, n in counts:
        rate = F.when(F.col(label) == F.lit(value), F.lit(min(grain, -(-grain * per_class // n)))).otherwise(rate)
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(grain)) < rate).limit(int(per_class * 1.5) * len(counts) + 100)


def components(edges: DataFrame) -> DataFrame:
    """Connected components: (node, root), root the smallest node; nodes are those of the edges (a, b).

    Large-star and small-star rounds on an edge table, each a minimum per node and a join; the table is written after
    each round. Nothing is gathered: a hub's edges stay spread out, and only its minimum is combined.
    """
    e = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    sign = None
    while True:  # labels only fall, so rounds end
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        # large star: larger neighbours of u go to the smallest node near u
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.unionByName(low.where("m <> u").select("u", F.col("m").alias("v"))).distinct())
        # small star: u and its smaller neighbours go to the smallest of them
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == sign:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        sign = now


def one_per_component(docs: DataFrame, named: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with exactly one row of each component: the smallest id, nulls last; ties by the text's hash, then by the row's.

    ``named`` (doc_id, text_hash, root) has a row for each of ``docs``; text_hash is the xxhash64 of the text, null as empty.
    """
    keys = materialise(named.groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    best = keys.groupBy("root").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("m")).where("m > 1")
    gone = keys.join(best, "root").where(order != F.col("best")).select("doc_id", "text_hash")
    rows = packed(docs, i=F.col(doc_id).cast("long"), h=F.xxhash64(text_or_empty(text)))
    on = lambda k: rows.i.eqNullSafe(k.doc_id) & (rows.h == k.text_hash)
    gone = materialise(gone)
    out = rows.join(gone, on(gone), "left_anti")
    again = materialise(keys.where("n > 1").select("doc_id", "text_hash"))
    if again.limit(1).count():  # rows of the same id and text
        twice = out.join(again, out.i.eqNullSafe(again.doc_id) & (out.h == again.text_hash), "left_semi")
        one = twice.groupBy("i", "h").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
        once = out.join(again, out.i.eqNullSafe(again.doc_id) & (out.h == again.text_hash), "left_anti")
        return once.select("row.*").unionByName(one.select("row.*"))
    return out.select("row.*")
