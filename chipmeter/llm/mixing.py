"""Operator 4, mixing sources to target weights: hierarchical budgets, then a token-prefix of seeded epochs for each leaf.

A leaf is a (domain, language, source); nulls count as the empty name. The token budget goes down the tree by weight. No
node gets more than its leaves hold in ``max_epochs`` passes. What a node cannot use goes to its siblings by their
weights; only when a whole family is full does its parent hand the rest to the parent's siblings. Each leaf then
takes whole passes over its documents and, in one last pass, documents in the order of a seeded hash as long as
the running sum of their tokens stays within the rest. Documents without tokens are never taken; an empty table gives an empty mix.
Shares are rounded down, so a mix is at most one token per node short.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, packed, text_or_empty

LEAF = ("_domain", "_lang", "_source")
#: Documents of a leaf that are sorted together, about; a leaf has as many sort buckets as it needs.
BUCKET_DOCS = 500
#: Most leaves to broadcast; more are joined without it.
BROADCAST_LEAVES = 100_000


@dataclass(frozen=True)
class Plan:
    """Weights are whole numbers from 0; a name without one has its level's default."""

    domains: Mapping[str, int] = field(default_factory=lambda: {"web": 4, "books": 3, "forums": 2, "news": 1})
    langs: Mapping[str, int] = field(default_factory=lambda: {"en": 6, "de": 3, "fr": 3, "es": 2})
    sources: Mapping[str, int] = field(default_factory=dict)
    default_domain: int = 1
    default_lang: int = 1
    default_source: int = 1
    #: The budget is this share of all tokens, in percent.
    percent: int = 60
    max_epochs: int = 2
    seed: int = 17


def source_domain(source: str | Column = "source") -> Column:
    """Domain of a source by the number its name ends with; the tables have no domain of their own."""
    col = F.col(source) if isinstance(source, str) else source
    number = F.try_to_number(F.nullif(F.regexp_extract(col, r"([0-9]{1,9})$", 1), F.lit("")), F.lit("999999999")).cast("int")
    return F.element_at(F.array(F.lit("web"), F.lit("books"), F.lit("forums"), F.lit("news")), (number % 4 + 1).cast("int"))


def n_tokens(text: str | Column = "text") -> Column:
    """Words between ASCII white space; pass another column to mix() to count real tokens."""
    return F.regexp_count(text_or_empty(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _weight(name: str, weights: Mapping[str, int], default: int) -> Column:
    out = F.lit(default)
    for k, w in weights.items():
        out = F.when(F.col(name) == k, F.lit(w)).otherwise(out)
    return out.cast("long")


def fill(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Add ``quota`` to nodes (parent..., name, cap, weight, budget): budget shared by weight, capped, rest to siblings.

    In the order of cap / weight the full ones come first: a node is full if its cap is within its share of
    what the nodes before it leave. One window for each family, on the tree's nodes only.
    """
    big = lambda c: F.col(c).cast("decimal(19,0)")
    order = W.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), name)
    nodes = nodes.where("weight > 0").withColumns({
        "_before": F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long"),
        "_from": F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)),
    })
    full = big("cap") * big("_from") <= big("weight") * (F.col("budget") - F.col("_before")).cast("decimal(19,0)")
    family = W.partitionBy(*parent)
    nodes = nodes.withColumn("_full", full).withColumns({
        "_used": F.sum(F.when(F.col("_full"), F.col("cap")).otherwise(0)).over(family),
        "_open": F.sum(F.when(F.col("_full"), 0).otherwise(F.col("weight"))).over(family),
    })
    share = F.expr("cast(weight as decimal(19,0)) * cast(budget - _used as decimal(19,0)) div nullif(_open, 0)")
    return nodes.withColumn("quota", F.when(F.col("_full"), F.col("cap")).otherwise(share)).drop("_before", "_from", "_full", "_used", "_open")


def budgets(leaves: DataFrame, plan: Plan) -> DataFrame:
    """leaves (LEAF, tokens, docs) with each leaf's quota of tokens; works on the tree's nodes alone."""
    leaves = leaves.withColumn("cap", F.col("tokens") * plan.max_epochs)
    langs = leaves.groupBy(*LEAF[:2]).agg(F.sum("cap").alias("cap"))
    domains = langs.groupBy(LEAF[0]).agg(F.sum("cap").alias("cap"))
    total = leaves.agg(F.least(F.sum("cap"), F.expr(f"sum(tokens) * {plan.percent} div 100")).alias("budget"))
    top = domains.withColumn("weight", _weight(LEAF[0], plan.domains, plan.default_domain)).join(total)
    top = fill(top.withColumn("_root", F.lit(0)), ["_root"], LEAF[0]).select(LEAF[0], F.col("quota").alias("budget"))
    mid = langs.join(top, LEAF[0]).withColumn("weight", _weight(LEAF[1], plan.langs, plan.default_lang))
    mid = fill(mid, [LEAF[0]], LEAF[1]).select(*LEAF[:2], F.col("quota").alias("budget"))
    low = leaves.join(mid, list(LEAF[:2])).withColumn("weight", _weight(LEAF[2], plan.sources, plan.default_source))
    return fill(low, list(LEAF[:2]), LEAF[2]).select(*LEAF, "tokens", "docs", "quota")


def mix(docs: DataFrame, plan: Plan = Plan(), domain: Column | None = None, tokens: Column | None = None, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", source: str = "source") -> DataFrame:
    """Rows of ``docs``, one for each pass that takes them, with ``domain``, ``tokens`` and ``epoch`` (from 0) added.

    Columns of ``docs`` with those names are replaced. Identical rows are different documents here.
    The columns that a caller drops, such as the text, are not moved.
    """
    domain = domain if domain is not None else source_domain(source)
    names = {k: F.coalesce(c.cast("string"), F.lit("")) for k, c in zip(LEAF, (domain, F.col(lang), F.col(source)))}
    count = tokens if tokens is not None else n_tokens(text)
    ties = F.xxhash64(F.col(text)) if text in docs.columns else F.lit(0)
    base = packed(docs, domain=domain, tokens=count.cast("long"), id=F.col(doc_id), tie=ties, **names).where("tokens > 0")
    leaves = materialise(base.groupBy(*LEAF).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")))
    quotas = materialise(budgets(leaves, plan).where("quota > 0").select(
        *LEAF, F.expr("quota div tokens").alias("_passes"), F.expr("quota % tokens").alias("_rest"), F.expr(f"docs div {BUCKET_DOCS} + 1").alias("_buckets"),
    ))
    small = quotas.count() <= BROADCAST_LEAVES
    keyed = base.join(F.broadcast(quotas) if small else quotas, list(LEAF))
    keyed = keyed.withColumn("_key", F.md5(F.concat_ws(":", F.lit(str(plan.seed)), F.col("_passes").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary")))
    keyed = keyed.withColumn("_bucket", F.expr("conv(substr(_key, 1, 8), 16, 10) * _buckets div 4294967296"))
    cell = [*LEAF, "_bucket"]
    before = W.partitionBy(*LEAF).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = keyed.groupBy(*cell).agg(F.sum("tokens").alias("_sum"))
    sums = materialise(sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum"))
    within = W.partitionBy(*cell).orderBy("_key", "id", "tie").rowsBetween(W.unboundedPreceding, 0)
    rows = keyed.join(sums, cell).withColumn("_end", F.col("_before") + F.sum("tokens").over(within))
    epochs = F.concat(
        F.when(F.col("_passes") > 0, F.sequence(F.lit(0), (F.col("_passes") - 1).cast("int"))).otherwise(F.array().cast("array<int>")),
        F.when(F.col("_end") <= F.col("_rest"), F.array(F.col("_passes").cast("int"))).otherwise(F.array().cast("array<int>")),
    )
    kept = [c for c in docs.columns if c not in ("domain", "tokens", "epoch")]
    return rows.withColumn("epoch", F.explode(epochs)).select(*[F.col(f"row.`{c}`") for c in kept], "domain", "tokens", "epoch")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counted = docs.select("doc_id", "lang", "source", n_tokens().alias("n"))
    return mix(counted, tokens=F.col("n")).select("doc_id", "domain", "lang", "source", "tokens", F.col("epoch").cast("long").alias("epoch"))


def _fill_sql(source: str, parent: str, name: str, keys: str) -> str:
    return f"""(SELECT {keys}, CASE WHEN is_full THEN cap ELSE weight * (budget - used) // nullif(open, 0) END AS quota FROM
 (SELECT *, sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER (PARTITION BY {parent}) AS used, sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER (PARTITION BY {parent}) AS open FROM
 (SELECT *, cap * from_w <= weight * (budget - before) AS is_full FROM
 (SELECT *, coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY cap / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
   sum(weight) OVER (PARTITION BY {parent} ORDER BY cap / weight, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS from_w FROM {source}))))"""


ORACLE = rf"""
WITH d AS (SELECT doc_id, lang, source, list_extract(['web', 'books', 'forums', 'news'], CAST(TRY_CAST(nullif(regexp_extract(source, '([0-9]{{1,9}})$', 1), '') AS INT) % 4 + 1 AS BIGINT)) AS domain,
   CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens FROM documents),
k AS (SELECT *, coalesce(domain, '') AS dk, coalesce(lang, '') AS lk, coalesce(source, '') AS sk FROM d WHERE tokens > 0),
leaves AS (SELECT dk, lk, sk, sum(tokens) AS tokens, sum(tokens) * 2 AS cap FROM k GROUP BY ALL),
tot AS (SELECT least(sum(cap), sum(tokens) * 60 // 100) AS budget FROM leaves),
l1 AS (SELECT dk, sum(cap) AS cap, CASE dk WHEN 'web' THEN 4 WHEN 'books' THEN 3 WHEN 'forums' THEN 2 WHEN 'news' THEN 1 ELSE 1 END AS weight, any_value(budget) AS budget, 0 AS root FROM leaves, tot GROUP BY dk),
q1 AS {_fill_sql("l1", "root", "dk", "dk")},
l2 AS (SELECT leaves.dk, lk, sum(cap) AS cap, CASE lk WHEN 'en' THEN 6 WHEN 'de' THEN 3 WHEN 'fr' THEN 3 WHEN 'es' THEN 2 ELSE 1 END AS weight, any_value(quota) AS budget FROM leaves JOIN q1 USING (dk) GROUP BY ALL),
q2 AS {_fill_sql("l2", "dk", "lk", "dk, lk")},
l3 AS (SELECT leaves.dk, leaves.lk, sk, cap, 1 AS weight, quota AS budget FROM leaves JOIN q2 USING (dk, lk)),
q3 AS {_fill_sql("l3", "dk, lk", "sk", "dk, lk, sk")},
r AS (SELECT k.*, quota // leaves.tokens AS passes, quota % leaves.tokens AS rest FROM k JOIN leaves USING (dk, lk, sk) JOIN q3 USING (dk, lk, sk) WHERE quota > 0),
o AS (SELECT *, sum(tokens) OVER (PARTITION BY dk, lk, sk ORDER BY md5(concat('17:', CAST(CAST(passes AS BIGINT) AS VARCHAR), ':', CAST(doc_id AS VARCHAR))), doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM r)
SELECT doc_id, domain, lang, source, tokens, unnest(range(0, CAST(passes AS BIGINT) + CASE WHEN upto <= rest THEN 1 ELSE 0 END)) AS epoch FROM o
"""
