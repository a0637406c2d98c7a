"""Operator 9, secret scans [native]: an incremental ledger of content-addressed blobs.

Every version of a text is named by the sha256 of its content (null counts as empty). A blob is scanned once for each
rule and rule version: pairs that the ledger has are skipped, and findings are joined back to all paths that hold the blob.
Spans are code points, end exclusive. Matches are leftmost and do not overlap within a rule.
Repeated texts are one blob, and each of their paths gets its findings; an empty table adds nothing to the ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_remainder, materialise, text_or_empty


@dataclass(frozen=True)
class Rule:
    name: str
    version: int
    pattern: str
    #: The match is a finding if this group of it has at least so many code points.
    group: int = 0
    least: int = 1
    #: A text without this string has no match; saves the pattern a pass.
    needs: str | None = None

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


#: The base kinds, in the order of ties. Runs that are too short are left out of the last two patterns,
#: which changes no match: a longer run never starts inside a shorter one.
BASE = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", needs="AKIA"),
    Rule("hex", 1, r"[0-9a-f]{24,}+"),
)
#: Rules beyond the base kinds: private key headers and prefixed personal tokens.
MORE = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", needs="PRIVATE KEY-----"),
    Rule("prefixed", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", needs="gh"),
)
RULES = BASE + MORE
SPANS = "array<struct<start:int,end:int>>"
LEDGER = f"blob string, rule string, version int, spans {SPANS}"


def spans(text: Column, rule: Rule) -> Column:
    """All findings of one rule: the pieces between matches and the matches give their places."""
    gaps, whole = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    size = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.length) if rule.group else F.transform(whole, F.length)
    parts = F.zip_with(F.zip_with(whole, size, lambda m, s: F.struct(F.length(m).alias("len"), s.alias("size"))), F.slice(gaps, F.lit(1), F.size(whole)), lambda m, g: F.struct(F.length(g).alias("gap"), m["len"].alias("len"), m["size"].alias("size")))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        end = start + p["len"]
        found = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(p["size"] >= rule.least, F.concat(acc["out"], found)).otherwise(acc["out"]).alias("out"))

    some = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out")), step, lambda acc: acc["out"])
    test = text.rlike(rule.pattern)
    if rule.needs:
        test = F.contains(text, F.lit(rule.needs)) & test
    return F.when(test, some).otherwise(F.array().cast(SPANS))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """New ledger rows (blob, rule, version, spans) for the blobs of ``versions``; a row without spans says: nothing found.

    Equal contents meet in the aggregation's map side first, and only distinct blobs are moved; the ledger meets them
    where they are, by blob, and only unseen pairs are scanned.
    """
    rows = versions.select(text_or_empty(text).alias("text"))
    blobs = rows.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("blob")).agg(F.min("text").alias("text"))
    if ledger is None:
        seen = blobs.withColumn("seen", F.array().cast("array<string>"))
    else:
        done = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws("@", "rule", F.col("version").cast("string"))).alias("seen"))
        seen = blobs.join(done, "blob", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
        seen = seen.where(F.size(F.array_except(F.array(*[F.lit(r.key) for r in rules]), F.col("seen"))) > 0)
    per_rule = [
        F.when(~F.array_contains("seen", r.key), F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), spans(F.col("text"), r).alias("spans"))) for r in rules
    ]
    found = seen.select("blob", F.explode(F.filter(F.array(*per_rule), lambda x: x.isNotNull())).alias("f"))
    return found.select("blob", "f.rule", "f.version", "f.spans")


def findings(versions: DataFrame, ledger: DataFrame, path: str = "path", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """path, blob and found (array of rule, start, end; by start, then the rules' order) for every version, from the ledger.

    The ledger must hold what scan() has added for these versions. Hot blobs are on the left side of the join, which
    adaptive execution can split; the right side has one row for each blob.
    """
    rank = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.key), F.lit(i))])
    known = ledger.withColumn("rank", rank[F.concat_ws("@", "rule", F.col("version").cast("string"))]).where(F.col("rank").isNotNull() & (F.size("spans") > 0))
    one = known.select("blob", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("rank").alias("rank"), F.col("rule").alias("rule"), s["end"].alias("end"))).alias("f"))
    per_blob = materialise(one.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("f"))).alias("found")))
    rows = versions.select(F.col(path).alias("path"), F.sha2(text_or_empty(text).cast("binary"), 256).alias("blob"))
    return rows.join(per_blob, "blob", "left").select("path", "blob", F.coalesce("found", F.array().cast(per_blob.schema["found"].dataType)).alias("found"))


def query(spark, sf_dir: str) -> DataFrame:
    """The ledger grows in two increments, as a history does: rows of even id hash first, then all rows, of which only unseen blobs are scanned."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ledger = materialise(scan(docs.where(id_remainder("doc_id", 2) == 0)))
    ledger = ledger.unionByName(materialise(scan(docs, ledger)))
    out = findings(docs, ledger, "doc_id")
    shown = lambda only: F.array_join(F.transform(only, lambda s: F.concat_ws(":", s["rule"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("found", lambda s: s["rank"] < len(BASE))
    count = lambda k: F.size(F.filter("found", lambda s: s["rule"] == k)).cast("long")
    return out.select(
        F.col("path").alias("doc_id"), *[count(r.name).alias(f"n_{r.name}") for r in BASE],
        F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"), shown(F.col("found")).alias("spans"),
    )


def _found_sql(name: str, pattern: str, rank: int, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, {rank} AS rank, '{name}' AS kind, CAST(st AS BIGINT) AS st, CAST(st + len(m) AS BIGINT) AS en FROM
 (SELECT doc_id, ms[i] AS m, gs[i] AS g, list_sum(list_transform(pieces[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: len(x))), 0) AS st FROM
 (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM
 (SELECT doc_id, string_split_regex(text, '{p}') AS pieces, regexp_extract_all(text, '{p}') AS ms, regexp_extract_all(text, '{p}', {group}) AS gs FROM d))) WHERE len(g) >= {least}"""


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(_found_sql(r.name, r.pattern.replace("}+", "}"), k, r.group, r.least) for k, r in enumerate(RULES))}),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
 string_agg(concat(kind, ':', st, ':', en), ',' ORDER BY st, rank) FILTER (rank < {len(BASE)}) AS base, string_agg(concat(kind, ':', st, ':', en), ',' ORDER BY st, rank) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
"""
