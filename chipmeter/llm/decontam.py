"""Operator 6, benchmark decontamination [native]: a broadcast set of benchmark word windows against all text windows.

Words are maximal runs of digits, letters a-z (after lower-casing A-Z) and characters above 0x7F. An item's windows
are its runs of ``n`` words; an item with fewer words, but not none, is one window. A word of a document is hit if it lies
in any occurrence of any window. Null texts have no words. Every row is judged by its own text alone, so repeated rows get the
same result each and there are no ties. Without documents the result is empty, without benchmark items nothing is hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, packed

N = 10
#: Most windows that travel as a constant of the plan; the windows of a larger benchmark are joined, by broadcast up to the second number.
BLOCK, BROADCAST = 100_000, 4_000_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BREAKS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
#: A word in the original text, before lower-casing.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: str | Column = "text") -> Column:
    col = F.col(text) if isinstance(text, str) else text
    flat = F.translate(F.coalesce(col, F.lit("")), _UPPER + _BREAKS, _UPPER.lower() + " " * len(_BREAKS))
    return F.filter(F.split(flat, " "), lambda w: w != "")


def _joined(a: Column, b: Column, shift: int) -> Column:
    """Hash of window i of ``a`` with window i + shift of ``b``, for every i that both have."""
    left = F.greatest(F.size(b) - shift, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), left), F.slice(b, F.lit(shift + 1), left), lambda x, y: F.xxhash64(x, y))


def with_windows(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """Add h<L>, the hashes of all windows of L words of the column ``words``, by doubling: 1, 2, 4, ... then their sums."""
    base = rows.columns
    rows = rows.withColumn("h1", F.transform("words", lambda w: F.xxhash64(w)))
    step, have = 1, [1]
    while 2 * step <= max(lengths, default=1):
        rows = rows.withColumn(f"h{2 * step}", _joined(F.col(f"h{step}"), F.col(f"h{step}"), step))
        step *= 2
        have.append(step)
    for length in sorted(set(lengths) - set(have)):
        done = 0
        for p in reversed([p for p in have if length & p and p & (p - 1) == 0]):
            name = f"h{done + p}" if done + p == length else f"_h{length}_{done + p}"
            if done:
                rows = rows.withColumn(name, _joined(F.col(last), F.col(f"h{p}"), done))
            last, done = (name, done + p) if done else (f"h{p}", p)
    return rows.select(*base, *[f"h{x}" for x in sorted(set(lengths))])


def windows(benchmark: DataFrame, text: str = "text", item_id: str = "item_id", n: int = N) -> DataFrame:
    """Distinct benchmark windows: len, hash, gram (words), items (array of ids as strings)."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), words(text).alias("words")).where(F.size("words") > 0)
    items = items.withColumn("len", F.least(F.size("words"), F.lit(n)))
    starts = items.select("item", "words", "len", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("len") + 1)).alias("at"))
    grams = starts.select("item", "len", F.expr("slice(words, at, len)").alias("gram"))
    grams = grams.groupBy("len", "gram").agg(F.collect_set("item").alias("items"))
    return materialise(grams)


def _row_key(text: str, doc_id: str) -> list[Column]:
    """Results depend on the text alone; id and text hash bring them back to their row, also where ids repeat."""
    return [F.col(doc_id).alias("_id"), F.xxhash64(F.col(text)).alias("_text")]


def candidates(docs: DataFrame, grams: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = N, block: int = BLOCK, broadcast: int = BROADCAST) -> DataFrame:
    """One row for each row of ``docs``: _id, _text, n_words and found (start, len, gram), its windows whose hash is in the set.

    The set of window hashes goes to every task as a constant of the plan and is probed inside each row, so that no
    window becomes a row of its own unless it is found. Beyond ``block`` windows the documents' windows become rows
    of (key, start, len, hash), still in one pass, and meet the set in a join; only those found move with their document.
    """
    lengths = [r.len for r in grams.select("len").distinct().collect()]  # n and shorter lengths only
    rows = with_windows(docs.select(*_row_key(text, doc_id), words(text).alias("words")), lengths or [n])
    kind = "array<struct<start:int,len:int,gram:array<string>>>"
    hashed = None
    for length in lengths:
        g = with_windows(grams.where(F.col("len") == length).withColumnRenamed("gram", "words"), [length])
        g = g.select("len", F.col(f"h{length}")[0].alias("hash")).distinct()
        hashed = g if hashed is None else hashed.unionByName(g)
    total = hashed.count() if lengths else 0
    n_words = F.size("words").cast("long").alias("n_words")
    if total <= block:
        found = [F.array().cast(kind)]
        for length in lengths:
            few = [r.hash for r in hashed.where(F.col("len") == length).select("hash").collect()]
            known = ",".join(f"{h}L" if h > -(2**63) else "bigint('-9223372036854775808')" for h in few)
            at = f"filter(transform(h{length}, (x, i) -> if(x in ({known}), i, null)), i -> i is not null)"
            found.append(F.expr(f"transform({at}, i -> struct(i as start, {length} as len, slice(words, i + 1, {length}) as gram))"))
        return materialise(rows.select("_id", "_text", n_words, F.concat(*found).alias("found")))
    each = F.concat(*[F.expr(f"transform(h{x}, (h, i) -> struct(i as start, {x} as len, h as hash))") for x in lengths])
    each = rows.select("_id", "_text", F.explode(each).alias("w")).select("_id", "_text", "w.start", "w.len", "w.hash")
    hashed = materialise(hashed)
    each = each.join(F.broadcast(hashed) if total <= broadcast else hashed, ["len", "hash"])
    at = materialise(each.groupBy(F.col("_id").alias("i"), F.col("_text").alias("t")).agg(F.collect_set(F.struct("start", "len")).alias("at")))
    rows = docs.select(*_row_key(text, doc_id), words(text).alias("words"))
    rows = rows.join(at, rows["_id"].eqNullSafe(at.i) & rows["_text"].eqNullSafe(at.t), "left")
    found = F.coalesce(F.expr("transform(at, x -> struct(x.start as start, x.len as len, slice(words, x.start + 1, x.len) as gram))"), F.array().cast(kind))
    return materialise(rows.select("_id", "_text", n_words, found.alias("found")))


def hits(found: DataFrame, grams: DataFrame) -> DataFrame:
    """_id, _text, spans (array of start, len; starts from 0), items: one row for each (id, text) with a verified window.

    ``found`` is what candidates() gives; verification joins on the words themselves.
    """
    each = found.where(F.size("found") > 0).select("_id", "_text", F.explode("found").alias("f")).select("_id", "_text", "f.start", "f.len", "f.gram")
    each = each.join(grams, ["len", "gram"]).select("_id", "_text", F.struct("start", "len").alias("span"), "items")
    return each.groupBy("_id", "_text").agg(
        F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )


def _covered(spans: Column) -> Column:
    """Distinct word numbers inside the spans."""
    return F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1))))


def report(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = N) -> DataFrame:
    """For each row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    grams = windows(benchmark, n=n)
    rows = candidates(docs, grams, text, doc_id, n)
    found = hits(rows, grams).select(
        F.col("_id").alias("_i"), F.col("_text").alias("_t"), F.size(_covered(F.col("spans"))).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.array_join("items", ",").alias("items"),
    )
    out = rows.join(found, F.col("_id").eqNullSafe(F.col("_i")) & F.col("_text").eqNullSafe(F.col("_t")), "left")
    return out.select(
        F.col("_id").alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")).cast("binary"), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text: str = "text", doc_id: str = "doc_id", n: int = N) -> DataFrame:
    """``docs`` without contaminated rows (``documents``), or with hit words taken out of their texts (``spans``)."""
    grams = windows(benchmark, n=n)
    found = hits(candidates(docs, grams, text, doc_id, n), grams)
    found = materialise(found.select("_id", "_text", _covered(F.col("spans")).alias("hit")))
    id_key, text_key = _row_key(text, doc_id)
    rows = packed(docs, i=id_key, t=text_key)
    on = rows.i.eqNullSafe(found["_id"]) & rows.t.eqNullSafe(found["_text"])
    if remove == "documents":
        return rows.join(found, on, "left_anti").select("row.*")
    if remove != "spans":
        raise ValueError(remove)
    col = F.col(f"row.`{text}`")
    rest = F.zip_with(F.split(col, WORD, -1), F.regexp_extract_all(col, F.lit(WORD), F.lit(0)), lambda gap, word: F.struct(gap.alias("gap"), word.alias("word")))
    kept = F.transform(rest, lambda p, i: F.concat(p["gap"], F.when(F.array_contains("hit", i), "").otherwise(F.coalesce(p["word"], F.lit("")))))
    new = F.when(F.col("hit").isNull(), col).otherwise(F.array_join(kept, ""))
    return rows.join(found, on, "left").withColumn("row", F.col("row").withField(f"`{text}`", new)).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM benchmark),
g0 AS (SELECT item_id, ws, least(10, len(ws)) AS k FROM b WHERE len(ws) > 0),
g AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS gram FROM (SELECT item_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM g0)),
ks AS (SELECT DISTINCT k FROM g),
dw AS (SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS gram FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, ks WHERE len(ws) >= k)),
h AS (SELECT dw.doc_id, dw.k, dw.i, g.item_id FROM dw JOIN g ON dw.k = g.k AND dw.gram = g.gram),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN it USING (doc_id)
"""
