"""Operator 8 by true similarity, as the pipeline takes it: texts link if their sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

Fingerprints of the shingle sets meet by operator 8's pigeonhole search at ``RADIUS`` bits, 3 groups of 21 or 22 bits with thresholds
that sum to 6, and what they gather is checked on the whole shingle sets. No pair of similar texts within the radius is lost. A wider
search would be quadratic: pairs at the threshold lie up to 18 bits apart (README), and at 16 bits the parts let about one pair in
a hundred of all texts through. So pairs beyond the radius are proposed by MinHash bands beside the fingerprints, and
checked in the same way. Two texts at the threshold share a band with probability 1 - (1 - 0.8 ** ROWS) ** BANDS, that is 0.9994.

Words are those of the fingerprints: A-Z in lower case, split at ASCII white space. A text of fewer than five words is one
shingle, and texts without words are copies of each other. Nodes are distinct texts by two 64-bit hashes.

Gathered fingerprints and bands are buckets. A bucket's members meet the one that shares buckets with most texts, then
another where that left them apart. What is still apart goes through an exact filter on rare shingles and on what is left
behind them, so members of a bucket that are no copies of each other don't meet in pairs: see :func:`_candidates`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import components, materialise, text_or_empty
from .simhash import fingerprint_of_set, gatherings

SHINGLE, SIMILARITY, BANDS, ROWS, SEED = 5, 0.8, 40, 8, 42
#: Fingerprints meet at so many bits, in so many groups.
RADIUS, PARTS = 8, (3,)
_SALTS = np.random.default_rng(SEED).integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the text's shingles, sorted."""
    words = text.lower().split()
    if 0 < len(words) < shingle:
        words, shingle = [b" ".join(words)], 1
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared) if len(a) or len(b) else 1.0


def band_keys(grams: np.ndarray) -> np.ndarray:
    """One key for each band, from the smallest value of each of the band's permutations."""
    least = np.full(len(_SALTS), 2**64 - 1, np.uint64)
    for k in range(0, len(grams), 1024):
        z = grams[k : k + 1024, None] ^ _SALTS
        z *= np.uint64(0x9E3779B97F4A7C15)
        z ^= z >> np.uint64(32)
        z *= np.uint64(0xD6E8FEB86659FD93)
        np.minimum(least, z.min(axis=0), out=least)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), SEED) for b in least.reshape(BANDS, ROWS)], np.uint64).view(np.int64)


def signatures(texts: DataFrame) -> DataFrame:
    """node, n (distinct shingles), fp (their fingerprint) and keys (one for each band) of rows (node, text)."""

    def run(batches):
        for b in batches:
            sets = [shingles(t) for t in b.column(1).to_pylist()]
            keys = [band_keys(s).tolist() for s in sets]
            n, fps = (pa.array([f(s) for s in sets], pa.int64()) for f in (len, fingerprint_of_set))
            yield pa.RecordBatch.from_arrays([b.column(0), n, fps, pa.array(keys, pa.list_(pa.int64()))], ["node", "n", "fp", "keys"])

    return texts.select("node", F.col("text").cast("binary")).mapInArrow(run, "node long, n long, fp long, keys array<long>")


def _checked(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose whole texts are similar enough."""

    def run(batches):
        last: tuple[bytes, np.ndarray] = (b"", shingles(b""))
        for batch in batches:
            out = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if y != last[0]:
                    last = y, shingles(y)
                out.append(similarity(shingles(x), last[1]) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(out, pa.bool_())) for k in (0, 1)], ["a", "b"])

    of = lambda c: texts.select(F.col("node").alias(c), F.col("text").cast("binary").alias(f"text_{c}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "text_a", "text_b")
    return materialise(both.mapInArrow(run, "a long, b long"))


def links(texts: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Edges (a, b) between nodes of ``texts`` (node, text; one row a node) that connect the same components as all pairs do."""
    sig = materialise(signatures(texts))
    close_fps = gatherings(materialise(sig.select("fp").distinct()), RADIUS, PARTS)
    by_fp = sig.select("node", "n", "fp").join(close_fps, "fp").select("node", "n", (F.col("part") + (BANDS + 1)).alias("band"), "key")
    filed = sig.select("node", "n", F.posexplode("keys").alias("band", "key")).unionByName(by_fp)
    shared = materialise(filed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
    filed = materialise(filed.join(shared, ["band", "key"]))
    known = filed.groupBy("node").agg(F.sum("m").alias("known"))
    members = materialise(filed.join(known, "node").select("band", "key", "node", "n", "known"))
    some = materialise(texts.join(known.select("node"), "node", "left_semi"))
    close = lambda x, y: F.least(x, y) >= F.greatest(x, y) * F.lit(least)  # noqa: E731 - no pair of other sizes can be similar enough
    rooted = members.withColumn("root", F.col("node"))
    edges = None
    # a bucket's members meet the one that most texts share buckets with, then another where that left them apart
    for by in (-F.col("known"), F.xxhash64("node", "band")):
        hubs = materialise(rooted.groupBy("band", "key").agg(F.min(F.struct(by.alias("by"), "node", "n", "root")).alias("hub")))
        pairs = rooted.join(hubs, ["band", "key"]).where((F.col("root") != F.col("hub.root")) & close(F.col("n"), F.col("hub.n")))
        found = _checked(pairs.select(F.greatest("node", "hub.node").alias("a"), F.least("node", "hub.node").alias("b")).distinct(), some, least)
        edges = found if edges is None else materialise(edges.unionByName(found))
        roots = materialise(components(edges))
        rooted = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        apart = rooted.groupBy("band", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo < hi and m > 2")
        rooted = materialise(rooted.join(apart.select("band", "key"), ["band", "key"], "left_semi"))
    left = materialise(rooted.select("node", "n", "root").distinct())
    if not left.limit(1).count():
        return edges
    return edges.unionByName(_checked(_candidates(left, some, least), some, least))


def _candidates(nodes: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of nodes (node, n, root) of different roots that may be similar enough.

    Such a pair has a first common shingle in the order of how few of these texts have it. It is among the first n - ceil(least n) + 1
    of either, and behind it either must have enough shingles left for the overlap that the pair's sizes ask for.
    """

    def run(batches):
        for b in batches:
            sets = [shingles(t) for t in b.column(3).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in range(3)), pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64))], ["node", "n", "root", "gram"])

    rows = nodes.join(texts, "node").select("node", "n", "root", F.col("text").cast("binary"))
    grams = materialise(rows.mapInArrow(run, "node long, n long, root long, gram long"))
    common = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    rank = F.row_number().over(W.partitionBy("node").orderBy("df", "gram"))
    first = grams.join(common, "gram").withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * least - 1e-6) + 1)
    first = materialise(first.where("df > 1").select("node", "n", "root", "gram", "rank"))
    x, y = (first.select("gram", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "root", "rank")]) for s in "xy")
    close = F.least("n_x", "n_y") >= F.greatest("n_x", "n_y") * F.lit(least)
    enough = 1 + F.least(F.col("n_x") - F.col("rank_x"), F.col("n_y") - F.col("rank_y")) >= F.ceil((F.col("n_x") + F.col("n_y")) * (least / (1 + least)) - 1e-6)
    rest = x.join(y, "gram").where((F.col("node_x") < F.col("node_y")) & (F.col("root_x") != F.col("root_y")) & close & enough)
    return materialise(rest.select(F.col("node_y").alias("a"), F.col("node_x").alias("b")).distinct())


def text_name(text: str = "text") -> Column:
    return F.xxhash64(text_or_empty(text))


def _with_nodes(rows: DataFrame, clash: DataFrame | None) -> DataFrame:
    """``node`` beside text_hash and second: of the texts that share a text_hash, the first by ``second`` keeps it, others get a hash of both."""
    if clash is None:
        return rows.withColumn("node", F.col("text_hash"))
    other = F.when(F.col("second") != F.col("lo"), F.xxhash64("text_hash", "second"))
    return rows.join(clash, "text_hash", "left").withColumn("node", F.coalesce(other, "text_hash")).drop("lo")


def named(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: float = SIMILARITY) -> DataFrame:
    """doc_id, text_hash and root of every row of ``docs``; rows of one component of near copies have one root.

    A second hash tells apart the texts that share the first one, so texts are one only if 128 bits agree.
    """
    second = F.xxhash64(F.lit("second"), text_or_empty(text))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_name(text).alias("text_hash"), second.alias("second"), text_or_empty(text).alias("text"))
    own = materialise(rows.select("doc_id", "text_hash", "second"))
    several = own.groupBy("text_hash").agg(F.count(F.lit(1)).alias("n"), F.min("second").alias("lo"), F.max("second").alias("hi")).where("n > 1")
    again, clash = several.limit(1).count(), None
    if again:
        clash = materialise(several.where("lo < hi").select("text_hash", "lo"))
        clash = clash if clash.limit(1).count() else None
    texts, own = (_with_nodes(df, clash) for df in (rows, own))
    texts = texts.select("node", "text")
    if again:
        texts = texts.groupBy("node").agg(F.min("text").alias("text"))
    roots = components(links(texts, least)).withColumnRenamed("node", "of")
    return own.join(roots, own.node == roots.of, "left").select("doc_id", "text_hash", F.coalesce("root", "node").alias("root"))
