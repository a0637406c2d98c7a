"""Operator 8, SimHash near-dedup: generalised pigeonhole over groups of correlated bits.

A fingerprint has 64 bits: a bit is 1 if more than half of the XXH64 hashes (seed 42) of the text's 3-word shingles
have it set; repeats count. A text without words has fingerprint zero. Fingerprints link at ``radius`` or fewer
differing bits, and documents of linked fingerprints form one component, named by its smallest doc_id. Repeated
rows are rows of their own with equal fingerprints, so they are linked; an empty table gives an empty result.

Search works on distinct fingerprints. Bits are dealt into a number of groups so that correlated bits share a group. If
the groups' thresholds sum to ``radius - groups + 1``, two fingerprints within ``radius`` are within the threshold of
one group at least (-1: group not used). A dynamic programme picks the thresholds with the least estimated cost, of keys and
candidates, for each number of groups in ``parts``, and the cheapest number is used: 4 groups of 16 bits at thresholds of 0
while fingerprints are few, up to 2 groups of 32 bits at thresholds of 1 when they are many.
Each fingerprint is filed under every value of a group within half its threshold, rounded up, so two within the threshold
share one; members of a bin are verified.
Bins above ``bin_cap`` members take another exact way whose work is linear in the members: see :func:`_meet`.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialise, one_per_component, text_or_empty

SHINGLE, RADIUS, PARTS, BIN_CAP, SEED = 3, 3, (4, 3, 2), 4096, 42
#: A key of a fingerprint costs as much as so many candidates.
PROBE = 8.0
#: Bins of so many members are first looked through together.
SMALL_BIN = 64
_BITS = np.arange(64, dtype=np.uint64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of a text in UTF-8."""
    words = text.lower().split()  # of bytes: A-Z only, and white space \\x09-\\x0D and \\x20 only
    if not words:
        return 0
    if len(words) < shingle:
        grams: Iterator[bytes] = iter([b" ".join(words)])
        n = 1
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
        n = len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    while len(h := np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in itertools.islice(grams, 65536)), np.uint64)):
        ones += _ones(h)
    return _majority(ones, n)


def _ones(h: np.ndarray) -> np.ndarray:
    """How many hashes have each bit set."""
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _majority(ones: np.ndarray, n: int) -> int:
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprint_of_set(h: np.ndarray) -> int:
    """Signed 64-bit fingerprint of distinct shingles, from their hashes; zero for none."""
    return _majority(sum((_ones(h[k : k + 65536]) for k in range(0, len(h), 65536)), np.zeros(64, np.int64)), len(h))


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (long) and text_hash of every row, whole texts; null texts count as empty."""

    def run(batches):
        for b in batches:
            fps = [fingerprint(t, shingle) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), b.column(2)], ["doc_id", "fp", "text_hash"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).cast("binary").alias("text"), F.xxhash64(text_or_empty(text)).alias("text_hash"))
    return rows.mapInArrow(run, "doc_id long, fp long, text_hash long")


def correlations(fps: DataFrame) -> np.ndarray:
    """How far each two of the 64 bits agree or disagree, over all fingerprints."""

    def run(batches):
        total = np.zeros((64, 64))
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            x = ((fp[:, None] >> _BITS) & np.uint64(1)).astype(np.float64) * 2 - 1
            total += x.T @ x
        i, j = np.triu_indices(64, 1)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "s"])

    corr = np.zeros((64, 64))
    for i, j, s in fps.select("fp").mapInArrow(run, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        corr[i, j] = corr[j, i] = abs(s)
    return corr


def bit_groups(corr: np.ndarray, parts: int) -> list[list[int]]:
    """Deal the 64 bits into groups of correlated bits."""
    left, out = list(range(64)), []
    for k in range(parts, 0, -1):
        take = [max(left, key=lambda b: corr[b, left].sum())]
        while len(take) < len(left) / k:
            rest = [b for b in left if b not in take]
            take.append(max(rest, key=lambda b: corr[b, take].sum()))
        out.append(sorted(take))
        left = [b for b in left if b not in take]
    return out


def _value(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    fp = fp.view(np.uint64)
    out = np.zeros(len(fp), np.int64)
    for k, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


def _masks(width: int, most: int) -> np.ndarray:
    """All masks of ``width`` bits with at most ``most`` ones."""
    return np.array([sum(1 << b for b in c) for k in range(most + 1) for c in itertools.combinations(range(width), k)], np.int64)


def _half(tau: int) -> int:
    """Two values within ``tau`` bits have one between them that is within so many of both; -1 stays."""
    return -(-tau // 2) if tau > 0 else tau


def signatures(fps: DataFrame, groups: list[list[int]], taus: list[int]) -> DataFrame:
    """fp filed under (part, key) for every key within half the part's threshold of its value: fps within the threshold share a key."""
    masks = [_masks(len(g), _half(t)) for g, t in zip(groups, taus)]

    def run(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            for i, (g, m) in enumerate(zip(groups, masks)):
                if len(m):
                    key = (_value(fp, g)[:, None] ^ m).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), i, np.int32)), pa.array(key), pa.array(np.repeat(fp, len(m)))], ["part", "key", "fp"])

    return fps.select("fp").mapInArrow(run, "part int, key long, fp long")


def thresholds(fps: DataFrame, groups: list[list[int]], radius: int = RADIUS) -> tuple[float, list[int]]:
    """Thresholds of -1 or more that sum to radius - parts + 1 and cost least, and their cost.

    A group's candidates at threshold t are estimated from the counts of its values, over all fingerprints: pairs with
    equal values at 0, and at each step more as many times as there are masks. Each mask of half the threshold also costs a
    key for every fingerprint. The programme goes over groups and sums.
    """
    counts = signatures(fps, groups, [0] * len(groups)).groupBy("part", "key").count()
    sums = counts.groupBy("part").agg(F.sum("count").alias("n"), F.sum(F.col("count").cast("double") * F.col("count")).alias("pairs")).collect()
    rows, pairs = {r.part: r.n for r in sums}, {r.part: r.pairs - r.n for r in sums}
    masks = lambda g, t: sum(math.comb(len(g), k) for k in range(t + 1))
    want = radius - len(groups) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i, g in enumerate(groups):
        step: dict[int, tuple[float, list[int]]] = {}
        for have, (cost, taus) in best.items():
            for t in range(-1, radius + 1):
                c = cost + PROBE * rows.get(i, 0) * masks(g, _half(t)) + pairs.get(i, 0.0) * masks(g, t)
                if have + t not in step or c < step[have + t][0]:
                    step[have + t] = (c, [*taus, t])
        best = step
    return best[want]


def plan(fps: DataFrame, radius: int = RADIUS, parts: tuple[int, ...] = PARTS) -> tuple[list[list[int]], list[int]]:
    """Groups and thresholds of the cheapest number of parts: few narrow ones for few fingerprints, wider ones for more."""
    corr = correlations(fps)
    plans = [(thresholds(fps, groups, radius), groups) for groups in (bit_groups(corr, p) for p in parts if p <= radius + 1)]
    (_, taus), groups = min(plans, key=lambda p: p[0][0])
    return groups, taus


def _forest(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Each member of a bin and the smallest member that links within the bin reach; only where these differ."""
    fp = np.unique(fp)
    a, root = [], []
    left = fp.view(np.uint64)
    while len(left) > 1:
        seed, left = left[0], left[1:]
        front = [seed]
        while front and len(left):
            near = np.bitwise_count(left ^ front.pop()) <= radius
            found = left[near]
            left = left[~near]
            a.extend(found)
            root.extend([seed] * len(found))
            front.extend(found)
    return np.array(a, np.uint64).view(np.int64), np.array(root, np.uint64).view(np.int64)


def _bins(fps: DataFrame, radius: int, parts: tuple[int, ...], bin_cap: int) -> tuple[DataFrame, DataFrame | None, list[list[int]], list[int]]:
    """Edges (a, b) that connect what links within each bin, the rows (part, key, fp) of bins above the cap, bit groups, thresholds."""
    groups, taus = plan(fps, radius, parts)
    sig = signatures(fps, groups, taus)
    large = materialise(sig.groupBy("part", "key").count().where(F.col("count") > bin_cap))

    def verify(batches):
        for b in batches:
            col = b.column(0)
            flat, off = col.flatten().to_numpy(zero_copy_only=False), np.diff(col.offsets.to_numpy())
            start = np.concatenate([[0], np.cumsum(off)])
            two = start[:-1][off == 2]
            x, y = flat[two], flat[two + 1]
            near = np.bitwise_count((x ^ y).view(np.uint64)) <= radius
            out = [(x[near], y[near])]
            for n in np.unique(off[off > 2]):
                at = start[:-1][off == n]
                if n <= SMALL_BIN:  # most of these hold no two that are near
                    fp = flat[at[:, None] + np.arange(n)].view(np.uint64)
                    some = np.zeros(len(at), bool)
                    for k in range(1, n):
                        some |= (np.bitwise_count(fp[:, k:] ^ fp[:, :-k]) <= radius).any(axis=1)
                    at = at[some]
                out += [_forest(flat[k : k + n], radius) for k in at]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out]).astype(np.int64)) for i in (0, 1)], ["a", "b"])

    small = sig.join(large.select("part", "key"), ["part", "key"], "left_anti")
    bins = small.groupBy("part", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    out = bins.select("fps").mapInArrow(verify, "a long, b long")
    hot = materialise(sig.join(large.select("part", "key"), ["part", "key"], "left_semi")) if large.limit(1).count() else None
    return out, hot, groups, taus


def links(fps: DataFrame, radius: int = RADIUS, parts: tuple[int, ...] = PARTS, bin_cap: int = BIN_CAP) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that connect the same components as all links do."""
    out, hot, groups, taus = _bins(fps, radius, parts, bin_cap)
    if hot is not None:
        for i, t in enumerate(taus):
            if t >= 0:
                free = [b for b in range(64) if t > 0 or b not in groups[i]]
                out = out.unionByName(_meet(hot.where(F.col("part") == i).select("fp").distinct(), free, radius))
    return out.distinct()


def gatherings(fps: DataFrame, radius: int, parts: tuple[int, ...], bin_cap: int = BIN_CAP) -> DataFrame:
    """Distinct fingerprints ``fp`` under names (part, key), so that any two within ``radius`` share a name, and each has one of its own.

    Part -1 names what links within a bin by one of its members. Bins above the cap are names themselves, whole and
    unverified: for a caller that checks what it gathers in work linear in the members.
    """
    out, hot, _, _ = _bins(fps, radius, parts, bin_cap)
    near = out.distinct().select(F.lit(-1).alias("part"), F.col("b").alias("key"), F.col("a").alias("fp"))
    named = near.unionByName(fps.select(F.lit(-1).alias("part"), F.col("fp").alias("key"), "fp"))
    return materialise(named if hot is None else named.unionByName(hot.select("part", "key", "fp")))


def _meet(fps: DataFrame, free: list[int], radius: int) -> DataFrame:
    """Edges among fingerprints that may differ in the bits ``free`` only; work linear in their number.

    Two fingerprints within r bits have a value between them that is within r // 2 of one and r - r // 2 of the other.
    All that are within those distances of a value are within r of each member of its inner ring, so if the ring
    has a member they are one component, and one edge each to the ring's smallest member says so.
    """
    near = radius // 2
    rings = [np.array([sum(1 << free[b] for b in c) for c in itertools.combinations(range(len(free)), k)], np.uint64).view(np.int64) for k in range(radius - near + 1)]
    mask = np.concatenate(rings)
    inner = np.concatenate([np.full(len(m), k <= near) for k, m in enumerate(rings)])

    def run(batches):
        for b in batches:
            for fp in np.array_split(b.column(0).to_numpy(zero_copy_only=False), max(1, -(-b.num_rows // 256))):
                z = (fp[:, None] ^ mask).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(z), pa.array(np.repeat(fp, len(mask))), pa.array(np.tile(inner, len(fp)))], ["z", "fp", "inner"])

    met = fps.repartition(F.col("fp")).mapInArrow(run, "z long, fp long, inner boolean")
    hubs = met.where("inner").groupBy("z").agg(F.min("fp").alias("hub"))
    return met.join(hubs, "z").where("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b"))


def _rooted(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, radius: int = RADIUS, parts: tuple[int, ...] = PARTS, bin_cap: int = BIN_CAP) -> DataFrame:
    """doc_id, text_hash, fp, root (smallest fingerprint of the component) and component_id of every row."""
    own = materialise(fingerprints(docs, text, doc_id, shingle))
    classes = materialise(own.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(classes, radius, parts, bin_cap))
    named = classes.join(roots, classes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = materialise(named)
    names = materialise(named.groupBy("root").agg(F.min("first").alias("component_id")))
    by_fp = materialise(named.join(names, "root").select("fp", "root", "component_id"))
    return own.join(by_fp, "fp")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **params) -> DataFrame:
    """doc_id, fp and component_id of every row. Null ids belong to components but never name one with other ids."""
    return _rooted(docs, text, doc_id, **params).select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float | None = None, **params) -> DataFrame:
    """``docs`` with one row of each component: the smallest doc_id, nulls last; ties by the text's hash.

    With ``similarity``, texts link by a Jaccard similarity of their shingle sets of at least so much; fingerprints
    and their bins propose the close ones, and whole texts decide: see :mod:`.near_copies`.
    """
    from . import near_copies  # which takes the fingerprint search from here

    named = near_copies.named(docs, text, doc_id, similarity, **params) if similarity else _rooted(docs, text, doc_id, **params)
    return one_per_component(docs, named, text, doc_id)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
