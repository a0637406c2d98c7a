"""The pipeline's near-copy stage against brute force."""

import random

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from chipmeter.llm import exact_dedup, near_copies, simhash
from chipmeter.llm.common import materialise

from .test_rows import check_rows, repeated_ids

SCHEMA = "doc_id long, text string, source string"


def brute(texts):
    """Pairs of texts with Jaccard 0.8 or more over 5-word shingles."""
    sets = []
    for t in texts:
        w = t.encode().lower().split()
        sets.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    order = sorted(range(len(sets)), key=lambda k: len(sets[k]))
    for n, i in enumerate(order):
        for j in order[n + 1 :]:
            if len(sets[i]) < 0.8 * len(sets[j]):
                break
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                yield i, j


def brute_kept(rows):
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in brute([r.text or "" for r in rows]):
        root[find(i)] = find(j)
    best = {}
    for k, r in enumerate(rows):
        best[find(k)] = min(best.get(find(k), r.doc_id), r.doc_id)
    return sorted(best.values())


def test_stage_finds_near_copies_of_the_documents(spark):
    docs = materialise(exact_dedup.deduplicate(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))
    rows = docs.collect()
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, None).collect())
    assert got == brute_kept(rows) and len(got) < len(rows)


def test_stage_takes_similarity_not_fingerprints(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows, k = [], 0
    for start in range(0, 60, 2):  # shifted windows: neighbours are similar, the ends are not
        rows.append((k, " ".join(base[start : start + 120]), "s"))
        k += 1
    rows += [(100, "a b c", "s"), (101, "A  b c", "s"), (102, "a b d", "s"), (103, " ", "s"), (104, None, "s")]
    docs = materialise(spark.createDataFrame(rows, SCHEMA))
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, None).collect())
    assert got == brute_kept(docs.collect()) == [0, 100, 102, 103]


def test_stage_with_null_and_repeated_ids(spark):
    check_rows(corpus_pipeline.drop_near_copies(spark, repeated_ids(spark), None))


def test_texts_that_share_a_hash_stay_apart(spark, monkeypatch):
    """With three names for all texts the components are those of brute force."""
    rng = random.Random(7)
    rows = []
    for k in range(24):
        words = [f"w{rng.randrange(10**6)}" for _ in range(80)]
        rows += [(3 * k, " ".join(words)), (3 * k + 1, " ".join(words[:-2])), (3 * k + 2, " ".join(words) if k % 2 else None)]
    docs = materialise(spark.createDataFrame(rows, "doc_id long, text string"))
    monkeypatch.setattr(near_copies, "text_name", lambda text: F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(3)))
    got = {}
    for r in near_copies.named(docs).collect():
        got.setdefault(r.root, set()).add(r.doc_id)
    want = [{3 * k, 3 * k + 1} | ({3 * k + 2} if k % 2 else set()) for k in range(24)] + [{3 * k + 2 for k in range(0, 24, 2)}]
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))


def test_stage_finds_copies_by_fingerprints_without_bands(spark, monkeypatch):
    """Every pair of similar texts within the radius is found when no two texts share a band; bins above the cap count too."""
    rng = random.Random(11)
    rows = []
    for k in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(150)]
        rows += [(3 * k, " ".join(words)), (3 * k + 1, " ".join(words[:-1])), (3 * k + 2, " ".join([*words, "x", "y"]))]
    fps = [simhash.fingerprint_of_set(near_copies.shingles(t.encode())) for _, t in rows]
    near = [(i, j) for i, j in brute([t for _, t in rows]) if bin((fps[i] ^ fps[j]) & (2**64 - 1)).count("1") <= near_copies.RADIUS]
    assert len(near) > 80
    docs = materialise(spark.createDataFrame(rows, "doc_id long, text string"))
    plain = near_copies.signatures
    monkeypatch.setattr(near_copies, "signatures", lambda texts: plain(texts).withColumn("keys", F.array("node")))
    for cap in (simhash.BIN_CAP, 2):
        monkeypatch.setattr(simhash.gatherings, "__defaults__", (cap,))
        root = {r.doc_id: r.root for r in near_copies.named(docs).collect()}
        assert all(root[rows[i][0]] == root[rows[j][0]] for i, j in near)
        assert all(len({r for d, r in root.items() if d // 3 == k} & {r for d, r in root.items() if d // 3 != k}) == 0 for k in range(40))


def test_gathered_fingerprints_hold_all_pairs_within_the_radius(spark):
    rng = np.random.default_rng(5)
    fps = {int(b) for b in rng.integers(-(2**63), 2**63, 300)}
    for b in sorted(fps)[:60]:
        for _ in range(6):
            fps.add(b ^ sum(1 << int(k) for k in rng.choice(63, rng.integers(1, 10), replace=False)))
    fps = sorted(fps)
    near = [(a, b) for n, a in enumerate(fps) for b in fps[n + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= 8]
    assert len(near) > 300
    df = materialise(spark.createDataFrame([(f,) for f in fps], "fp long"))
    for cap in (4096, 3):
        names = {}
        for r in simhash.gatherings(df, 8, (3,), cap).collect():
            names.setdefault(r.fp, set()).add((r.part, r.key))
        assert len(names) == len(fps) and all(names[a] & names[b] for a, b in near)
