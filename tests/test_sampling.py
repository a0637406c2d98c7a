"""Balancing by hand-made rows, quotas, unknown bins, and percentiles with ties."""

import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from chipmeter.operators import metrics as M
from chipmeter.operators import sampling as S

BINS = ("a", "b", "c", "d")


def test_size_targets_by_the_smallest_bin(spark):
    # a: smallest 10, so 10 to 20. b: smallest 2 is below 3, so 3 to 6. c: one bin alone stays
    rows = [("a", "s", 10), ("a", "m", 20), ("a", "l", 21), ("a", "x", 11), ("b", "s", 2), ("b", "m", 3), ("b", "l", 7), ("b", "x", 6), ("c", "s", 50)]
    got = {(r.sza_bin, r.size_bin): r.target for r in S.size_targets(spark.createDataFrame(rows, "sza_bin string, size_bin string, c long"), 2.0, 3).collect()}
    assert got == {("a", "s"): 10, ("a", "m"): 20, ("a", "l"): 20, ("a", "x"): 11, ("b", "s"): 3, ("b", "m"): 3, ("b", "l"): 6, ("b", "x"): 6, ("c", "s"): 50}
    odd = S.size_targets(spark.createDataFrame([("a", "s", 5), ("a", "m", 8)], "sza_bin string, size_bin string, c long"), 1.5, 3)
    assert {r.size_bin: r.target for r in odd.collect()} == {"s": 5, "m": 7}  # int(1.5 * 5)


def test_copies_and_draws_reach_the_targets(spark):
    rows = spark.createDataFrame([(k, "a", "s" if k < 4 else "l") for k in range(30)], "chip long, sza_bin string, size_bin string")
    t = spark.createDataFrame([("a", "s", 10), ("a", "l", 7)], "sza_bin string, size_bin string, target long")
    got = Counter((r.size_bin, r.chip) for r in S.to_targets(rows, t, ["sza_bin", "size_bin"]).collect())
    small = [n for (s, _), n in got.items() if s == "s"]
    assert sorted(small) == [2, 2, 3, 3] and sum(n for (s, _), n in got.items() if s == "l") == 7 == sum(s == "l" for s, _ in got)


@pytest.fixture(scope="module")
def chips(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice("aabbbbc") if k % 9 else "unknown", rng.randrange(3)) for k in range(2000)] + [(5000 + k, "d", k % 2) for k in range(6)]
    return spark.createDataFrame(rows, "chip long, sza_bin string, n_objects int")


def test_split_never_tests_unknown_bins(chips):
    got = S.stratified_split(chips, 0.1, 0.15, (*BINS, "absent")).collect()
    n = Counter((r.sza_bin, r.split) for r in got)
    assert len(got) == chips.count()
    each = round(2006 * 0.1) // 4  # four bins occur; the unknown one counts among all chips, not among the bins
    assert {b: n[b, "test"] for b in BINS} == {"a": each, "b": each, "c": each, "d": 6} and n["unknown", "test"] == 0
    assert sum(v for (_, s), v in n.items() if s == "val") == round(2006 * 0.15) and n["unknown", "train"] > 0


def test_class_balance_leaves_unknown_bins_out(spark):
    rows = [("a", 1)] * 10 + [("a", 0)] * 31 + [("b", 1)] * 4 + [("b", 0)] * 50 + [("unknown", 1)] * 9 + [("c", 0)] * 15 + [("c", 1)] * 15
    df = spark.createDataFrame([(k, b, n) for k, (b, n) in enumerate(rows)], "chip long, sza_bin string, n_objects int")
    got = Counter((r.sza_bin, r.positive, r.action) for r in S.class_balance(df, 1.5, BINS).collect())
    assert got == {("a", True, "balanced"): 10, ("a", False, "balanced"): 15, ("b", True, "skipped"): 4, ("b", False, "skipped"): 50, ("c", True, "balanced"): 15, ("c", False, "balanced"): 15}


def plain_quotas(counts, total):
    """Water level by trial: everyone's share of what is left until nobody is over full, then largest remainders."""
    total = min(total, sum(n for _, n, _ in counts))
    full, share = {}, {}
    while True:
        left, weight = total - sum(full.values()), sum(w for k, _, w in counts if k not in full)
        share = {k: Fraction(left * w, weight) for k, _, w in counts if k not in full}
        over = [(k, n) for k, n, _ in counts if k not in full and share[k] > n]
        if not over:
            break
        full.update(over)
    quota = {**full, **{k: int(x) for k, x in share.items()}}
    for k in sorted(share, key=lambda k: (int(share[k]) - share[k], k))[: total - sum(quota.values())]:
        quota[k] += 1
    return quota


def test_apportioned_quotas(spark):
    rng = random.Random(5)
    cases = [([("x", 5, 1), ("y", 100, 1), ("z", 100, 1)], 114), ([("x", 7, 7), ("y", 7, 7)], 3), ([("x", 3, 1)], 10)]
    cases += [([(f"s{k}", rng.randrange(1, 60), rng.randrange(1, 9)) for k in range(rng.randrange(1, 9))], rng.randrange(0, 260)) for _ in range(12)]
    for counts, total in cases:
        got = {r.k: r.quota for r in S.apportioned(spark.createDataFrame(counts, "k string, n long, w long"), ["k"], total, "w").collect()}
        assert got == plain_quotas(counts, total), (counts, total)
        assert sum(got.values()) == min(total, sum(n for _, n, _ in counts)) and all(got[k] <= n for k, n, _ in counts)


def test_ratio_quotas(spark):
    counts = spark.createDataFrame([("a", 10, 3), ("b", 4, 100), ("c", 5, 5), ("d", 9, 9)], "sza_bin string, np long, nn long")
    ratios = spark.createDataFrame([("a", 1.0, 0.5), ("b", 1.0, 2.0), ("c", 1.0, 0.0)], "sza_bin string, gt_plus double, gt_zero double")
    assert {r.sza_bin: (r.q_plus, r.q_zero) for r in S.ratio_quotas(counts, ratios).collect()} == {"a": (6, 3), "b": (4, 8), "c": (5, 0)}


@pytest.mark.parametrize("accuracy", [10_000, 50])
def test_percentiles_are_exact(spark, accuracy):
    rng = np.random.default_rng(accuracy)
    groups = {"ties": rng.choice([1.5, 7.0], 4000, p=[0.8, 0.2]), "even": rng.normal(size=3001), "one": np.array([4.0]), "two": np.array([1.0, 2.0]), "same": np.ones(500), "steps": rng.integers(0, 40, 5000).astype(float)}
    groups |= {f"n{k}": rng.normal(size=k) for k in range(3, 30)}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("none", None), ("two", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    shares = {"p10": 0.1, "p25": 0.25, "med": 0.5, "p75": 0.75, "top": 1.0}
    got = {r.g: r for r in M.with_percentiles(df, ["g"], "x", shares, [F.count(F.lit(1)).alias("n")], accuracy).collect()}
    assert got["none"].n == 1 and got["none"].med is None and got["two"].n == 3
    for g, v in groups.items():
        for name, q in shares.items():
            assert got[g][name] == pytest.approx(np.quantile(v, q), abs=1e-12), (g, name)
    whole = M.with_percentiles(df, [], "x", {"med": 0.5}, [F.count("x").alias("n")], accuracy).first()
    assert whole.med == pytest.approx(np.median(np.concatenate(list(groups.values()))), abs=1e-12)
    assert M.with_percentiles(df.limit(0), ["g"], "x", {"med": 0.5}, []).count() == 0


def test_percentiles_of_mostly_equal_values(spark):
    """400,000 rows, 80 % of them with one value."""
    df = spark.range(0, 400_000, 1, 8).select(F.lit("g").alias("g"), F.when(F.col("id") % 5 > 0, 1.0).otherwise(F.col("id").cast("double")).alias("x"))
    assert M.with_percentiles(df, ["g"], "x", {"p90": 0.9}, []).first().p90 == pytest.approx(np.quantile([1.0 if i % 5 else float(i) for i in range(400_000)], 0.9))
