"""Searches against exhaustive ones, requests against a sequential twin, stages of the gate."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chipmeter.operators import gates, search
from chipmeter.operators import raster as R
from chipmeter.plans import search as plans
from chipmeter.sources import views as V

SF = "/root/testdata/sf0.001"


def test_nearest_arrays_match_an_exhaustive_search(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 200, (30, 16))
    table = [(k, [float(x) for x in base[k % 30] + rng.integers(-3, 4, 16)]) for k in range(120)] + [(500, [7.0] * 16), (501, [7.0] * 16)]
    probes = [(k, [float(x) for x in base[k % 30] + rng.integers(-4, 5, 16) + (k % 4 == 3) * 4]) for k in range(200)] + [(900, [7.5] * 16), (901, [7.5] * 16), (902, [999.0] * 16)]
    got = {r.probe: (r.key, r.mae, r.status) for r in search.nearest_arrays(spark.createDataFrame(probes, "probe long, v array<double>"), spark.createDataFrame(table, "key long, v array<double>"), 5.0).collect()}
    seen, want = set(), {}
    for p, v in probes:
        mae, key = min((float(np.abs(np.array(v) - np.array(w)).mean()), k) for k, w in table)
        want[p] = (None, None, "none") if mae >= 5 else (key, pytest.approx(mae), "collision" if key in seen else "matched")
        seen |= {key} if mae < 5 else set()
    assert got == want
    assert Counter(s for *_, s in got.values()).keys() == {"none", "matched", "collision"} and got[900][0] == 500 and got[901][2] == "collision"


def test_arrays_around_one_mean_meet_by_finer_sums(spark, monkeypatch):
    """Cells of two means held nearly all arrays of such a table, so all pairs were compared in full."""
    rng = np.random.default_rng(8)
    base = np.floor(rng.normal(0, 125_000, (400, 64)))
    ripple = np.where(np.arange(64) % 2, -1.0, 1.0)
    table = [(k * 3 + j, (base[k] + ripple * 9000 * j).tolist()) for k in range(400) for j in range(3)]
    probes = [(k * 2 + j, (base[k * 5 % 400] + ripple * (12_000 - 2000 * j) + (k % 3 == 0) * 15_000 + (k % 7 == 0) * 50_000).tolist()) for k in range(100) for j in range(2)]
    monkeypatch.setattr(search, "CHUNK", 60)
    got = search.nearest_arrays(spark.createDataFrame(probes, "probe long, v array<double>"), spark.createDataFrame(table, "key long, v array<double>"), 20_000.0)
    got = {r.probe: (r.key, r.mae) for r in got.collect()}
    want = {}
    for p, v in probes:
        mae, key = min((float(np.abs(np.array(v) - np.array(w)).mean()), k) for k, w in table)
        want[p] = (key, pytest.approx(mae)) if mae < 20_000 else (None, None)
    assert got == want and {k is None for k, _ in got.values()} == {True, False}
    a, b = (np.array([v for _, v in rows]).reshape(-1, 32, 2).sum(2) for rows in (probes, table))
    x, y = search._near_sums(a, b, 20_000.0 * 64, 8)
    exact = np.abs(a[:, None] - b[None]).sum(2) < 20_000 * 64
    assert set(zip(x.tolist(), y.tolist())) == set(zip(*(c.tolist() for c in np.nonzero(exact)))) and len(x) < 0.01 * len(a) * len(b)


def test_odd_arrays_have_no_neighbour(spark):
    odd = [(1, None), (2, [1.0, None] * 8), (3, [float("nan")] * 16), (4, [1.0] * 16), (4, [1.0] * 16), (None, [1.0] * 16)]
    probes, table = spark.createDataFrame(odd, "probe long, v array<double>"), spark.createDataFrame([(k, v) for k, v in odd if k != 4] + [(9, [1.5] * 16)], "key long, v array<double>")
    got = sorted(((r.probe, r.key, r.status) for r in search.nearest_arrays(probes, table.where("key is not null"), 1.0).collect()), key=str)
    assert got == sorted([(1, None, "none"), (2, None, "none"), (3, None, "none"), (4, 9, "matched"), (4, 9, "matched"), (None, 9, "collision")], key=str)
    assert {r.status for r in search.nearest_arrays(probes, table.limit(0), 1.0).collect()} == {"none"} and search.nearest_arrays(probes.limit(0), table, 1.0).count() == 0


def test_ring_pairs_match_all_envelopes(spark):
    rng = random.Random(2)
    box = lambda: (x := rng.uniform(-50, 300), y := rng.uniform(-50, 300), x + rng.choice([1, 9, 150]), y + rng.choice([2, 8, 90]))
    rows = lambda n, at: [(at + k, *box()) for k in range(n)] + [(at + 900, 0.0, 0.0, 64.0, 64.0), (at + 901, 64.0, 0.0, 70.0, 64.0)]
    left, right = rows(60, 0), rows(60, 5000)
    make = lambda r: spark.createDataFrame([(i, [(a, b), (c, b), (c, d), (a, d)]) for i, a, b, c, d in r], "id long, ring array<struct<x:double,y:double>>")
    want = {(p[0], q[0]) for p in left for q in right if p[1] < q[3] and q[1] < p[3] and p[2] < q[4] and q[2] < p[4]}
    for tile in (7.0, 64.0, 1000.0):
        got = [(r.a, r.b) for r in search.ring_pairs(make(left), make(right), tile).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    iou = {(r.a, r.b): r.iou for r in search.ring_ious(make([(1, 0.0, 0.0, 4.0, 4.0)]), make([(2, 2.0, 2.0, 6.0, 6.0), (3, 3.9, 3.9, 5.0, 5.0)]), 64, 64).collect()}
    assert iou == {(1, 2): pytest.approx(4 / 28), (1, 3): 0.0}


def test_equal_rings_are_compared_once(spark, monkeypatch):
    """Cells used to be joined for every pair of rings, also of equal ones."""
    rng = random.Random(5)
    kinds = [[(x, y), (x + s, y), (x + s, y + s), (x, y + s)] for x, y, s in ((rng.randrange(30) * 1.0, rng.randrange(30) * 1.0, rng.choice([0.3, 3.0, 20.0])) for _ in range(8))]
    left, right = [(k, kinds[k % 8]) for k in range(40)], [(100 + k, kinds[k % 5]) for k in range(30)]
    make = lambda r: spark.createDataFrame(r, "id long, ring array<struct<x:double,y:double>>")
    cells = lambda p: {(r, c) for r in range(64) for c in range(64) if p[0][0] <= c + 0.5 < p[2][0] and p[0][1] <= r + 0.5 < p[2][1]}
    seen, before = [], search.ring_pairs
    monkeypatch.setattr(search, "ring_pairs", lambda *a: seen.append((a[0].count(), a[1].count())) or before(*a))
    got = sorted((r.a, r.b, r.shared, r.n_a, r.n_b, r.iou) for r in search.ring_ious(make([*left, (99, None)]), make(right), 64, 64, 8.0).collect())
    want = []
    for a, p in left:
        for b, q in right:
            if all(p[0][k] < q[2][k] and q[0][k] < p[2][k] for k in (0, 1)):
                x, y = cells(p), cells(q)
                want.append((a, b, len(x & y), len(x), len(y), pytest.approx(len(x & y) / len(x | y)) if x | y else None))
    assert got == sorted(want, key=lambda w: w[:2]) and seen == [(len({str(k) for k in kinds}), len({str(k) for k in kinds[:5]}))]


def test_first_by_prefix(spark):
    names = spark.createDataFrame([(3, "abcd", "x"), (1, "abce", "y"), (2, "ab", "z"), (9, "b", None)], "place long, name string, value string")
    stems = spark.createDataFrame([("abc", 1), ("ab", 2), ("abcd", 3), ("abcde", 4), ("q", 5), ("", 6), (None, 7), ("ab", 8), ("b", 9)], "stem string, id int")
    got = {r.id: (r.place, r.value) for r in search.first_by_prefix(stems, names, "KQ").collect()}
    assert got == {1: (1, "y"), 2: (1, "y"), 3: (3, "x"), 4: (None, "KQ"), 5: (None, "KQ"), 6: (1, "y"), 7: (None, "KQ"), 8: (1, "y"), 9: (9, None)}
    assert {r.value for r in search.first_by_prefix(stems, names.limit(0), "KQ").collect()} == {"KQ"}


def test_requests_see_what_earlier_ones_took(spark):
    rng = random.Random(4)
    chips = [(k, rng.choice(["KQ", "SK"]), rng.choice(["a", "b"])) for k in range(80)]
    held = sorted({(rng.randrange(3), rng.randrange(80)) for _ in range(90)})
    asked = [(k, rng.randrange(4), rng.choice([None, "KQ", "SK"]), rng.choice([None, "a", "b"]), rng.choice([0, 3, 10, 50])) for k in range(14)]
    frames = [spark.createDataFrame(asked, "request int, labeler long, region string, sza_bin string, n int"), spark.createDataFrame(chips, "chip long, region string, sza_bin string"), spark.createDataFrame(held, "labeler long, chip long")]
    got = sorted(map(tuple, search.assigned(*frames).collect()))
    have, want = list(held), []
    for r, lab, region, bin_, n in asked:
        k = Counter(c for _, c in have)
        fit = [c for c, g, b in chips if region in (None, g) and bin_ in (None, b) and (lab, c) not in have]
        for c in sorted(fit, key=lambda c: (k[c], c))[:n]:
            want.append((r, lab, c))
        have += [(lab, c) for q, lab, c in want if q == r]
    assert got == sorted(want)
    assert len({(lab, c) for _, lab, c in got} | set(held)) == len(got) + len(held)  # no chip twice for a labeler
    assert search.assigned(frames[0].limit(0), *frames[1:]).count() == 0


def test_gate_computes_a_stage_for_survivors_only(spark):
    got = Counter((r.decision, r.note) for r in plans.Q["P20_staged_gate"](spark, SF).collect())
    assert set(got) == {("skip", "unparseable_filename"), ("skip", "too_few_bands"), ("reject", "ic_frac"), ("skip", "no_safe_zip"), ("skip", "no_qa60"), ("reject", "cloud_frac"), ("reject", "b08_p95"), ("reject", "otsu_cc"), ("accept", "")}
    chips = V.chips(spark, SF).select("chip_id", F.lit("s").alias("stem"), F.lit(3).alias("bands"), F.when(F.col("chip_id") % 2 == 0, "s").alias("scene"))
    masks = chips.where("chip_id % 3 = 0").select("chip_id", F.lit(0).alias("v"))
    out, stages = gates.null_chips(chips, V.pixels(V.chips(spark, SF)), masks, 0.72, 0.08, 0.3, 0.5, 25, V.SIDE)
    n = Counter(r.note for r in out.collect())
    rows = {k: v.count() for k, v in stages.items()}
    total = chips.count()
    assert rows["coverage"] == total and rows["cloud"] == total - n["ic_frac"] - n["no_safe_zip"] and rows["p95"] == rows["cloud"] - n["no_qa60"]
    assert rows["otsu"] == rows["p95"] - n["b08_p95"] >= rows["component"] >= n["otsu_cc"] > 0 and n["no_qa60"] > 0


def test_log_histogram_has_every_bin(spark):
    rows = spark.createDataFrame([(x,) for x in (1.0, 10.0, 10.0, 99.0, 1000.0, 10_000.0)], "x double")
    got = R.log_histogram(rows, "x", 10, 3).orderBy("bin").collect()
    assert [r.n for r in got] == [3, 0, 2] and [round(r.low) for r in got] == [10, 100, 1000] and round(got[-1].high) == 10_000
    assert R.log_histogram(rows.limit(0), "x", 10, 3).count() == R.log_histogram(rows.where("x < 5"), "x", 10, 3).count() == 0
