"""Hand grids and brute-force twins of the operators."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from chipmeter.operators import geometry, labelling, metrics, names, objects, raster, sampling
from chipmeter.operators.graph import connected


def grid(spark, picture):
    rows = [(g, r, c) for g, p in enumerate(picture) for r, line in enumerate(p.split("/")) for c, ch in enumerate(line) if ch == "1"]
    return spark.createDataFrame(rows, "grid long, row int, col int")


def labels(spark, *picture):
    out = {}
    for r in objects.components(grid(spark, picture), width=64).collect():
        out.setdefault((r.grid, r.label), set()).add((r.row, r.col))
    return out


def test_components_hand_grids(spark):
    spiral = "1111111/1000000/1011111/1010001/1011101/1000001/1111111"
    got = labels(spark, "10/01", "111/101/111", spiral, "0")
    count = {g: sum(1 for k in got if k[0] == g) for g in range(4)}
    assert count == {0: 2, 1: 1, 2: 1, 3: 0}
    assert (2, 0) in got and len(got[(1, 0)]) == 8


def test_components_against_flood_fill(spark):
    rng = random.Random(4)
    pictures = ["/".join("".join(rng.choice("0111") if rng.random() < 0.85 else "0" for _ in range(20)) for _ in range(20)) for _ in range(6)]
    got = labels(spark, *pictures)
    for g, p in enumerate(pictures):
        left = {(r, c) for r, line in enumerate(p.split("/")) for c, ch in enumerate(line) if ch == "1"}
        while left:
            todo, comp = [min(left)], set()
            while todo:
                r, c = todo.pop()
                if (r, c) in left:
                    left.discard((r, c))
                    comp.add((r, c))
                    todo += [(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)]
            r, c = min(comp)
            assert got[(g, r * 64 + c)] == comp


def test_connected_long_path(spark):
    n = 300
    e = spark.createDataFrame([(0, i, i + 1) for i in range(n)], "grid long, a long, b long")
    nodes = spark.createDataFrame([(0, i) for i in range(n + 1)] + [(0, 999)], "grid long, node long")
    got = {r.node: r.root for r in connected(nodes, e).collect()}
    assert all(got[i] == 0 for i in range(n + 1)) and got[999] == 999


def pairs(spark, rows):
    return spark.createDataFrame(rows, "grid long, gt long, pred long, iou double")


def test_matching_traps(spark):
    trap = [(0, 0, 0, 0.6), (0, 0, 1, 0.5), (0, 1, 0, 0.55), (1, 0, 0, 0.3)]
    best = {(r.grid, r.gt, r.pred) for r in objects.match_optimal(pairs(spark, trap)).collect()}
    greedy = {(r.grid, r.gt, r.pred) for r in objects.match_greedy(pairs(spark, trap)).collect()}
    assert best == {(0, 0, 1), (0, 1, 0), (1, 0, 0)}  # exactly the threshold stays
    assert greedy == {(0, 0, 0)}  # strictly above
    two = pairs(spark, [(0, 5, 1, 3 / 7), (0, 5, 2, 3 / 7)])
    assert [(r.gt, r.pred) for r in objects.match_optimal(two).collect()] == [(5, 1)]
    assert [(r.gt, r.n, r.preds) for r in objects.ambiguous(two).collect()] == [(5, 2, [1, 2])]


def test_matching_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(g, i, j, round(rng.random(), 3)) for g in range(15) for i in range(4) for j in range(4) if rng.random() < 0.5]
    got, greedy = {}, {}
    for r in objects.match_optimal(pairs(spark, rows), 0.0).collect():
        got[r.grid] = got.get(r.grid, 0) + r.iou
    for r in objects.match_greedy(pairs(spark, rows), 0.2).collect():
        greedy.setdefault(r.grid, set()).add((r.gt, r.pred))
    for g in range(15):
        w = {(i, j): v for gg, i, j, v in rows if gg == g}
        best = max((sum(w.get((i, p[i]), 0) for i in range(4)) for p in itertools.permutations(range(4))), default=0)
        assert abs(got.get(g, 0) - best) < 1e-9
        top = {}
        for (i, j), v in w.items():
            if v > 0.2:
                top[i] = max(top.get(i, 0), v)
        used, want = set(), set()
        for i in sorted(top, key=lambda i: (-top[i], i)):
            free = [(-v, j) for (a, j), v in w.items() if a == i and j not in used and v > 0.2]
            if free:
                j = min(free)[1]
                used.add(j)
                want.add((i, j))
        assert greedy.get(g, set()) == want


def test_undefined_metrics_are_null(spark):
    rows = [(0, 0, 0), (0, 0, 0), (1, 1, 0), (1, 0, 1)]
    px = spark.createDataFrame(rows, "g int, t int, p int")
    got = {r.g: r for r in raster.confusion(px, F.col("t") == 1, F.col("p") == 1, ["g"]).collect()}
    assert got[0].iou is got[0].precision is got[0].recall is got[0].f1 is None
    assert (got[1].iou, got[1].precision, got[1].recall, got[1].f1) == (0, 0, 0, None)


def test_otsu(spark):
    px = spark.createDataFrame([(0, 0.2)] * 64 + [(1, 0.1)] * 40 + [(1, 0.9)] * 24, "chip_id int, b08 double")
    got = {r.chip_id: (r.threshold, r.reason) for r in raster.otsu(px).collect()}
    assert got[0] == (None, "constant") and 0.1 < got[1][0] < 0.9 and got[1][1] is None


def test_gap_fill(spark):
    rows = spark.createDataFrame([("a", 60, 10.0), ("a", 63, 16.0), ("b", 5, 1.0)], "m string, d int, v double")
    got = [(r.m, r.d, r.filled) for r in metrics.gap_fill(rows, ["m"], "d", "v").orderBy("m", "d").collect()]
    assert got == [("a", 60, 10), ("a", 61, 12), ("a", 62, 14), ("a", 63, 16), ("b", 5, 1)]


def test_names(spark):
    df = spark.createDataFrame([("S2A_MSIL1C_20190704T143012_N0500_R011_T25WER_X_r0256_c0512_png.rf." + "0" * 32 + ".tif",), ("odd.tif",), (None,)], "name string")
    s = names.without_suffix(F.col("name"))
    rows = df.select(names.chip_parts(s).alias("p"), names.scene_parts(s).alias("q"), names.sza_bin(F.lit("?")).alias("b")).collect()
    assert rows[0].p.row == 256 and rows[0].p.col == 512 and rows[0].q.tile == "25WER" and rows[0].q.acquired.hour == 14
    assert rows[1].p.stem == "odd" and rows[1].p.row is None and rows[1].q.acquired is None and rows[1].b == "sza_unknown"
    assert rows[2].p.stem is None


def test_solar_zenith(spark):
    df = spark.sql("select timestamp'2024-06-20 12:00:00' at, 0.0D lat, 0.0D lon union all select timestamp'2024-12-21 12:00:00', 80.0D, 0.0D")
    z = [r[0] for r in df.select(names.solar_zenith(F.col("at"), F.col("lat"), F.col("lon"))).collect()]
    assert abs(z[0] - 23.4) < 0.3 and abs(z[1] - 103.4) < 0.3


def test_rasterise_and_boundary(spark):
    ring = [("5", "1", "9", "1", "9", "4", "5", "4"), ("0", "0", "4", "0"), ("x", "1", "2", "3", "4", "5", "6")]
    df = spark.createDataFrame([(i, list(r)) for i, r in enumerate(ring)], "grid long, coords array<string>").withColumn("ring", geometry.ring_from(F.col("coords")))
    cells = geometry.rasterise(df, 10, 10)
    got = {(r.row, r.col) for r in cells.where("grid = 0").collect()}
    assert got == {(r, c) for r in range(1, 4) for c in range(5, 9)}
    assert geometry.boundary(cells.where("grid = 0")).count() == 14
    assert {r.grid: r.ring is None for r in df.collect()} == {0: False, 1: True, 2: False}
    area = {r.grid: r.a for r in df.select("grid", geometry.ring_area(F.col("ring")).alias("a")).collect()}
    assert area[0] == 12 and area[1] is None


def test_tiles_dilation_turns(spark):
    full = spark.createDataFrame([(0, r, c, float(r)) for r in range(5) for c in range(4)], "grid long, row int, col int, value double")
    assert sorted(r.name for r in raster.tiles(full, 2).collect()) == ["r0000_c0000", "r0000_c0002", "r0002_c0000", "r0002_c0002"]
    dot = grid(spark, ["000/010/000"])
    assert raster.dilate_cross(dot, 3, 3).count() == 5 and raster.belt(dot, 1, 3, 3).count() == 8
    assert raster.turned(dot, 3).select("variant", "row", "col").distinct().count() == 8


@pytest.mark.parametrize("target", [0, 3, 10, 25])
def test_to_targets(spark, target):
    rows = spark.createDataFrame([(i, "a") for i in range(10)] + [(99, "b")], "chip long, g string")
    goal = spark.createDataFrame([("a", target)], "g string, target int")
    got = [r.chip for r in sampling.to_targets(rows, goal, ["g"]).collect()]
    assert got.count(99) == 1 and len(got) == target + 1
    assert max([got.count(i) for i in range(10)]) - min([got.count(i) for i in range(10)]) <= 1


def test_submission_checks(spark):
    ok = [(1, "modified", "iceberg"), (None, "added", "iceberg")]
    rows = [
        (1, 5, 1, 1, "bogus", [], []), (2, 6, 1, 2, "accepted", ["odd"], []), (3, 9, 1, 3, "accepted", ["cloud"], []), (4, 8, 1, 3, "rejected", [], []), (5, 1, 2, 3, "skipped", ["sea-ice", "dark-water"], []),
        (6, 10, 1, 3, "bogus", [], []), (7, 1, 3, 3, "edited", [], ok), (8, 1, 4, 3, "edited", [], [(1, "moved", "ship")]), (9, 1, 5, 3, "edited", [], [(1, "modified", "ship")]),
        (10, 1, 6, 3, "edited", ["odd"], [*ok, (9, "accepted", "iceberg")]), (11, 1, 7, 3, "accepted", [], [(9, "moved", "ship")]), (12, 3, 7, 4, "accepted", [], []), (13, 1, 8, 4, None, [], []),
    ]
    df = spark.createDataFrame(rows, "event_id long, ts int, assignment long, labeler int, verdict string, tags array<string>, edits array<struct<prediction: int, action: string, class: string>>")
    own = spark.createDataFrame([(c, p) for c in range(1, 9) for p in (1, 2)], "chip long, prediction int")
    got = {r.event_id: r.status for r in labelling.checked(df, own).collect()}
    assert got == {1: "bad_verdict", 2: "bad_tag", 3: "conflict", 4: "accepted", 5: "accepted", 6: "conflict", 7: "accepted", 8: "bad_action", 9: "bad_class", 10: "orphan", 11: "accepted", 12: "conflict", 13: "bad_verdict"}


def test_decisions_and_reference_objects(spark):
    square = lambda s: [(0.0, 0.0), (s, 0.0), (s, s), (0.0, s)]
    line = [(0.0, 0.0), (5.0, 5.0), (0.0, 0.0), (5.0, 5.0)]
    edits = [(1, "modified", "iceberg", square(4.0)), (None, "added", "iceberg", line), (2, "rejected", "iceberg", square(9.0)), (None, "added", "iceberg", square(3.9))]
    rows = [(1, "accepted", [], [], 0), (2, "rejected", ["cloud"], [], 0), (3, "edited", ["sea-ice"], edits, 0), (4, "skipped", ["cloud"], [], 0), (5, "accepted", [], [], 1), (6, "accepted", ["melange"], [], 1)]
    kind = "array<struct<prediction: int, action: string, class: string, ring: array<struct<x: double, y: double>>>>"
    results = spark.createDataFrame(rows, f"chip long, verdict string, tags array<string>, edits {kind}, scene int")
    own = spark.createDataFrame([(c, 1, "iceberg", square(6.0)) for c in range(1, 7)], "chip long, prediction int, class string, ring array<struct<x: double, y: double>>")
    d = labelling.decisions(results, own)
    assert sorted((r.chip, str(r.prediction), r.action) for r in d.collect()) == sorted(
        [(1, "1", "accepted"), (2, "1", "rejected"), (3, "1", "modified"), (3, "None", "added"), (3, "2", "rejected"), (3, "None", "added"), (5, "1", "accepted"), (6, "1", "accepted")]
    )
    got = labelling.reference_objects(results, d, fold="scene").collect()  # tags of rejected and skipped results drop nothing
    assert sorted((r.chip, r.action, r.root_length) for r in got) == [(1, "accepted", 60.0), (3, "modified", 40.0)]


def test_optimal_matching_of_a_large_group(spark):
    """A chain of 2,400 objects: 1,200 times 1,200 combinations in one group, best total by a recurrence."""
    rng = random.Random(2)
    rows = []
    for k in range(1200):
        rows.append((0, k, k, rng.uniform(0.05, 1)))
        if k < 1199:
            rows.append((0, k + 1, k, rng.uniform(0.05, 1)))
    take = skip = 0.0
    for *_, w in rows:  # edges of a path in order: neighbours exclude each other
        take, skip = skip + w, max(take, skip)
    got = objects.match_optimal(pairs(spark, rows), 0.0).collect()
    assert sum(r.iou for r in got) == pytest.approx(max(take, skip), abs=1e-9)
    assert len({r.gt for r in got}) == len({r.pred for r in got}) == len(got)


def test_ambiguous_references_leave_the_matches(spark):
    rows = pairs(spark, [(0, 1, 1, 0.6), (0, 1, 2, 0.1), (0, 2, 3, 0.5), (0, 2, 4, 0.09), (1, 1, 1, 0.4)])
    kept = objects.without_ambiguous(objects.match_optimal(rows), rows).collect()
    assert {(r.grid, r.gt, r.pred) for r in kept} == {(0, 2, 3), (1, 1, 1)}


def test_ranks_and_positions(spark):
    rng = random.Random(7)
    rows = [(rng.choice("aaaab") if k % 50 else None, rng.randrange(10**6) * 1000 + k) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, x long").repartition(7)
    got = {(r.g, r.x): (r.rn, r.global_index) for r in sampling.ranked(df, ["g"], ["x"], whole=True).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    seen = {}
    for at, (g, x) in enumerate(order):
        seen[g] = seen.get(g, 0) + 1
        assert got[g, x] == (seen[g], at)
    assert sampling.ranked(df.limit(0), ["g"], ["x"]).count() == 0


def test_positional_join_needs_equal_numbers(spark):
    a = spark.createDataFrame([("t", 0, 1), ("t", 1, 2)], "split string, pos int, x int")
    assert sampling.positional_join(a, a.withColumnRenamed("x", "y"), "split").count() == 2
    with pytest.raises(ValueError, match="t: 2 rows on the left, 1 on the right"):
        sampling.positional_join(a, a.where("pos = 0").withColumnRenamed("x", "y"), "split")


def test_identity_hash_ignores_order(spark):
    df = spark.createDataFrame([("t", f"line {k}") for k in range(500)], "g string, x string")
    h = lambda d: sampling.identity_hash(d, ["g"], F.col("x")).first().hash
    assert h(df) == h(df.orderBy(F.desc("x")).repartition(5)) != h(df.where("x <> 'line 7'"))


def test_size_skip_rules(spark):
    counts = spark.createDataFrame([("a", "s", 50, 50), ("b", "s", 2, 30), ("b", "m", 50, 50), ("c", "s", 100, 60), ("c", "m", 40, 40), ("d", "s", 100, 60), ("d", "m", 40, 40)], "sza_bin string, size_bin string, c long, target long")
    nulls = spark.createDataFrame([("a", 0), ("b", 0), ("c", 200), ("d", 150)], "sza_bin string, nulls long")
    assert {r.sza_bin: r.skipped_reason for r in sampling.size_skip_rules(counts, nulls, 1.5, 3, "abcde").collect()} == {"a": "one_bin", "b": "few", "c": "ratio", "d": "", "e": "one_bin"}


def test_components_in_tasks_and_in_rounds(spark):
    """Grids that fit a task and larger ones give the same roots, whatever the bound."""
    rng = random.Random(5)
    edges = [(f"g{g}", rng.randrange(60), rng.randrange(60)) for g in range(12) for _ in range(rng.choice([0, 5, 40, 200]))]
    edges += edges[:20]
    nodes = [(f"g{g}", n) for g in range(12) for n in range(60)]
    want = {k: k[1] for k in nodes}
    for _ in range(60):
        for g, a, b in edges:
            want[g, a] = want[g, b] = min(want[g, a], want[g, b])
    e = spark.createDataFrame(edges + [(None, 1, 2)], "grid string, a long, b long")
    n = spark.createDataFrame(nodes, "grid string, node long")
    for small in (1000, 41, 0):
        assert {(r.grid, r.node): r.root for r in connected(n, e, small).collect()} == want
    assert connected(n.limit(0), e.limit(0)).collect() == []


def test_chunks_of_whole_grids(spark, monkeypatch):
    """A task that joins a few edges at once gives the roots of one that joins all."""
    from chipmeter.operators import graph

    rows = [(g, i, i + 1) for g in range(40) for i in range(g)]
    monkeypatch.setattr(graph, "CHUNK", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        e = spark.createDataFrame(rows, "grid long, a long, b long")
        got = connected(e.select("grid", "b").withColumnRenamed("b", "node"), e).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows) and all(r.root == 0 for r in got)


def test_equal_totals_are_told_apart_exactly(spark):
    """Totals come first even where differences are tiny and many; then the smaller predictions."""
    tiny = 4e-10
    chain = []
    for k in range(200):  # each reference gains a little by the higher of two predictions; the sum of predictions says otherwise
        chain += [(0, k, k, 0.5), (0, k, k + 1, 0.5 + tiny)]
    got = {r.gt: r.pred for r in objects.match_optimal(pairs(spark, chain)).collect()}
    assert got == {k: k + 1 for k in range(200)}
    even = [(0, i, j, 0.5) for i in range(3) for j in range(5)]
    assert {r.pred for r in objects.match_optimal(pairs(spark, even)).collect()} == {0, 1, 2}


def test_greedy_chain_in_one_pass(spark):
    """A chain in which every reference waits for the one before."""
    n = 3000
    rows = [(0, k, k, 0.9 - k / (4 * n)) for k in range(n)] + [(0, k + 1, k, 0.95 - k / (4 * n)) for k in range(n - 1)]
    top, used, want = {}, set(), set()
    for _, i, p, v in rows:
        top.setdefault(i, []).append((-v, p))
    for i in sorted(top, key=lambda i: (min(top[i])[0], i)):
        free = [(v, p) for v, p in sorted(top[i]) if p not in used]
        if free:
            used.add(free[0][1])
            want.add((i, free[0][1]))
    assert {(r.gt, r.pred) for r in objects.match_greedy(pairs(spark, rows)).collect()} == want


def test_rings_that_share_cells_and_boundary_of_gaps(spark):
    rows = [(1, [(0, 0), (5, 0), (5, 2), (0, 2)]), (1, [(3, 0), (9, 0), (9, 1), (3, 1)]), (1, [(1, 0), (2, 0), (2, 1), (1, 1)]), (1, [(0, 0), (5, 0), (5, 2), (0, 2)]), (2, [(4, 4), (6, 4), (6, 6), (4, 6)])]
    rings = spark.createDataFrame([(g, [(float(x), float(y)) for x, y in r]) for g, r in rows], "grid long, ring array<struct<x:double,y:double>>")
    cells = [tuple(r) for r in geometry.rasterise(rings, 8, 8).collect()]
    assert len(cells) == len(set(cells)) and set(cells) == {(1, 0, c) for c in range(8)} | {(1, 1, c) for c in range(5)} | {(2, r, c) for r in (4, 5) for c in (4, 5)}
    mask = {(g, r, c) for g, r, c in [(1, 0, 0), (1, 0, 1), (1, 0, 3), (1, 1, 1), (1, 3, 1), (1, 3, 2), (2, 0, 2), (2, 1, 2), (2, -1, 2)]}
    got = [tuple(r) for r in geometry.boundary(spark.createDataFrame(sorted(mask), "grid long, row int, col int")).collect()]
    near = {"N": (-1, 0), "S": (1, 0), "W": (0, -1), "E": (0, 1)}
    assert sorted(got) == sorted((g, r, c, s) for g, r, c in mask for s, (i, j) in near.items() if (g, r + i, c + j) not in mask)


def test_cells_of_rings_are_not_broadcast(spark):
    """Estimated by the file that rings come from, all their cells went to the driver as a broadcast table."""
    from chipmeter.plans import extra, records

    for make in (records.Q["R11_object_boundary"], extra.Q["J6_ring_overlap"]):
        plan = make(spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan
