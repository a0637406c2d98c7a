"""Rings against brute force and back, collections in files, imports that break off and are repeated."""

import json
import random

import pytest
from pyspark.sql import functions as F

from chipmeter.operators import geometry as G
from chipmeter.operators import objects as O
from chipmeter.sources import io as IO
from chipmeter.sources.scratch import materialise, scratch_folder


@pytest.fixture(scope="module")
def cells(spark):
    rng = random.Random(1)
    rows = [(g, r, c) for g in range(25) for r in range(rng.choice([1, 2, 5, 12])) for c in range(16) if rng.random() < rng.choice([0.4, 0.6, 0.8])]
    rows += [(100, r, c) for r in range(3) for c in range(3) if (r, c) != (1, 1)]  # a hole
    rows += [(101, 0, 0), (101, 1, 1)]  # two objects that touch across
    rows += [(102, r, c) for r, c in ((0, 0), (0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1))]  # one object that touches itself across
    rows += [(103, r, c) for r in range(7) for c in range(7) if r in (0, 6) or c in (0, 6)] + [(103, 3, 3)]  # an object in a hole
    return materialise(O.components(spark.createDataFrame(rows, "grid long, row int, col int"), 16))


def walked(own):
    """Rings of one object's cells, corner after corner; at a touching corner the outline turns right."""
    go = [(0, 1), (1, 0), (0, -1), (-1, 0)]  # right, down, left, up as (dy, dx)
    start = {}
    for r, c in own:
        for side, (dr, dc, y, x) in enumerate(((-1, 0, r, c), (0, 1, r, c + 1), (1, 0, r + 1, c + 1), (0, -1, r + 1, c))):
            if (r + dr, c + dc) not in own:
                start[y, x, side] = (y + go[side][0], x + go[side][1])
    rings = []
    while start:
        at = first = min(start)
        ring, area = [], 0
        while True:
            y, x, side = at
            y1, x1 = start.pop(at)
            area += x * y1 - x1 * y
            ring.append(at)
            at = next((k for k in ((y1, x1, (side + t) % 4) for t in (1, 0, 3)) if k in start or k == first))
            if at == first:
                break
        corners = [(x, y) for (y, x, s), (_, _, p) in zip(ring, ring[-1:] + ring[:-1]) if s != p]
        rings.append((area < 0, abs(area) / 2, corners))
    return sorted(rings)


def test_rings_match_a_walk(cells):
    objects = {}
    for r in cells.collect():
        objects.setdefault((r.grid, r.label), set()).add((r.row, r.col))
    got = {}
    for r in G.rings(cells, 16).collect():
        got.setdefault((r.grid, r.label), []).append((r.hole, r.area, [(p.x, p.y) for p in r.ring]))
    assert {k: sorted(v) for k, v in got.items()} == {k: walked(v) for k, v in objects.items()}
    for k, own in objects.items():
        assert sum(not h for h, *_ in got[k]) == 1 and sum(-a if h else a for h, a, _ in got[k]) == len(own)
    assert sum(h for h, *_ in got[102, 0]) == 0 and len(got[101, 17]) == 1  # a gap that opens across is no hole


def test_rings_fill_back_to_the_mask(cells):
    back = G.filled(materialise(G.rings(cells, 16)), 16, 16).select("grid", "label", "row", "col")
    cells = cells.select("grid", "label", "row", "col")
    assert back.exceptAll(cells).count() == cells.exceptAll(back).count() == 0
    assert G.rings(cells.limit(0), 16).count() == 0


def test_collection_files(spark, cells, tmp_path):
    path = scratch_folder(spark, "collections")
    images = cells.select("grid").distinct().unionByName(spark.createDataFrame([(999,)], "grid long")).select("grid", F.format_string("g%04d.tif", "grid").alias("file_name"), F.lit(16).alias("width"), F.lit(12).alias("height"))
    named, own = IO.annotations_of(images, materialise(G.rings(cells, 16)), category=1, least_area=2)
    IO.write_collection(named, own, [(1, "iceberg")], path)
    i, a = IO.scan_collection(spark, path, "iceberg")
    rows = sorted(a.collect())
    assert [r.id for r in rows] == list(range(1, len(rows) + 1)) and all(r.wanted for r in rows)
    files = [r.file_name for r in sorted(i.collect())]
    assert files == sorted(files) and files[-1] == "g0999.tif" and i.count() == images.count()
    assert [r.image_id for r in rows] == sorted(r.image_id for r in rows)
    for r in rows:
        xs, ys = r.segmentation[0][::2], r.segmentation[0][1::2]
        assert r.bbox == [min(xs), min(ys), max(xs) - min(xs), max(ys) - min(ys)] and r.area >= 2
    doc = {"images": [{"id": 5, "file_name": "a", "width": 1, "height": 1}], "annotations": [{"id": 1, "image_id": 5, "category_id": 2, "segmentation": [[0, 0, 1, 0, 1, 1]]}], "categories": []}
    (tmp_path / "foreign.json").write_text(json.dumps(doc, indent=2))
    i, a = IO.scan_collection(spark, str(tmp_path), "iceberg", whole_files=True)
    assert i.first().id == 5 and a.first().wanted and a.first().bbox is None and a.first().segmentation == [[0.0, 0.0, 1.0, 0.0, 1.0, 1.0]]


def listing(spark, names, ok=lambda n: True):
    files = spark.createDataFrame([(f"{n}.png", "kq", f"bin{len(n) % 2}") for n in names], "filename string, region string, sza_bin string")
    grids = spark.createDataFrame([(n.removesuffix("_B08"),) for n in names if ok(n)], "stem string")
    return files, grids, spark.createDataFrame([(names[0], "iceberg", 3.0), (names[0], "iceberg", 1.0)], "stem string, class string, area_m2 double")


def table(spark, path):
    return sorted((r.filename, r.stem, r.prediction_count, r.batch) for r in IO.read_chips(spark, path).collect())


def outcomes(done):
    return sorted((r.filename, r.outcome) for r in done.collect())


def test_import_breaks_off_and_is_repeated(spark):
    path = scratch_folder(spark, "imports")
    done = IO.import_chips(*listing(spark, ["a", "bb", "c_B08", "d"], lambda n: n != "d"), path, "one")
    assert outcomes(done) == [("a.png", "imported"), ("bb.png", "imported"), ("c_B08.png", "imported"), ("d.png", "no_tif")]
    first = [("a.png", "a", 2, "one"), ("bb.png", "bb", 0, "one"), ("c_B08.png", "c", 0, "one")]
    assert table(spark, path) == first

    rows = spark.range(0, 40, 1, 4).select(F.concat(F.lit("x"), F.col("id").cast("string"), F.lit(".png")).alias("filename"), F.lit("s").alias("stem"), F.lit("kq").alias("region"), F.lit(0).alias("prediction_count"))
    rows = rows.select("*", F.lit(None).cast("array<struct<class:string,area_m2:double>>").alias("predictions"), F.when(F.col("filename") == "x39.png", F.raise_error(F.lit("lost")).cast("string")).otherwise("bin1").alias("sza_bin"), F.lit("two").alias("batch"))
    with pytest.raises(Exception, match="lost"):
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sza_bin", "batch").parquet(path)
    assert table(spark, path) == first  # a write that broke off shows nothing

    # what a job that died while it moved its files may leave: some rows of the batch
    some = IO.read_chips(spark, path).where("filename = 'a.png'").withColumns({"filename": F.lit("e.png"), "stem": F.lit("e"), "batch": F.lit("two")})
    materialise(some).write.mode("append").partitionBy("sza_bin", "batch").parquet(path)
    new = listing(spark, ["e", "f", "bb"])
    assert outcomes(IO.import_chips(*new, path, "two")) == [("bb.png", "skipped"), ("e.png", "skipped"), ("f.png", "imported")]
    whole = sorted([*first, ("e.png", "e", 2, "two"), ("f.png", "f", 0, "two")])
    assert table(spark, path) == whole
    assert {o for _, o in outcomes(IO.import_chips(*new, path, "two"))} == {"skipped"} and table(spark, path) == whole
    assert {o for _, o in outcomes(IO.import_chips(*new, path, "three"))} == {"skipped"} and table(spark, path) == whole
