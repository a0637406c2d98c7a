"""Searches that meet by keys instead of pairs: nearest arrays, rings of two layers, prefixes of any length."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import materialise, sized
from .geometry import ring_box, spans


#: Distinct arrays of sums of either side that meet in one task, and blocks of the table that there are at least if it has as many rows.
CHUNK, LEAST_BLOCKS = 8192, 24


def _sums(v: Column, parts: int) -> Column:
    """Sums of equal consecutive parts of an array: of four times ``parts``, twice or once as many, as its length (a multiple of ``parts``) allows."""
    n = F.when(F.size(v) % (4 * parts) == 0, 4 * parts).when(F.size(v) % (2 * parts) == 0, 2 * parts).otherwise(parts)
    size = (F.size(v) / n).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.aggregate(F.slice(v, i * size + 1, size), F.lit(0.0), lambda a, x: a + x))


def _near_sums(a: np.ndarray, b: np.ndarray, most: float, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and b whose absolute differences add up to less than ``most`` (a hair more, for rounding), after the same test on ``parts`` coarser sums."""
    coarse = [x.reshape(len(x), parts, -1).sum(2).T for x in (a, b)]
    scale = max(np.abs(x).max() for x in coarse) or 1.0
    ca, cb = ((x / scale).astype(np.float32) for x in coarse)
    slack = most / scale * (1 + 1e-6) + 2e-6 * parts
    most *= 1 + 1e-9
    found = []
    for k in range(0, len(a), 64):
        total, one = np.zeros((2, len(a[k : k + 64]), len(b)), np.float32)
        for x, y in zip(ca, cb):
            np.subtract(x[k : k + 64, None], y, out=one)
            np.abs(one, out=one)
            total += one
        i, j = np.nonzero(total <= slack)
        for m in range(0, len(i), 1 << 16):
            x, y = i[m : m + (1 << 16)] + k, j[m : m + (1 << 16)]
            near = np.abs(a[x] - b[y]).sum(1) <= most
            found.append((x[near], y[near]))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


def nearest_arrays(probes: DataFrame, table: DataFrame, within: float, parts: int = 8) -> DataFrame:
    """For each probe the array of the table with the smallest mean absolute difference, if that is below ``within``.

    probes (probe, v), table (key, v), all arrays of one length. Returns probe, key, mae and status: matched, collision (a probe that comes earlier by
    number has the same key), or none (no array is near enough; key and mae are null). Ties go to the lowest key.

    The sums of equal parts bound the difference from below: that of |a - b| over a part is at least |sum a - sum b|. Different arrays of sums
    meet in blocks, by numpy, first by ``parts`` sums and then by up to four times as many; what is left is compared in full. Equal arrays are
    compared once, and so are equal sums. Sums of unrelated arrays lie too close for keys: cells as wide as the bound needs hold nearly all of them. So
    work grows with the different sums of the probes times those of the table, at some nanoseconds a pair.
    """
    whole = F.forall("v", lambda x: F.abs(x) < F.lit(float("inf")))  # a null or NaN is near nothing
    kinds = lambda df, *also: df.where(whole).groupBy("v").agg(F.lit(1).alias("one"), *also).withColumn("f", _sums(F.col("v"), parts)).withColumn("g", F.xxhash64("f")).drop("one")
    one = materialise(kinds(table, F.min("key").alias("key")).withColumnRenamed("v", "w"))
    asked = materialise(kinds(probes))
    sums = [asked.select("g", "f", F.size("v").alias("n")).distinct(), one.select("g", "f", F.size("w").alias("n")).distinct()]
    sums = [materialise(s) for s in sums]
    blocks = [max(1, -(-s.count() // CHUNK)) for s in sums]
    blocks[1] = max(blocks[1], -(-LEAST_BLOCKS // blocks[0]))
    dealt = lambda k: F.pmod(F.col("g"), F.lit(blocks[k])).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(blocks[k] - 1)))
    left = sums[0].select("*", dealt(0).alias("i"), every(1).alias("j")).groupBy("i", "j")
    right = sums[1].select("*", every(0).alias("i"), dealt(1).alias("j")).groupBy("i", "j")

    def meet(p: pa.Table, t: pa.Table) -> pa.Table:
        rows = lambda c: c["f"].combine_chunks().flatten().to_numpy().reshape(c.num_rows, -1)
        at = ([], []) if not p.num_rows or not t.num_rows else _near_sums(rows(p), rows(t), within * p["n"][0].as_py(), parts)
        return pa.table({k: c["g"].to_numpy()[np.asarray(x, np.int64)] for k, c, x in zip(("g", "h"), (p, t), at)})

    near = materialise(left.cogroup(right).applyInArrow(meet, "g long, h long").distinct())
    apart = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)
    pairs = near.hint("merge").join(asked.select("g", "v").hint("merge"), "g").join(one.select(F.col("g").alias("h"), "w", "key").hint("merge"), "h")
    pairs = pairs.withColumn("mae", apart("v", "w")).where(F.col("mae") < within)
    best = pairs.groupBy("v").agg(F.min(F.struct("mae", "key")).alias("b"))
    found = materialise(probes.join(best.hint("merge"), "v", "left").select("probe", F.col("b.key").alias("key"), F.col("b.mae").alias("mae")))
    first = found.where("key is not null").groupBy("key").agg(F.min("probe").alias("first"))
    status = F.when(F.col("key").isNull(), "none").when(F.col("probe") == F.col("first"), "matched").otherwise("collision")
    return found.join(first.hint("merge"), "key", "left").select("probe", "key", "mae", status.alias("status"))


def ring_pairs(left: DataFrame, right: DataFrame, tile: float = 64.0) -> DataFrame:
    """Pairs of rings (a, b) of two layers whose envelopes overlap. left and right: id, ring (in one map's coordinates).

    Envelopes are copied to the tiles that they touch and meet there; a pair that shares several tiles is kept in one only, that of the
    lower corner of what the envelopes share. A ring that covers many tiles costs that many rows.
    """
    def tiled(df: DataFrame, name: str) -> DataFrame:
        e = df.select(F.col("id").alias(name), ring_box(F.col("ring")).alias("e")).select(name, *[F.col(f"e.{c}").alias(f"{name}_{c}") for c in ("x0", "x1", "y0", "y1")])
        span = lambda c: F.explode(F.sequence(F.floor(F.col(f"{name}_{c}0") / tile), F.floor(F.col(f"{name}_{c}1") / tile)))
        return e.withColumn("tx", span("x")).withColumn("ty", span("y"))

    both = tiled(left, "a").join(tiled(right, "b").hint("merge"), ["tx", "ty"])
    both = both.where("a_x0 < b_x1 and b_x0 < a_x1 and a_y0 < b_y1 and b_y0 < a_y1")
    own = lambda c: F.floor(F.greatest(f"a_{c}0", f"b_{c}0") / tile) == F.col(f"t{c}")
    return both.where(own("x") & own("y")).select("a", "b")


def ring_ious(left: DataFrame, right: DataFrame, height: int, width: int, tile: float = 64.0) -> DataFrame:
    """Pairs of :func:`ring_pairs` with the cells of each side, shared cells and IoU (by cell centres; null if neither has a cell).

    Equal rings of a layer are compared once, and what rings share is counted by spans of rows; pairs of rings are all there in the
    result, but before it only pairs of different rings, and those once with each ring of the left layer. Joins are merged, as
    Spark takes what comes from a few rings for a small table.
    """
    layers = []
    for df, name in ((left, "a"), (right, "b")):
        kinds = df.where(F.col("ring").isNotNull()).select("ring").distinct()
        kinds = materialise(kinds.select(F.monotonically_increasing_id().alias("id"), "ring"))
        own = df.join(kinds.withColumnRenamed("id", "kind").hint("merge"), "ring").select(F.col("kind").alias(f"kind_{name}"), F.col("id").alias(name))
        layers.append((name, kinds, materialise(own)))
    kinds = [k for _, k, _ in layers]
    pairs = materialise(ring_pairs(*kinds, tile))
    rows = []
    for name, k, _ in layers:
        used = k.join(pairs.select(F.col(name).alias("id")).distinct().hint("merge"), "id", "left_semi").withColumnRenamed("id", "grid")
        rows.append(materialise(spans(used, height, width).toDF(name, "row", f"{name}0", f"{name}1")))
    meet = pairs.join(rows[0].hint("merge"), "a").join(rows[1].hint("merge"), ["b", "row"]).where("a0 <= b1 and b0 <= a1")
    out = pairs.join(meet.groupBy("a", "b").agg(F.sum(F.least("a1", "b1") - F.greatest("a0", "b0") + 1).alias("shared")).hint("merge"), ["a", "b"], "left")
    for (name, *_), r in zip(layers, rows):
        out = out.join(r.groupBy(name).agg(F.sum(F.col(f"{name}1") - F.col(f"{name}0") + 1).alias(f"n_{name}")).hint("merge"), name, "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("shared", "n_a", "n_b")})
    out = out.withColumn("iou", F.try_divide("shared", F.col("n_a") + F.col("n_b") - F.col("shared")))
    out = materialise(out.withColumnsRenamed({"a": "kind_a", "b": "kind_b"}))
    for name, _, own in layers:
        out = out.join(own.hint("merge"), f"kind_{name}")
    return out.select("a", "b", "shared", "n_a", "n_b", "iou")


def first_by_prefix(stems: DataFrame, names: DataFrame, default: str) -> DataFrame:
    """Each stem with the value of the first name that starts with it, or the default.

    stems (stem), names (place, name, value). Names meet stems by equality: for each length that a stem has, the name's start of that length; starts
    are combined in the tasks before they move, and a start that many names share is one row. At most 10,000 lengths (checked). An empty stem
    is the start of every name.
    """
    kinds = materialise(stems.select("stem").where("stem is not null").distinct())
    lengths = [r[0] for r in kinds.select(F.length("stem")).distinct().limit(10_001).collect()]
    if len(lengths) > 10_000:
        raise ValueError("stems of more than 10,000 lengths")
    fits = F.filter(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>"), lambda n: n <= F.length("name"))
    starts = names.select("place", "value", F.explode(F.transform(fits, lambda n: F.substring(F.col("name"), F.lit(1), n))).alias("stem"))
    first = starts.join(sized(kinds), "stem", "left_semi").groupBy("stem").agg(F.min(F.struct("place", "value")).alias("f"))
    out = stems.join(first, "stem", "left")
    return out.select(*stems.columns, F.col("f.place").alias("place"), F.when(F.col("f").isNull(), F.lit(default)).otherwise(F.col("f.value")).alias("value"))


def assigned(requests: DataFrame, chips: DataFrame, held: DataFrame) -> DataFrame:
    """Chips (request, labeler, chip) for requests that are served one after the other, each seeing what the earlier ones took.

    requests (request, labeler, region, sza_bin, n; region or bin null: any), chips (chip, region, sza_bin), held (labeler, chip). A request takes the n
    chips that fit it, that its labeler doesn't hold, with the fewest assignments, then the lowest number.

    Requests whose chips can't overlap (another region or bin) don't see each other, so they are served in one round: a request's round is
    one more than the last one of the earlier requests that it may share chips or a labeler's chips with. Requests are few (checked); chips are never
    looped over: a round is one top-n by a window that cuts each task's rows first, and one written table.
    """
    asked = requests.orderBy("request").limit(10_001).collect()
    if len(asked) > 10_000:
        raise ValueError("more than 10,000 requests")
    meet = lambda a, b: all(x is None or y is None or x == y for x, y in ((a.region, b.region), (a.sza_bin, b.sza_bin)))
    rounds: list[list] = []
    for r in asked:
        at = max((k + 1 for k, group in enumerate(rounds) for q in group if meet(q, r)), default=0)
        if at == len(rounds):
            rounds.append([])
        rounds[at].append(r)
    spark = requests.sparkSession
    counts = materialise(chips.join(held.groupBy("chip").agg(F.count(F.lit(1)).alias("k")), "chip", "left").select("chip", "region", "sza_bin", F.coalesce("k", F.lit(0)).alias("k")))
    taken = None
    for group in rounds:
        q = F.broadcast(spark.createDataFrame(group, requests.schema)).withColumnsRenamed({"region": "r", "sza_bin": "b"})
        fit = counts.join(q, (F.col("r").isNull() | (F.col("region") == F.col("r"))) & (F.col("b").isNull() | (F.col("sza_bin") == F.col("b"))))
        have = held.select("labeler", "chip") if taken is None else held.select("labeler", "chip").unionByName(taken.select("labeler", "chip"))
        fit = fit.join(have.distinct(), ["labeler", "chip"], "left_anti")
        rank = F.row_number().over(W.partitionBy("request").orderBy("k", "chip"))
        got = fit.withColumn("rn", rank).where(F.col("rn") <= max(r.n for r in group)).where("rn <= n")
        got = materialise(got.select("request", "labeler", "chip"))
        taken = got if taken is None else taken.unionByName(got)
        more = got.groupBy("chip").agg(F.count(F.lit(1)).alias("m"))
        counts = materialise(counts.join(sized(more), "chip", "left").select("chip", "region", "sza_bin", (F.col("k") + F.coalesce("m", F.lit(0))).alias("k")))
    return taken if taken is not None else held.limit(0).select(F.lit(0).alias("request"), "labeler", "chip")


def selected_scenes(scenes: DataFrame, boxes: DataFrame, windows: DataFrame, most_cloud: float, product: str) -> DataFrame:
    """Scenes of a product with few clouds whose box overlaps an area of interest and whose date lies in one of its windows, each pair once.

    scenes (id, x0, x1, y0, y1, acquired, cloud, product), boxes (region, minx, maxx, miny, maxy) and windows (name, m0, m1: months) are small tables (checked).
    """
    for t in (boxes, windows):
        if t.limit(10_001).count() > 10_000:
            raise ValueError("more than 10,000 boxes or windows")
    month = F.month("acquired")
    some = scenes.where((F.col("product") == product) & (F.col("cloud") <= most_cloud)).join(F.broadcast(windows), month.between(F.col("m0"), F.col("m1")))
    near = (F.col("x0") <= F.col("maxx")) & (F.col("x1") >= F.col("minx")) & (F.col("y0") <= F.col("maxy")) & (F.col("y1") >= F.col("miny"))
    return some.join(F.broadcast(boxes), near).select("id", "region", "name").distinct()
