"""Operator 3, substring dedup: suffix automata of reference shards, matching statistics, maximal spans removed.

A window is ``length`` consecutive words (runs of characters that are not ASCII white space) of one document. A word goes
if a window covers it whose word sequence also starts in a document with a smaller doc_id. Null ids come last and
rows that share an id are not compared with each other. Null texts have no words.

Streaming all documents past an automaton of all text is quadratic, so the reference is dealt into shards first, by
content: a window belongs to the shard named by its anchor, the smallest hash among its ``gram``-word runs. Windows of
the same words have the same anchor, wherever they stand. A run of windows with one anchor is a segment; hashes only decide
which segments meet, and every word that goes has been matched by an automaton of words. Then

1. segments whose anchor no other document has are unique and go no further;
2. each other shard streams its segments in the order of ids past its suffix automaton, which gives the longest match that
   ends at each word, and adds them to it afterwards. Matches of ``length`` words or more are removed;
3. a shard of more than ``shard`` segments is salted: its different segments, each with the smallest id that has it, go to every
   salt as the reference, and the others stream past them by salt, in the same order;
4. if such a shard has more than ``shard`` different segments, these are dealt anew by anchors of longer runs of words, at last by
   whole windows, which are all equal within a shard. So no shard grows with the corpus and nothing is left out.

Shards are replicated to the salts that need them instead of broadcast to all tasks, as together they grow with the corpus.
Repeated rows (same id and text) get the same result each. Documents of fewer words than ``length`` lose none, nor do
those of an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, order_id, text_or_empty

LENGTH, GRAM, SHARD = 50, 8, 1000
#: Words whose hashes a task remembers before it starts afresh.
CACHE = 400_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Hasher:
    """Hashes of all runs of a document's words, from running sums: words are numbers, runs are polynomials."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.up = self.down = np.ones(1, np.uint64)

    def load(self, words: list[bytes]) -> None:
        if len(self.known) > CACHE:
            self.known.clear()
        known = self.known
        try:
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            for w in set(words).difference(known):
                known[w] = xxhash.xxh64_intdigest(w)
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if len(self.up) <= len(words):
            n = 2 * len(words) + 2
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BACK)]), dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * self.up[: len(h)], dtype=np.uint64)])

    def runs(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return _mix((self.sums[start + size] - self.sums[start]) * self.down[start] + np.asarray(size).astype(np.uint64))


def segments_of(words: list[bytes], hasher: Hasher, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """First word, number of words, anchor and hash of each maximal run of windows with one anchor."""
    n = len(words) - length + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 4
    hasher.load(words)
    low = hasher.runs(np.arange(len(words) - gram + 1), gram)
    span, have = length - gram + 1, 1
    while 2 * have <= span:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < span:
        low = np.minimum(low[: n], low[span - have : span - have + n])
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    size = np.diff(np.append(first, n)) + length - 1
    return first, size, low[first].view(np.int64), hasher.runs(first, size).view(np.int64)


class Automaton:
    """Suffix automaton of a set of word sequences, extended online; sequences are kept apart by marks of their own."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.len, self.last, self.marks = [-1], [0], 0, 0

    def _extend(self, c) -> None:
        nxt, link, length = self.next, self.link, self.len
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[self.last] + 1)
        p = self.last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(nxt[q].copy())
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        self.last = cur

    def add(self, words: Iterable[bytes]) -> None:
        for w in words:
            self._extend(w)
        self.marks += 1
        self._extend(self.marks)  # a number is no word

    def matches(self, words: list[bytes], least: int) -> Iterator[tuple[int, int]]:
        """Maximal spans [start, end) of at least ``least`` words that some added sequence has."""
        nxt, link, length = self.next, self.link, self.len
        v = size = 0
        for i, w in enumerate(words):
            if w not in nxt[v]:
                if size >= least:
                    yield i - size, i
                while v > 0 and w not in nxt[v]:
                    v = link[v]
                size = length[v]
            if w in nxt[v]:
                v = nxt[v][w]
                size += 1
            else:
                size = 0
        if size >= least:
            yield len(words) - size, len(words)


def _rows(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """_id orders documents; with _h, the text's hash, it names a row's result, also where ids repeat."""
    return docs.select(order_id(doc_id).alias("_id"), F.xxhash64(text_or_empty(text)).alias("_h"), text_or_empty(text).cast("binary").alias("text"))


def segments(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """_id, _h, start, size, anchor, seg of every segment of every document."""

    def run(batches):
        hasher = Hasher()
        for b in batches:
            out, count = [], []
            for t in b.column(2).to_pylist():
                out.append(segments_of(t.split(), hasher, length, gram))
                count.append(len(out[-1][0]))
            at = np.repeat(np.arange(len(count)), count)
            cols = [pa.array(np.concatenate([o[i] for o in out])) for i in range(4)] if out else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), *cols], ["_id", "_h", "start", "size", "anchor", "seg"])

    return _rows(docs, text, doc_id).mapInArrow(run, "_id long, _h long, start long, size long, anchor long, seg long")


SEGMENT = "_id long, _h long, anchor long, seg long, start long, words binary"
_NAMES = ["_id", "_h", "anchor", "seg", "start", "words"]


def _cut(docs: DataFrame, wanted: DataFrame, text: str, doc_id: str) -> DataFrame:
    """_id, _h, anchor, seg, start and the words of the wanted segments (_id, _h, anchor, seg, start, size)."""
    lists = wanted.groupBy("_id", "_h").agg(F.collect_set(F.struct("anchor", "seg", "start", "size")).alias("want"))
    rows = _rows(docs, text, doc_id)
    if wanted.groupBy("_id", "_h", "start").count().where("count > 1").limit(1).count():  # rows of the same id and text
        rows = rows.dropDuplicates(["_id", "_h"])
    rows = rows.join(lists, ["_id", "_h"]).select("_id", "_h", "text", "want.anchor", "want.seg", "want.start", "want.size")

    def run(batches):
        for b in batches:
            at, cut = [], []
            for k, (t, st, sz) in enumerate(zip(*(b.column(i).to_pylist() for i in (2, 5, 6)))):
                words = t.split()
                at += [k] * len(st)
                cut += [b" ".join(words[s : s + z]) for s, z in zip(st, sz)]
            take = pa.array(at, pa.int64())
            flat = [b.column(i).flatten() for i in (3, 4, 5)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *flat, pa.array(cut, pa.binary())], _NAMES)

    return rows.mapInArrow(run, SEGMENT)


def _dealt_anew(segs: DataFrame, length: int, gram: int) -> DataFrame:
    """The segments' windows in segments by anchors of ``gram``-word runs."""

    def run(batches):
        hasher = Hasher()
        for b in batches:
            at, out, cut = [], [(np.zeros(0, np.int64),) * 3], []
            for k, (s, w) in enumerate(zip(b.column(4).to_pylist(), b.column(5).to_pylist())):
                words = w.split(b" ")
                first, size, anchor, seg = segments_of(words, hasher, length, gram)
                at += [k] * len(first)
                out.append((anchor, seg, s + first))
                cut += [b" ".join(words[f : f + z]) for f, z in zip(first, size)]
            take = pa.array(at, pa.int64())
            cols = [pa.array(np.concatenate(c)) for c in zip(*out)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *cols, pa.array(cut, pa.binary())], _NAMES)

    return _shared(materialise(segs.mapInArrow(run, SEGMENT)))


def _shared(segs: DataFrame) -> DataFrame:
    """Segments whose anchor is in two documents at least."""
    shared = segs.groupBy("anchor").agg(F.min("_id").alias("low"), F.max("_id").alias("high")).where("low < high").select("anchor")
    return segs.join(materialise(shared), "anchor").select(*segs.columns)


def _stream(shards: DataFrame, length: int) -> DataFrame:
    """Spans (_id, _h, start, size) of rows (anchor, salt, _id, ref, _h, start, words).

    Where a shard has rows with ``ref``, these alone are its reference; else all of its segments are.
    """

    def run(batches):
        shard, ident = None, None
        for b in batches:
            out = []
            for a, salt, i, ref, h, s, w in zip(*(b.column(k).to_pylist() for k in range(7))):
                if (a, salt) != shard:
                    shard, ident, auto, own, later = (a, salt), i, Automaton(), {}, {}
                elif i != ident:
                    for x in later:
                        auto.add(x)
                    ident, own, later = i, {}, {}
                if ref:
                    later[tuple(w.split(b" "))] = None
                    continue
                if w not in own:  # a document may have a segment several times
                    words = w.split(b" ")
                    own[w] = list(auto.matches(words, length))
                    if not salt and own[w] != [(0, len(words))]:
                        later[tuple(words)] = None
                out += [(i, h, s + x, y - x) for x, y in own[w]]
            cols = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["_id", "_h", "start", "size"])

    ordered = shards.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "_id", "ref")
    return ordered.mapInArrow(run, "_id long, _h long, start long, size long")


def _match(segs: DataFrame, length: int, grams: list[int], shard: int) -> DataFrame:
    """Spans of segments; shards with too many different ones are dealt anew by the ``grams`` that are left."""
    hot = segs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard)
    hot = materialise(hot.select("anchor", F.ceil(F.col("n") / shard).cast("int").alias("salts")))
    cols = ["anchor", "salt", "_id", "ref", "_h", "start", "words"]
    row = lambda df, salt, ref: df.withColumns({"salt": salt, "ref": F.lit(ref)}).select(cols)
    many = hot.count()
    if not many:
        return _stream(row(segs, F.lit(0), False), length)
    small = F.broadcast if many <= 100_000 else lambda df: df
    out = row(segs.join(small(hot), "anchor", "left_anti"), F.lit(0), False)
    large = segs.join(small(hot), "anchor")
    rest = None
    by = ["anchor", "salts"]  # at last all windows of a shard are equal, and one reference is enough
    if grams:
        by.append("seg")
        wide = large.groupBy("anchor").agg(F.countDistinct("seg").alias("kinds")).where(F.col("kinds") > shard)
        wide = materialise(wide.select("anchor"))
        if wide.limit(1).count():
            anew = _dealt_anew(large.join(small(wide), "anchor", "left_semi").select(_NAMES), length, grams[0])
            rest = _match(materialise(anew), length, grams[1:], shard)
            large = large.join(small(wide), "anchor", "left_anti")
    refs = large.groupBy(*by).agg(F.min(F.struct("_id", "words")).alias("f")).select("anchor", F.explode(F.sequence(F.lit(1), "salts")).alias("salt"), "f._id", "f.words")
    refs = refs.withColumns({"ref": F.lit(True), "_h": F.lit(0).cast("long"), "start": F.lit(0).cast("long")}).select(cols)
    spread = row(large, (F.pmod(F.xxhash64("_id", "_h"), F.col("salts")) + 1).cast("int"), False)
    out = _stream(out.unionByName(refs).unionByName(spread), length)
    return out.unionByName(rest) if rest is not None else out


def spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """_id, _h, start, size of word spans to remove; they may overlap."""
    gram = min(gram, length)
    wanted = materialise(_shared(materialise(segments(docs, text, doc_id, length, gram))))
    grams = []
    while gram < length:
        gram = min(2 * gram, length)
        grams.append(gram)
    return _match(materialise(_cut(docs, wanted, text, doc_id)), length, grams, shard)


def _apply(docs: DataFrame, found: DataFrame, text: str, doc_id: str, make, schema: str) -> DataFrame:
    """make(words, kept mask) for each row of ``docs``; ``schema`` names its values."""
    lists = found.groupBy("_id", "_h").agg(F.collect_set(F.struct("start", "size")).alias("gone"))
    rows = _rows(docs, text, doc_id).withColumn("doc_id", F.when(F.col("_id") < 2**63 - 1, F.col("_id"))).join(lists, ["_id", "_h"], "left")

    def run(batches):
        for b in batches:
            out = []
            for t, st, sz in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                words = t.split()
                keep = np.ones(len(words), bool)
                for s, z in zip(st or (), sz or ()):
                    keep[s : s + z] = False
                out.append(make(words, keep))
            cols = list(zip(*out)) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string())))], ["doc_id", "n_words", "n_removed", "kept"])

    return rows.select("doc_id", "text", "gone.start", "gone.size").mapInArrow(run, f"doc_id long, {schema}")


def _joined(words: list[bytes], keep: np.ndarray) -> bytes:
    return b" ".join(words if keep.all() else [w for w, k in zip(words, keep) if k])


def substring_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **params) -> DataFrame:
    """doc_id, n_words, n_removed and kept: the words that stay, joined by single spaces."""
    make = lambda words, keep: (len(words), int(len(words) - keep.sum()), _joined(words, keep).decode())
    return _apply(docs, spans(docs, text, doc_id, **params), text, doc_id, make, "n_words long, n_removed long, kept string")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    make = lambda words, keep: (len(words), int(len(words) - keep.sum()), hashlib.sha256(_joined(words, keep)).hexdigest())
    out = _apply(docs, spans(docs), "text", "doc_id", make, "n_words long, n_removed long, kept string")
    return out.withColumnRenamed("kept", "kept_sha256")


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, hash(ws[i:i + 49]) AS h, md5(array_to_string(ws[i:i + 49], ' ')) AS m FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h, m) AS first FROM g),
r AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM f WHERE first < doc_id) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(len(ps), 0) AS n_removed,
 sha256(CASE WHEN ps IS NULL THEN array_to_string(ws, ' ') ELSE array_to_string(list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda x: NOT list_contains(ps, x[2])), lambda x: x[1]), ' ') END) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)
"""
