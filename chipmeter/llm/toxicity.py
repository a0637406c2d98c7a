"""Operator 7, toxicity: class-conditional Kneser-Ney models, compared by length-normalised log-likelihood.

Each class c, toxic and ordinary, has a model that writes a text word by word, with the word before as context:

    P_c(w | v)    = max(n_c(v w) - D, 0) / n_c(v) + held_c(v) * P_c(w)
    P_c(w)        = P_c(stem) * P_c(w | stem)
    P_c(w | stem) = (max(n_c(w) - D, 0) + held_c(stem) * P(w | stem)) / n_c(stem)
    P_c(stem)     = (max(n_c(stem) - D, 0) + (held_c + 1) * P(stem)) / (n_c + 1)

D is the discount, held what it takes away, and a stem the first letters of a word. The last backoff counts are shared by both
classes: P(w | stem) is the word's share of its stem over both, and P(stem) the stem's share of all distinct words, its
continuation count. So an expression that is rare in both classes says what its words say, a rare word what its stem says, and
a rare stem the same as any other. n_c(w) and n_c(v w) are the numbers of distinct texts of the class that have the word or
pair, so copies of a text and repeats within one count once.

A number of n or fewer texts leaves nothing after a discount of n, so the model is exactly a table of the words, stems, contexts
and pairs with more texts than D in a class; everything else is the backoff. Nothing else is cut. Each row of the table
has a key and what it adds to the log-likelihood ratio of a word over what its backoff says, so a text's ratio at a
word is a constant and the sum of the rows it finds. A table of at most ``most_rows`` travels with the tasks; one of up to
``TIMES_MAPPED`` times as many is a file that each executor gets once and whose pages its workers share; a still larger one is
joined by key with the texts' words. All three give the same sums, but a join moves four rows for each word of the texts.

The score is a logistic function of the ratio per word and of the words' excess over a mark, summed and divided by the root of
their number, as a few toxic words in a long text leave its mean alone. Mark and weights come from a bounded sample of one in
five labelled texts, which are scored by counts without them; the counts that score afterwards are of all.
Texts are scored whole. Null and empty texts have no evidence, an empty table gives no scores. Rows that share an id or a text get the same score each;
a label counts once for each distinct text. Without labels of both classes the score is the share of label 1, and 0 if there are none.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bounded_sample, id_remainder, materialise
from .subword import fit_logistic

#: Discount, letters in a stem, rows of each class to calibrate on.
DISCOUNT, STEM, PER_CLASS = 3, 4, 3000
#: Marks to choose from, in nats.
MARKS = (1.0, 1.5, 2.0, 2.5, 3.0, 3.5)
#: Most rows of the table that travel with tasks (about 14 bytes each), and how many times as many are a mapped file; a larger table is joined.
MOST_ROWS, TIMES_MAPPED = 8_000_000, 25
#: Rows of the table that pass the driver at once, about.
SLICE = 2_000_000
#: Rows in a bucket of the table, about.
BUCKET = 4
#: Most labelled rows to broadcast to the texts; more are joined by shuffling.
BROADCAST_LABELS = 1_000_000
THRESHOLD = 0.3
#: Words whose numbers a task remembers before it starts afresh; bounds memory, not results.
CACHE = 150_000
#: Texts whose rows a task makes at once, and characters of those that it looks up at once.
AT_ONCE, CHARS = 128, 400_000
_WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Kinds of keys; the start of a text is the context 0.
WORD, STEMS, CONTEXT, PAIR = (np.uint64(k) for k in range(4))


def key(kind: np.uint64, h: np.ndarray, then: np.ndarray | None = None) -> np.ndarray:
    """Key (64 bits) of a word, stem, context or pair from the hashes of its words."""
    with np.errstate(over="ignore"):
        z = (h.view(np.uint64) + kind + np.uint64(1)) * _MIX
        z ^= z >> np.uint64(31)
        if then is not None:
            z = (z + then.view(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
            z ^= z >> np.uint64(29)
    return z.view(np.int64)


class Words:
    """Hashes of words and of their stems, remembered for the words met."""

    def __init__(self, letters: int = STEM):
        self.letters, self.known, self.rows = letters, {}, np.zeros((0, 2), np.int64)

    def numbers(self, words: list[str]) -> np.ndarray:
        """Row numbers of the words; a call may forget the numbers of earlier ones."""
        known = self.known
        new = list(set(words).difference(known))
        if new:
            if len(known) + len(new) > CACHE:
                known.clear()
                new = list(set(words))
            have, size = len(known), len(known) + len(new)
            if size > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros((size, 2), np.int64)])
            h = (xxhash.xxh64_intdigest(w) for w in chain.from_iterable((w, w[: self.letters]) for w in new))
            self.rows[have:size] = np.fromiter(h, np.uint64, 2 * len(new)).view(np.int64).reshape(-1, 2)
            known.update(zip(new, range(have, size)))
            self.added(have, size)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def added(self, have: int, size: int) -> None:
        pass


def _pieces(batches):
    for b in batches:
        for k in range(0, b.num_rows, AT_ONCE):
            yield b.slice(k, AT_ONCE)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _before(h: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, h.dtype), h[:-1]])


def _groups(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in order, in lists of about ``CHARS`` characters."""
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t or "")
        if size >= CHARS:
            yield some
            some, size = [], 0
    if some:
        yield some


def _bits(n: int) -> int:
    return max(1, (n // BUCKET).bit_length())


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where the buckets of sorted keys start, by their leading bits, and the end of the last one."""
    bits = _bits(len(keys))
    first = (np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) ^ np.uint64(1 << 63)
    return np.append(np.searchsorted(keys, first.view(np.int64)), len(keys)).astype(np.int32)


@dataclass
class Table:
    """Sorted keys, their values and the starts of buckets."""

    keys: np.ndarray
    values: np.ndarray
    starts: np.ndarray

    def found(self, wanted: np.ndarray) -> np.ndarray:
        """Values of the wanted keys, 0 where there is none. All wanted ones step through their buckets together."""
        out = np.zeros(len(wanted))
        bucket = ((wanted.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(64 - _bits(len(self.keys)))).view(np.int64)
        at, end = self.starts[bucket], self.starts[bucket + 1]
        todo = np.flatnonzero(at < end)
        at, end, wanted = at[todo], end[todo], wanted[todo]
        while len(todo):
            there = self.keys[at]
            hit = there == wanted
            out[todo[hit]] = self.values[at[hit]]
            at = at + 1
            more = (there < wanted) & (at < end)
            todo, at, end, wanted = todo[more], at[more], end[more], wanted[more]
        return out


@dataclass
class Mapped:
    """A table in a file that Spark copies to each executor; ``value`` maps it there, as a broadcast's value does."""

    name: str
    rows: int

    @property
    def value(self) -> tuple[Table]:
        return (Table(*map(np.asarray, _sections(SparkFiles.get(self.name), self.rows, "r"))),)


def _sections(path: str, n: int, mode: str) -> list[np.ndarray]:
    """Keys, values and starts in one file."""
    sizes, out, at = ((np.int64, n), (np.float32, n), (np.int32, (1 << _bits(n)) + 1)), [], 0
    for kind, size in sizes:
        out.append(np.memmap(path, kind, mode, offset=at, shape=(size,)))
        at += out[-1].nbytes
    return out


def _gather(table: DataFrame, keys: np.ndarray, values: np.ndarray) -> None:
    """Fill in the table's rows by key, a slice of the keys' range at a time, so the driver holds no second copy of all."""
    slices, at = -(-len(keys) // SLICE), 0
    bounds = [-(1 << 63) + ((1 << 64) * k // slices) for k in range(slices)]
    for low, high in zip(bounds, [*bounds[1:], 1 << 63]):
        rows = table.where(F.col("key").between(F.lit(low), F.lit(high - 1))).toArrow()
        k, v = rows["key"].to_numpy(), rows["value"].to_numpy()
        order = np.argsort(k, kind="stable")
        keys[at : at + len(k)], values[at : at + len(k)] = k[order], v[order]
        at += len(k)


def at_hand(table: DataFrame, n: int) -> Broadcast:
    keys, values = np.empty(n, np.int64), np.empty(n, np.float32)
    _gather(table, keys, values)
    return table.sparkSession.sparkContext.broadcast((Table(keys, values, _starts(keys)),))


def mapped(table: DataFrame, n: int) -> Mapped:
    folder = os.path.realpath(tempfile.mkdtemp(prefix="toxicity-"))
    atexit.register(shutil.rmtree, folder, True)
    path = f"{folder}/{uuid.uuid4().hex}.table"
    with open(path, "wb") as f:
        f.truncate(12 * n + 4 * ((1 << _bits(n)) + 1))
    keys, values, starts = _sections(path, n, "r+")
    _gather(table, keys, values)
    starts[:] = _starts(keys)
    for part in (keys, values, starts):
        part.flush()
    table.sparkSession.sparkContext.addFile(path)
    return Mapped(os.path.basename(path), n)


class Ratios(Words):
    """Log-likelihood ratios of the words of texts, from the sorted table."""

    def __init__(self, table: Table, constant: float, letters: int = STEM):
        super().__init__(letters)
        self.table, self.constant, self.own = table, constant, np.zeros((0, 2))
        self.start = table.found(key(CONTEXT, np.zeros(1, np.int64)))[0]

    def added(self, have: int, size: int) -> None:
        if size > len(self.own):
            self.own = np.concatenate([self.own, np.zeros((len(self.rows) - len(self.own), 2))])
        h, s = self.rows[have:size].T.copy()
        self.own[have:size, 0] = self.table.found(key(WORD, h)) + self.table.found(key(STEMS, s))
        self.own[have:size, 1] = self.table.found(key(CONTEXT, h))

    def of(self, text: str | None) -> np.ndarray:
        return self.of_all([text])[0]

    def of_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ratios of each text; pairs of all texts are looked up together."""
        each = [words_of(t) for t in texts]
        sizes = np.array([len(words) for words in each])
        at = self.numbers(list(chain.from_iterable(each)))
        out = self.own[at, 0] + self.constant
        ends = np.cumsum(sizes)
        if len(at):
            first = (ends - sizes)[sizes > 0]
            h, v = self.rows[at, 0], _before(self.rows[at, 0])
            before = np.concatenate([[0.0], self.own[at[:-1], 1]])
            v[first], before[first] = 0, self.start
            out += before
            some = np.flatnonzero(before)  # a pair of the table has a context of the table
            out[some] += self.table.found(key(PAIR, v[some], h[some]))
        return np.split(out, ends[:-1])


def features(ratios: np.ndarray, marks: tuple[float, ...]) -> tuple[float, list[float]]:
    """Ratio per word, and the words' excess over each mark by the root of their number (0 without words)."""
    n = max(1, len(ratios))
    high = ratios[ratios > min(marks)]
    return float(ratios.sum() / n), [float(np.maximum(high - m, 0).sum() / n**0.5) for m in marks]


@dataclass
class Model:
    """The table (key, value), the ratio where nothing is found, and the table's sorted arrays if tasks have them at hand or map them."""

    table: DataFrame
    constant: float
    near: Broadcast | Mapped | None
    letters: int = STEM


@dataclass
class Scorer:
    model: Model | None = None
    mark: float = MARKS[0]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(3))
    constant: float = 0.0


def _sums(names: str) -> list[Column]:
    return [F.sum(c).alias(c) for c in names.split()]


def word_counts(rows: DataFrame, letters: int = STEM) -> DataFrame:
    """word, stem (hashes); n1, n0: how many texts of rows (y, aside, text) have the word, f1, f0: pairs of a text and a word behind it;
    the same without the texts set aside: kn1, kn0, kf1, kf0. The start of a text counts as context 0 without n."""

    def run(batches):
        known = Words(letters)
        for b in _pieces(batches):
            out = []
            for y, aside, t in zip(*(b.column(c).to_pylist() for c in ("y", "aside", "text"))):
                at = known.numbers(words_of(t))
                if len(at):
                    own, at = np.unique(at, return_inverse=True)
                    follow = np.bincount(np.unique(at[:-1] * len(own) + at[1:]) // len(own), minlength=len(own))
                    h = np.concatenate([known.rows[own], np.zeros((1, 2), np.int64)])
                    n, f = np.append(np.ones(len(own), np.int64), 0), np.append(follow, 1)
                    zero = np.zeros(len(n), np.int64)
                    both = [n, zero, f, zero] if y else [zero, n, zero, f]
                    out.append([h[:, 0], h[:, 1], *both, *([zero] * 4 if aside else both)])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names.split())

    names = "word stem n1 n0 f1 f0 kn1 kn0 kf1 kf0"
    each = rows.select("y", "aside", "text").mapInArrow(run, ", ".join(f"{c} long" for c in names.split()))
    return each.groupBy("word", "stem").agg(*_sums("n1 n0 f1 f0 kn1 kn0 kf1 kf0"))


def pair_counts(rows: DataFrame, often: np.ndarray | None, discount: int = DISCOUNT, letters: int = STEM) -> DataFrame:
    """v, w (hashes) and n1, n0, kn1, kn0 of the pairs with more texts than ``discount`` in a class.

    ``often``, the sorted hashes of all words with more texts than that, saves counting other pairs, which cannot have
    more, and makes rows short (places instead of hashes). None: there are too many to send.
    """

    def run(batches):
        known = Words(letters)
        hashes = None if often is None else often.value
        for b in _pieces(batches):
            out = []
            for y, aside, t in zip(*(b.column(c).to_pylist() for c in ("y", "aside", "text"))):
                at = known.numbers(words_of(t))
                h = known.rows[at, 0]
                w, v = h, _before(h)
                if hashes is not None and len(h):
                    at = np.minimum(np.searchsorted(hashes, h), max(0, len(hashes) - 1))
                    at = np.where(hashes[at] == h, at, -2) if len(hashes) else np.full(len(h), -2)
                    w, v = at, np.concatenate([[-1], at[:-1]])  # -1: the start, -2: no such word
                    some = (w >= 0) & (v >= -1)
                    w, v = w[some], v[some]
                if len(w):
                    _, at = np.unique(key(PAIR, v, w), return_index=True)
                    v, w = v[at], w[at]
                    one, zero = np.ones(len(w), np.int64), np.zeros(len(w), np.int64)
                    both = [one, zero] if y else [zero, one]
                    out.append([v, w, *both, *([zero] * 2 if aside else both)])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names.split())

    def back(batches):
        hashes = often.value
        for b in batches:
            v, w = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.where(v < 0, 0, hashes[v])), pa.array(hashes[w]), *b.columns[2:]], names.split())

    names = "v w n1 n0 kn1 kn0"
    schema = ", ".join(f"{c} long" for c in names.split())
    out = rows.select("y", "aside", "text").mapInArrow(run, schema).groupBy("v", "w").agg(*_sums("n1 n0 kn1 kn0"))
    out = out.where((F.col("n1") > discount) | (F.col("n0") > discount))
    return materialise(out if often is None else out.mapInArrow(back, schema))


def _keyed(df: DataFrame, kind: np.uint64) -> DataFrame:
    """key and value from (h, value) or (h, then, value)."""
    some = len(df.columns) == 3

    def run(batches):
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            yield pa.RecordBatch.from_arrays([pa.array(key(kind, cols[0], cols[1] if some else None)), b.columns[-1]], ["key", "value"])

    return df.toDF(*(["h", "then", "value"] if some else ["h", "value"])).mapInArrow(run, "key long, value double")


def _ratio(p: dict[str, Column]) -> Column:
    return F.log(p["1"]) - F.log(p["0"])


def model(words: DataFrame, pairs: DataFrame, discount: int = DISCOUNT, letters: int = STEM, most_rows: int = MOST_ROWS, times_mapped: int = TIMES_MAPPED) -> Model | None:
    """The model from words (word, stem, n1, n0, f1, f0) and pairs (v, w, n1, n0)."""
    d = float(discount)
    more = lambda c: F.greatest(F.col(c) - d, F.lit(0.0))
    held = lambda c: F.least(F.col(c).cast("double"), F.lit(d))
    cs = ("1", "0")
    real = words.where("n1 + n0 > 0")
    stems = real.groupBy("stem").agg(*[F.sum(f"n{c}").alias(f"s{c}") for c in cs], *[F.sum(held(f"n{c}")).alias(f"h{c}") for c in cs], F.count(F.lit(1)).alias("types"))
    total = stems.agg(*[F.sum(f"s{c}").alias(f"s{c}") for c in cs], *[F.sum(held(f"s{c}")).alias(f"h{c}") for c in cs], F.sum("types").alias("types")).first()
    if not total.types:
        return None
    constant = float(np.log((total.h1 + 1) / (total.s1 + 1)) - np.log((total.h0 + 1) / (total.s0 + 1)))
    of_stem = {c: (more(f"s{c}") + (total[f"h{c}"] + 1) * F.col("types") / total.types) / (total[f"s{c}"] + 1) for c in cs}
    rest = {c: F.when(F.col(f"s{c}") > 0, F.col(f"h{c}") / F.col(f"s{c}")).otherwise(1.0) for c in cs}
    stems = stems.where(F.greatest("s1", "s0") > d)
    stems = materialise(stems.select("*", *[of_stem[c].alias(f"p{c}") for c in cs], (_ratio(of_stem) + _ratio(rest)).alias("says")))

    share = (F.col("n1") + F.col("n0")) / (F.col("s1") + F.col("s0"))
    of_word = {c: F.col(f"p{c}") * F.when(F.col(f"s{c}") > 0, (more(f"n{c}") + F.col(f"h{c}") * share) / F.col(f"s{c}")).otherwise(share) for c in cs}
    often = real.where(F.greatest("n1", "n0") > d).join(stems, "stem")
    often = often.select("word", "says", *[of_word[c].alias(f"p{c}") for c in cs])
    often = materialise(often.select("word", "p1", "p0", _ratio({c: F.col(f"p{c}") for c in cs}).alias("ratio"), "says"))

    pairs = pairs.where(F.greatest("n1", "n0") > d)
    taken = pairs.groupBy("v").agg(*[F.sum(more(f"n{c}")).alias(f"t{c}") for c in cs])
    left = {c: F.when(F.col(f"f{c}") > 0, 1 - F.col(f"t{c}") / F.col(f"f{c}")).otherwise(1.0) for c in cs}
    contexts = taken.join(words.select(F.col("word").alias("v"), "f1", "f0"), "v").select("v", "f1", "f0", *[left[c].alias(f"l{c}") for c in cs])
    contexts = materialise(contexts)
    both = pairs.join(contexts, "v").join(often.select(F.col("word").alias("w"), "p1", "p0", "ratio"), "w")
    of_pair = {c: F.when(F.col(f"f{c}") > 0, more(f"n{c}") / F.col(f"f{c}")).otherwise(0.0) + F.col(f"l{c}") * F.col(f"p{c}") for c in cs}
    rests = _ratio({c: F.col(f"l{c}") for c in cs})
    parts = [
        _keyed(stems.select("stem", F.col("says") - constant), STEMS), _keyed(often.select("word", F.col("ratio") - F.col("says")), WORD),
        _keyed(contexts.select("v", rests), CONTEXT), _keyed(both.select("v", "w", _ratio(of_pair) - rests - F.col("ratio")), PAIR),
    ]
    table = parts[0]
    for p in parts[1:]:
        table = table.unionByName(p)
    table = materialise(table.select("key", F.col("value").cast("float").alias("value")).where("value <> 0"))  # the same numbers on both ways
    n, near = table.count(), None
    if n <= most_rows:
        near = at_hand(table, n)
    elif n <= most_rows * times_mapped:
        near = mapped(table, n)
    return Model(table, constant, near, letters)


def evidence(rows: DataFrame, model: Model, marks: tuple[float, ...] = MARKS) -> DataFrame:
    """The columns of rows (text, others) but for text, and the features ``whole`` and ``excess`` (one for each mark)."""
    others = [c for c in rows.columns if c != "text"]
    kept = [rows.schema[c] for c in others]
    near, constant, letters = model.near, model.constant, model.letters
    names, kinds = ["whole", "excess"], (pa.float64(), pa.list_(pa.float64()))

    def run(batches):
        ratios = Ratios(*near.value, constant, letters)
        for b in _pieces(batches):
            made = [features(r, marks) for some in _groups(b.column("text").to_pylist()) for r in ratios.of_all(some)]
            cols = zip(*made) if made else ((), ())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in others], *[pa.array(c, k) for c, k in zip(cols, kinds)]], [*others, *names])

    schema = StructType([*kept, *StructType.fromDDL("whole double, excess array<double>").fields])
    if near:
        return rows.mapInArrow(run, schema)

    # the table doesn't travel: each distinct text's keys meet it in a join
    def keys(batches):
        known = Words(letters)
        for b in _pieces(batches):
            out = [np.zeros((0, 3), np.int64)]
            for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at = known.numbers(words_of(t))
                own, stem = known.rows[at].T
                v = _before(own)
                made = np.concatenate([key(WORD, own.copy()), key(STEMS, stem.copy()), key(CONTEXT, v), key(PAIR, v, own.copy())]) if len(own) else own
                out.append(np.stack([np.full(len(made), h), np.tile(np.arange(len(own)), 4), made], axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(out).T], ["_h", "at", "key"])

    def sums(batches):
        for b in batches:
            made = []
            for n, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                ratios = np.full(n, constant)
                for f in found or ():
                    ratios[f["at"]] += f["value"]
                made.append(features(ratios, marks))
            cols = zip(*made) if made else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["_h", *names])

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(words_of(t)) for t in b.column(1).to_pylist()], pa.int32())], ["_h", "n"])

    texts = rows.groupBy(F.xxhash64("text").alias("_h")).agg(F.min("text").alias("text"))
    texts = materialise(texts)
    found = texts.mapInArrow(keys, "_h long, at long, key long").join(model.table, "key").groupBy("_h").agg(F.collect_list(F.struct("at", "value")).alias("found"))
    each = texts.mapInArrow(sizes, "_h long, n int").join(found, "_h", "left").select("_h", "n", "found").mapInArrow(sums, "_h long, whole double, excess array<double>")
    each = materialise(each)
    return rows.withColumn("_h", F.xxhash64("text")).join(each, "_h").select(*others, *names)


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, label: str = "toxic", text: str = "text", doc_id: str = "doc_id", discount: int = DISCOUNT, per_class: int = PER_CLASS, most_rows: int = MOST_ROWS) -> Scorer:
    """Learn from the ``labels`` rows where ``learn`` holds (all, if None)."""
    known = labels if learn is None else labels.where(learn)
    known = known.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("y")).dropDuplicates(["_id"])
    n = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    if len(n) < 2:
        return Scorer(constant=n.get(1, 0) / max(1, sum(n.values())))
    few = sum(n.values()) <= BROADCAST_LABELS
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(known) if few else known, "_id")
    # one row for each distinct text and label: its smallest id
    first = rows.groupBy(F.xxhash64("text").alias("_h"), "y").agg(F.min("_id").alias("_id"))
    first = materialise(first.select("_id", "_h", F.pmod(F.xxhash64(F.lit("aside"), "_h"), F.lit(5)) == 0).toDF("_id", "_h", "aside").dropDuplicates(["_id", "_h"]))
    rows = rows.withColumn("_h", F.xxhash64("text")).join(F.broadcast(first) if few else first, ["_id", "_h"])
    words = materialise(word_counts(rows))
    out = Scorer(constant=n[1] / (n[0] + n[1]))
    hashes = words.where((F.col("n1") > discount) | (F.col("n0") > discount)).select("word")
    often = None
    if hashes.count() <= most_rows:
        often = docs.sparkSession.sparkContext.broadcast(np.sort(hashes.toArrow()["word"].to_numpy()))
    pairs = pair_counts(rows, often, discount)
    kept = lambda df, keys, cols: df.select(*keys, *[F.col(f"k{c}").alias(c) for c in cols])
    # few texts are scored on trial, so a large table is joined with them instead of copied
    trial = model(kept(words, ["word", "stem"], ["n1", "n0", "f1", "f0"]), kept(pairs, ["v", "w"], ["n1", "n0"]), discount, most_rows=most_rows, times_mapped=0)
    if trial is None:
        return out
    check = evidence(bounded_sample(rows.where("aside"), "y", F.col("_id"), per_class).select("_id", "y", "text"), trial).toPandas().sort_values(["_id", "whole"])
    y = check.y.to_numpy()
    if len(set(y)) < 2:
        return out
    out.model = model(words, pairs, discount, most_rows=most_rows)
    share = np.array([n[k] / (y == k).sum() for k in (0, 1)])
    share = share[y] / share[y].sum() * len(y)
    least = np.inf
    for mark, excess in zip(MARKS, np.stack(check.excess).T):
        x = np.column_stack([check.whole, excess, np.ones(len(y))])
        w = fit_logistic(x, y.astype(float), share)
        loss = (share * np.logaddexp(0, np.where(y == 1, -1, 1) * (x @ w))).sum()
        if loss < least:
            least, out.mark, out.weights = loss, mark, w
    return out


def scores(docs: DataFrame, scorer: Scorer, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and score of every row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if scorer.model is None:
        return rows.select("doc_id", F.lit(float(scorer.constant)).alias("score"))
    a, b, c = map(float, scorer.weights)
    z = F.col("whole") * a + F.col("excess")[0] * b + c
    return evidence(rows, scorer.model, (scorer.mark,)).select("doc_id", (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))).alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held_out = id_remainder("doc_id", 4) == 2
    out = scores(docs, fit(docs, labels, ~held_out))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
