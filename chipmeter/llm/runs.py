"""Operator 11, periodic run detection: online dyadic square catching over a stream of words.

A run is a stretch of words with smallest period q, at least max(12, 2 q) words long, that no neighbouring word extends.

Of a square with period p in [2^(k+1) - 1, 2^(k+2) - 2] the left half holds a whole block of 2^k words that starts at a
multiple of 2^k, and the block returns p words later. So at each level k every completed block is a catcher: each appended
word completes one window of 2^k words, which is compared with the two catchers of that level whose distance is in the range
(:meth:`Catchers.append`). Where block after block answers at one distance, the first one's words before it and the last one's
words after it are compared (at most 2^k on each side, as the next block would have answered else); a stretch that reaches
the end of what has been appended stays open and grows with the next words. Stretches of two periods or more are squares
merged into one run. That is two comparisons a level for each word, n log n for n words, whatever the words are.

Windows are named by hashes of 64 bits that double from level to level, words by exact numbers. Every run is compared word by
word before it is returned, and names are drawn anew should one of them fail.

Rows: null texts have no words and no runs, empty texts too; equal rows give equal results; ties of the longest run go to
the smallest start, then period. A document is held in one task, with 8 bytes a word for each level: a text of 10 million words
needs 1.8 GB. An empty table gives no rows, and other columns of the documents play no part.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value of the contract: fewest words of a run.
LEAST = 12
#: Words of short documents that are appended together.
TOGETHER = 100_000
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)

SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_RUNS = np.dtype([("start", "i8"), ("end", "i8"), ("period", "i8")])


def _mix(x: np.ndarray, odd: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(odd)
    return x ^ (x >> np.uint64(32))


class Catchers:
    """Online detector: ``append`` words (numbers), then ``runs`` gives the runs so far.

    State: the words, for each level the names of their windows (the catchers are every 2^k-th of them), the stretches that still
    grow (start and period) and the squares whose stretch has ended.
    """

    def __init__(self, least: int = LEAST, seed: int = 0) -> None:
        self.least, self.seed = least, seed
        self.words = np.empty(0, np.uint64)
        self.names: list[np.ndarray] = [np.empty(0, np.uint64)]
        self.open = self.done = np.empty(0, _RUNS)

    def _grow(self, words: np.ndarray) -> list[int]:
        """Append to the names of all levels; for each level, the first window that is new."""
        odd, other = _ODD[self.seed % 4], _ODD[(self.seed + 1) % 4] + 2 * (self.seed // 4)
        self.words = np.concatenate([self.words, words])
        first = [len(self.names[0])]
        self.names[0] = np.concatenate([self.names[0], _mix(words, odd)])
        k = 0
        while (4 << k) - 1 <= len(self.words) // 2:  # a level more as soon as its shortest period fits twice
            k += 1
            if k == len(self.names):
                self.names.append(np.empty(0, np.uint64))
            half, have = 1 << (k - 1), len(self.names[k])
            low = self.names[k - 1][have:]
            first.append(have)
            self.names[k] = np.concatenate([self.names[k], _mix(low[:-half] * np.uint64(other) + low[half:], odd)])
        return first

    def _reach(self, a: np.ndarray, b: np.ndarray, level: int, back: bool) -> np.ndarray:
        """How many words, fewer than 2^level, agree before (or from) the places a < b."""
        n, got = len(self.words), np.zeros(len(a), np.int64)
        for j in range(level - 1, -1, -1):
            step = 1 << j
            x, y = (a - got - step, b - got - step) if back else (a + got, b + got)
            fits = np.flatnonzero((x >= 0) & (y + step <= n))
            same = fits[self.names[j][x[fits]] == self.names[j][y[fits]]]
            got[same] += step
        return got

    def append(self, words: np.ndarray) -> None:
        """Advance by one word or by many; the runs are the same however the words are dealt out."""
        before = len(self.words)
        first = self._grow(np.asarray(words, np.uint64))
        n = len(self.words)
        if n == before:
            return
        found = [self._advance(before)]
        for k, new in enumerate(first):
            x, period = self._answers(k, new)
            if not len(x):
                continue
            block, step = x - period, 1 << k
            order = np.lexsort((block, period))
            block, period = block[order], period[order]
            name = self.names[k]
            at = np.maximum(block - step, 0)
            head = (block < step) | (name[at] != name[at + period])
            joint = np.concatenate([[False], (period[1:] == period[:-1]) & (block[1:] == block[:-1] + step)])
            begins = np.flatnonzero(~joint)  # blocks in a row with one period
            last = np.append(begins[1:], len(block)) - 1
            begins, last = begins[head[begins]], last[head[begins]]  # others belong to a stretch that was open before
            p, a, e = period[begins], block[begins], block[last] + step
            likely = (e - a + 2 * step + p >= np.maximum(2 * p, self.least)) | (e + p + step > n)
            p, a, e = p[likely], a[likely], e[likely]
            a = a - self._reach(a, a + p, k, True)
            e = e + p + self._reach(e, e + p, k, False)
            found.append(np.rec.fromarrays([a, e, p], dtype=_RUNS))
        now = np.concatenate(found)
        at_end = now["end"] == n
        self.open = now[at_end]
        ended = now[~at_end]
        self.done = np.concatenate([self.done, ended[self._square(ended)]])

    def _answers(self, k: int, new: int) -> tuple[np.ndarray, np.ndarray]:
        """New windows of level k that equal one of their two catchers: window starts and distances."""
        name, step = self.names[k], 1 << k
        x = np.arange(new, len(name))
        near = ((x - 2 * step + 1) >> k) << k
        starts, periods = [], []
        for block in (near, near - step):
            ok = block >= 0
            hit = np.flatnonzero(ok & (name[np.where(ok, block, 0)] == name[new:]))
            starts.append(x[hit])
            periods.append(x[hit] - block[hit])
        return np.concatenate(starts), np.concatenate(periods)

    def _advance(self, before: int) -> np.ndarray:
        """Open stretches, as far as the appended words carry them on."""
        out = self.open.copy()
        active, at = np.arange(len(out)), np.full(len(out), before)
        levels = len(self.names)
        while len(active):
            got = self._reach(at[active] - out["period"][active], at[active], levels, False)
            at[active] += got
            active = active[got == (1 << levels) - 1]  # as far as one look goes: look again
        out["end"] = at
        return out

    def _square(self, s: np.ndarray) -> np.ndarray:
        return s["end"] - s["start"] >= np.maximum(2 * s["period"], self.least)

    def runs(self) -> np.ndarray | None:
        """All runs by start, then period, or None if a comparison by words contradicts the names."""
        s = np.concatenate([self.done, self.open[self._square(self.open)]])
        s = s[np.lexsort((s["period"], s["end"], s["start"]))]
        if len(s):  # a multiple of the smallest period has the same ends
            s = s[np.concatenate([[True], (s["start"][1:] != s["start"][:-1]) | (s["end"][1:] != s["end"][:-1])])]
        w = self.words
        for a, e, p in s.tolist():
            if not np.array_equal(w[a : e - p], w[a + p : e]):
                return None
        return s[np.lexsort((s["period"], s["start"]))]


def runs_of(words: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Runs of words given as numbers: start, end, period, by start, then period."""
    for seed in range(100):
        c = Catchers(least, seed)
        c.append(words)
        if (found := c.runs()) is not None:
            return found
    raise RuntimeError("window names clash again and again")


def collapsed(n: int, found: np.ndarray) -> np.ndarray:
    """Which of n words stay: those in no run, or among the first period of all runs that hold them."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, found["start"] + found["period"], 1)
    np.add.at(d, found["end"], -1)
    return np.cumsum(d[:-1]) == 0


def periodised(words: list, doc_id: int | None) -> list:
    """The contract's change of documents whose crc32 of the decimal id is a multiple of ten; a null id changes nothing."""
    n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def _digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _report(group: list[tuple[int | None, list[bytes]]]) -> Iterator[tuple]:
    """Rows of documents that are appended as one stream; a word's number holds its document's, so nothing repeats across them."""
    numbers: dict[bytes, int] = {}
    at = np.cumsum([0, *(len(words) for _, words in group)])
    stream = np.fromiter((numbers.setdefault(w, len(numbers)) for _, words in group for w in words), np.uint64, at[-1])
    stream |= np.repeat(np.arange(len(group), dtype=np.uint64), np.diff(at)) << np.uint64(32)
    found = runs_of(stream)
    cuts = np.searchsorted(found["start"], at)
    for k, (doc_id, words) in enumerate(group):
        s = found[cuts[k] : cuts[k + 1]].copy()
        s["start"] -= at[k]
        s["end"] -= at[k]
        best = [None] * 4
        if len(s):
            length = s["end"] - s["start"]
            i = int(np.lexsort((s["period"], s["start"], -length))[0])
            best = [int(s["start"][i]), int(length[i]), int(s["period"][i]), int(1000 * length[i] // s["period"][i])]
            keep = collapsed(len(words), s)
            words = [w for w, stays in zip(words, keep.tolist()) if stays]
        lines = "".join(f"{a},{e - a},{p}\n" for a, e, p in s.tolist())
        yield doc_id, len(s), *best, _digest(lines.encode()), _digest(b" ".join(words))


def report(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", change=periodised) -> DataFrame:
    """For each row of ``docs`` its runs: number, the longest, digests of all runs and of the words left when each run is collapsed to
    its first period. ``change`` (words, id) is applied to the words first.

    Rows stay where they are read, and a task appends about ``TOGETHER`` words at once; there is no shuffle.
    """
    names = re.findall(r"(\w+) (?:long|string)", SCHEMA)

    def tasks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, size = [], 0
        for batch in batches:
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (t.as_py() or "").encode().split()  # of bytes: splits at ASCII white space alone
                group.append((i, change(words, i)))
                size += len(words)
                if size >= TOGETHER or len(group) >= 4096:
                    rows += _report(group)
                    group, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n.endswith("256") else pa.int64()) for n, c in zip(names, zip(*rows))], names)
        if group:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n.endswith("256") else pa.int64()) for n, c in zip(names, zip(*_report(group)))], names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(tasks, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Places whose next 6 words agree give the periods to try (a run of period q has max(6, q) places that agree with the one q words on);
#: stretches of agreeing places are islands. crc32 is folded from bytes with a table made by its rule (reflected 0x04C11DB7).
ORACLE = r"""
WITH RECURSIVE bits AS (SELECT range AS v, range AS c, 0 AS i FROM range(256) UNION ALL
  SELECT v, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i + 1 FROM bits WHERE i < 8),
tab AS (SELECT list(c ORDER BY v) AS t FROM bits WHERE i = 8),
crc AS (SELECT doc_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
   lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS h FROM (SELECT DISTINCT doc_id FROM documents), tab),
src AS (SELECT d.doc_id, h // 10 AS g, h % 10 AS hm, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda s: s <> '') AS ws FROM documents d JOIN crc USING (doc_id)),
cut AS (SELECT *, len(ws) AS n, CASE WHEN len(ws) > 0 THEN g % len(ws) END AS a FROM src),
per AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM cut),
doc AS (SELECT doc_id, n, CASE WHEN hm = 0 AND n > 0 THEN list_transform(range(n), lambda i: ws[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE ws END AS ws FROM per),
w AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(ws) AS word FROM doc),
six AS (SELECT *, hash(word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o, lead(word, 5) OVER o) AS h6 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
hit AS (SELECT x.doc_id, x.n, x.i, y.i - x.i AS q FROM six x JOIN six y ON x.doc_id = y.doc_id AND x.h6 = y.h6 AND y.i > x.i AND x.i <= x.n - 6 AND y.i <= x.n - 6),
isle AS (SELECT doc_id, q, min(i) AS s, max(i) + 6 + q AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM hit) GROUP BY doc_id, q, k),
run AS (SELECT doc_id, s, e, min(q) AS q FROM isle WHERE e - s >= greatest(12, 2 * q) GROUP BY doc_id, s, e),
top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY e - s DESC, s, q) AS r, count(*) OVER (PARTITION BY doc_id) AS m FROM run),
lin AS (SELECT doc_id, sha256(string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' ORDER BY s, q)) AS hash FROM run GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, e)) AS i FROM run),
kept AS (SELECT doc_id, sha256(string_agg(word, ' ' ORDER BY i)) AS hash FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(t.m, 0) AS n_runs, t.s AS "start", t.e - t.s AS "length", t.q AS "period", 1000 * (t.e - t.s) // t.q AS exponent_milli,
  coalesce(l.hash, sha256('')) AS runs_sha256, coalesce(k.hash, sha256('')) AS collapsed_sha256
FROM doc d LEFT JOIN top t ON t.doc_id = d.doc_id AND t.r = 1 LEFT JOIN lin l ON l.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
