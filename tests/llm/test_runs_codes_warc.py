"""Periodic runs, vector codes and archives: brute force, round trips, broken input and edge cases."""

import hashlib
import random
import struct

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from chipmeter.llm import runs, vector_codes, warc
from chipmeter.llm.common import materialise
from chipmeter.sources.scratch import scratch_folder


def brute_runs(words, least=12):
    out = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(2 * p, least):
                out.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((a, e, p) for (a, e), p in out.items())


def cases():
    rng = random.Random(5)
    yield from ([], [1], [1] * 70, [bin(i).count("1") % 2 for i in range(257)])
    a, b = [0], [0, 1]
    while len(b) < 300:
        a, b = b, b + a
    yield b
    for _ in range(120):
        w = [rng.randrange(rng.choice([1, 2, 3, 6, 60])) for _ in range(rng.randrange(1, 200))]
        a, p = rng.randrange(len(w)), rng.randrange(1, 40)
        yield w if rng.random() < 0.4 else w[:a] + [w[a + i % min(p, len(w) - a)] for i in range(len(w) - a)]


@pytest.mark.parametrize("least", [2, 12])
def test_runs_match_brute_force_in_any_portions(least):
    rng = random.Random(least)
    for w in cases():
        want = brute_runs(w, least)
        assert [tuple(x) for x in runs.runs_of(np.array(w, np.uint64), least).tolist()] == want
        c, i = runs.Catchers(least), 0
        while i < len(w):
            t = rng.choice([1, 1, 1, 3, 50])
            c.append(np.array(w[i : i + t], np.uint64))
            i += t
        assert [tuple(x) for x in c.runs().tolist()] == want


def test_run_report_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(f"w{rng.randrange(9)}" for _ in range(rng.randrange(150))), "x") for k in range(120)]
    rows += [(None, None, "y"), (200, "", "y"), (201, " \t\n", "y"), (202, "a " * 40_000, "y"), (203, "é b c d " * 20, "y"), (7, rows[7][1], "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    got = {(r.doc_id, r.runs_sha256, r.collapsed_sha256): r for r in runs.report(docs).collect()}
    assert len(got) == len(rows) - 1
    for i, text, _ in rows:
        w = runs.periodised((text or "").encode().split(), i)
        found = brute_runs(w) if len(w) < 1000 else [(0, len(w), 1)]
        gone = {k for a, e, p in found for k in range(a + p, e)}
        sha = lambda b: hashlib.sha256(b).hexdigest()
        r = got[i, sha("".join(f"{a},{e - a},{p}\n" for a, e, p in found).encode()), sha(b" ".join(x for k, x in enumerate(w) if k not in gone))]
        best = min(((a - e, a, p) for a, e, p in found), default=None)
        assert r.n_runs == len(found)
        assert (r.start, r.length, r.period) == ((best[1], -best[0], best[2]) if best else (None,) * 3)
        assert r.exponent_milli == (1000 * r.length // r.period if best else None)
    assert runs.report(docs.limit(0)).count() == 0


def brute_codes(vectors, books):
    parts = vectors.reshape(len(vectors), 16, -1)
    d = ((parts[:, :, None, :] - books[None]) ** 2).sum(3)
    return d.argmin(2), d.min(2)


def test_orchard_finds_the_lowest_nearest_entry():
    rng = np.random.default_rng(1)
    for k, spread in ((1, 3), (2, 2), (64, 3), (64, 40), (200, 1000)):  # a small spread makes ties and equal entries
        book, q = rng.integers(-spread, spread + 1, (k, 4)), rng.integers(-spread, spread + 1, (500, 4))
        best, dist = vector_codes.orchard(q, book, vector_codes.neighbour_lists(book), rng.integers(0, k, 500))
        full = ((q[:, None] - book[None]) ** 2).sum(2)
        assert (best == full.argmin(1)).all() and (dist == full.min(1)).all()


def test_vector_codes_edges(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.3, 32)], int(i) % 3, "c") for i in rng.permutation(150)]
    rows += [(200, None, 1, "c"), (201, [1.0, None] * 16, 1, "c"), (202, [float("nan")] * 32, 1, "c"), (203, [float("inf")] + [0.0] * 31, 1, "c")]
    rows += [(None, [0.5] * 32, None, "c"), (5, rows[0][1], None, "c"), (300, [1e30] * 32, 2, "c"), (301, [0.1] * 5, 2, "c")]
    t = materialise(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, code string"))
    got = vector_codes.compress(t).collect()
    assert len(got) == 154 and sum(r.vec_id is None for r in got) == 1
    good = [(i, v, lab) for i, v, lab, _ in rows if v and len(v) == 32 and all(x is not None and np.isfinite(x) for x in v)]
    good.append((301, [0.1] * 5 + [0.0] * 27, 2))
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.clip(np.floor(np.array([v for _, v, _ in good]) * 256), -(1 << 24), 1 << 24).astype(np.int64)
    books = x[:64].reshape(64, 16, 2).transpose(1, 0, 2).copy()
    for _ in range(2):
        code, _d = brute_codes(x, books)
        new = books.copy()
        for j in range(16):
            for e in range(64):
                own = x.reshape(len(x), 16, 2)[code[:, j] == e, j]
                if len(own):
                    new[j, e] = own.sum(0) // len(own)
        books = new
    code, dist = brute_codes(x, books)
    total = {}
    for (_, _, lab), d in zip(good, dist.sum(1)):
        total[lab] = total.get(lab, 0) + int(d)
    want = sorted((str(i), "".join(f"{c:02x}" for c in cs), int(d), total[lab], vector_codes.books_digest(books)) for (i, _, lab), cs, d in zip(good, code, dist.sum(1)))
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == want
    assert vector_codes.compress(t.limit(0)).count() == 0
    few = vector_codes.compress(t.where("vec_id < 3")).collect()
    assert len(few) == 3 and all(r.error == 0 for r in few)


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(8)
    body = lambda n: "<html>" + " ".join(f"wörd{rng.randrange(200)}" for _ in range(n)) + "</html>"
    same, long = body(60), body(60_000)
    rows = [(k, f"http://x.example/{k}?q=a b\r\nX: y", body(rng.randrange(5, 90)), "p") for k in range(150)]
    rows += [(k, None, same, "p") for k in (900, 70_000, 801, 802)] + [(None, "u", same, "p"), (901, "", None, "p"), (902, "u", "", "p"), (903, "u", "s" * 99, "p"), (904, "u", "s" * 99, "p")]
    rows += [(910, "u", "é" * 50, "p"), (911, "u", "é" * 50, "p"), (920, "u", long, "p"), (920, "u", long, "p"), (921, "u", "\r\n\r\n" * 40, "p"), (None, "u", "null only " * 20, "p"), (None, "u", "null only " * 20, "p")]
    return materialise(spark.createDataFrame(rows, "page_id long, url string, html string, dig string").repartition(3))


def wanted(rows):
    first = {}
    for r in rows:
        first.setdefault(r.html, []).append(r.page_id)
    for r in rows:
        data = (r.html or "").encode()
        ids = [i for i in first[r.html] if i is not None]
        f = min(ids) if ids and len(data) >= 100 else r.page_id
        yield (r.page_id, len(data), hashlib.sha256(data).hexdigest(), "response" if f == r.page_id else "revisit", None if f == r.page_id else f)


@pytest.mark.parametrize("size", [3000, 16 << 20])
def test_archives_round_trip(spark, pages, size):
    path = scratch_folder(spark, "archives")
    warc.write(warc.decided(pages), path, warc.train(pages), size=size)
    got = warc.pages(warc.read(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, wanted(pages.collect())))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path).collect()
    assert len(files) > 3 if size == 3000 else len(files) <= 3
    for f in files:  # each starts with its dictionary; a plain reader of frames finds records too
        data = bytes(f.content)
        magic, n = struct.unpack_from("<II", data)
        assert magic == warc.DICTIONARY_FRAME
        known = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + n]))
        text = zstandard.ZstdDecompressor(dict_data=known).decompressobj().decompress(data[8 + n :])
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")


def test_archives_without_dictionary_and_empty(spark, pages):
    few = pages.where("page_id in (1, 900, 801)")
    path = scratch_folder(spark, "archives")
    assert sorted(r.record_type for r in warc.archived(few, path).collect()) == ["response", "response", "revisit"]
    assert warc.archived(pages.limit(0), scratch_folder(spark, "archives")).count() == 0


def archive(records, dictionary=b"", **options):
    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    head = warc.skippable(warc.DICTIONARY_FRAME, dictionary) if dictionary else b""
    return head + b"".join(zstandard.ZstdCompressor(dict_data=known, **options).compress(r) for r in records)


def problems(data):
    return [warc._row("a", *x)[-1] for x in warc.frames(data)]


def test_reader_validates_frames_headers_and_lengths(spark, pages):
    good = warc.record(1, "http://a", b"x" * 200)
    dictionary = warc.train(pages)
    assert len(dictionary) > 1000 and problems(archive([good] * 3, dictionary)) == [None] * 3  # a dictionary that is not compressed
    assert problems(archive([good], write_content_size=False)) == [None]
    whole = archive([good, good], write_checksum=True)
    cut = problems(whole[:-7])
    assert cut[0] is None and cut[1] == "frame is cut off"
    assert problems(whole + b"xy")[-1] == "bytes after the last frame" and problems(b"WARC/1.1\r\n\r\n") == ["not a frame"]
    assert problems(warc.skippable(warc.DICTIONARY_FRAME, b"no dictionary"))[0].startswith("dictionary")
    assert problems(archive([good], dictionary)[8 + len(dictionary) :])[0].startswith("frame")  # its dictionary is missing
    bad = bytearray(whole)
    bad[-2] ^= 1
    assert problems(bytes(bad))[1].startswith("frame")
    for old, new, says in (
        (b"WARC/1.1", b"WARC/x", "version"), (b"Content-Length: 2", b"Content-Length: 3", "differs"), (b"Content-Length: 2", b"Content-Length: -2", "no number"), (b"WARC-Type: ", b"WARC-Kind: ", "no field"),
        (b"x\r\n\r\n", b"x\r\n\n", "differs"), (b"xxx\r\n", b"xxy\r\n", "block digest"), (b"WARC-Date", b"WARC Date", "header line"), (b"WARC-Type: response", b"WARC-Type: revisit", "revisit without"),
    ):
        at = (good.rindex if old.startswith(b"x") else good.index)(old)
        assert says in problems(archive([good[:at] + new + good[at + len(old) :]]))[0], (old, new)
    twin = warc.parse(good.replace(b"WARC-Date: ", b"WARC-Date:\r\n\t "))
    assert twin[2] is None and twin[0]["warc-date"] == "1970-01-01T00:00:00Z"


def test_pages_raise_for_broken_or_lost_records(spark):
    rows = lambda **x: spark.createDataFrame([("a", 0, x.get("type"), 5, "u", None, "d" * 64, 4, x.get("problem"))], warc.RECORDS)
    with pytest.raises(Exception, match="frame is cut off"):
        warc.pages(rows(problem="frame is cut off")).collect()
    with pytest.raises(Exception, match="no response"):
        warc.pages(rows(type="revisit")).collect()


def test_join_of_many_repeated_payloads(spark, pages, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_FIRST", 0)
    got = warc.decided(pages).select("page_id", F.col("first")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, f)) for i, _, _, _, f in wanted(pages.collect()))
