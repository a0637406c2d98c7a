"""Operator 13, WARC archives in Zstandard: a dictionary in the leading skippable frame, one frame for each record.

Reading: an archive starts with a skippable frame (magic 0x184D2A5D) that holds a dictionary, itself compressed or not, or with
its first record if it has none. Then every frame is one record, found by walking block headers and decoded by itself; empty skippable
frames between records are allowed. Checked for each record: the frame's declared size, the version line, the fields a record must
have, Content-Length against the bytes there are, the closing line ends, and the digests of block and payload. A record
that fails is a row with ``problem``; :func:`pages` raises an error for it, as nothing may be lost silently.

Writing: an archive is what one task writes, cut at about ``ARCHIVE_BYTES``. Spark's own text writer stores the frames, so any
file system of Spark's will do and a task that is tried again leaves one result; its line separator is an empty skippable frame. Archives are
read by Spark's reader of binary files.

Of records with equal payloads of at least 100 bytes the one with the smallest page_id is a response and the others are revisits
of it. Null payloads are empty; payloads below 100 bytes are responses always. Null page ids come last and stay null; rows
that share the smallest id of a payload are responses all of them, and so is a group without ids. Repeated rows give a record each. An empty
table gives no records. Columns besides page_id, url and html play no part.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import urllib.parse
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_folder
from .common import materialise

#: Fixed values of the formats: magic numbers of the dictionary's frame, of frames to skip, of a frame and of a dictionary.
DICTIONARY_FRAME, SKIPPABLE, FRAME, DICTIONARY = 0x184D2A5D, range(0x184D2A50, 0x184D2A60), 0xFD2FB528, 0xEC30A437
#: An empty frame to skip, as text: Spark's text writer puts it behind every record.
SEPARATOR = struct.pack("<II", 0x184D2A50, 0).decode("ascii")
#: Fixed value of the contract: payloads from this size on may be revisits.
LEAST_REVISIT = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Archives end after so many compressed bytes.
ARCHIVE_BYTES = 16 << 20
#: The dictionary is trained on so many pages, so many characters of each; most first pages that are broadcast.
SAMPLE, SAMPLE_CHARS, DICTIONARY_BYTES, BROADCAST_FIRST = 400, 16_384, 64 << 10, 2_000_000


def skippable(magic: int, data: bytes) -> bytes:
    return struct.pack("<II", magic, len(data)) + data


def train(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> bytes:
    """A dictionary from the start of about ``SAMPLE`` pages, chosen by hash; empty if they are too few or too short for one.

    Each page is in the sample with the same probability, so a task sends its share of the sample and nothing is sorted.
    """
    rate = SAMPLE / max(1, pages.count())
    own = F.pmod(F.xxhash64(F.lit("sample"), page_id, html), F.lit(1 << 30)) < int(rate * (1 << 30))
    rows = pages.where(own & (F.length(html) > 0)).select(F.substring(F.col(html), 1, SAMPLE_CHARS).alias("t")).limit(2 * SAMPLE).collect()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [r.t.encode() for r in rows]).as_bytes() if len(rows) > 10 else b""
    except zstandard.ZstdError:
        return b""


def _digest(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record; a revisit has the headers of the answer only, and names the page that it repeats."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = "" if page_id is None else str(page_id)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name} {url} {_digest(payload)}')}>"),
        ("WARC-Date", date), ("WARC-Target-URI", urllib.parse.quote(url or "", safe="%/:=&?~#+!$,;'@()*[]")), ("WARC-Page-ID", name),
        ("WARC-Payload-Digest", _digest(payload)), ("WARC-Block-Digest", _digest(block)),
    ]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To-Page-ID", str(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def decided(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, html and ``first``, the page that a row's payload repeats (null: none).

    Digests are counted with a combiner, so a hot payload costs one row for each task. Payloads that occur twice meet the rows by
    a broadcast of checked size; beyond it by a join with one row for each digest, whose other side Spark may split.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("html"), F.sha2(body.cast("binary"), 256).alias("dig"))
    long = F.octet_length("html") >= LEAST_REVISIT
    first = materialise(rows.where(long).groupBy("dig").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").drop("n"))
    if first.count() <= BROADCAST_FIRST:
        first = F.broadcast(first)
    out = rows.withColumn("dig", F.when(long, F.col("dig"))).join(first, "dig", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return out.select("page_id", "url", "html", F.when(again, F.col("first")).alias("first"))


def write(pages: DataFrame, path: str, dictionary: bytes, level: int = 3, size: int = ARCHIVE_BYTES) -> None:
    """Write :func:`decided` pages as archives under ``path``, each with the dictionary in front and an information record after it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if known:
            known.precompute_compress(level=level)
        packer = zstandard.ZstdCompressor(level=level, dict_data=known, write_checksum=True)
        small = zstandard.ZstdCompressor(level=19)
        info = b"software: chipmeter\r\nformat: WARC File Format 1.1\r\n"
        fields = f"WARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'warcinfo')}>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
        opening = (skippable(DICTIONARY_FRAME, small.compress(dictionary)) if dictionary else b"") + packer.compress(b"WARC/1.1\r\n" + fields.encode() + info + b"\r\n\r\n")
        archive, seq, have = 0, 0, 0
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                rows: list[tuple[int, int, bytes]] = []
                for r in batch.slice(k, 256).to_pylist():
                    if not seq:
                        rows.append((archive, 0, opening))
                        seq = 1
                    frame = packer.compress(record(r["page_id"], r["url"], r["html"].encode(), r["first"], r["first"] is not None))
                    rows.append((archive, seq, frame))
                    seq, have = seq + 1, have + len(frame)
                    if have >= size:
                        archive, seq, have = archive + 1, 0, 0
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary()))], ["archive", "seq", "frame"])

    frames = pages.mapInArrow(task, "archive int, seq long, frame binary").sortWithinPartitions("archive", "seq")
    # bytes pass through the text writer as they are: a cast of binary to string doesn't look at them
    frames.select("archive", F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR).partitionBy("archive").text(path)


def _frame_end(data: memoryview, at: int) -> int:
    """Where the frame that starts at ``at`` ends: headers of blocks tell their sizes."""
    head = bytes(data[at : at + 18])
    kind = zstandard.get_frame_parameters(head)
    pos = at + zstandard.frame_header_size(head)
    last = False
    while not last:
        if pos + 3 > len(data):
            raise ValueError("frame is cut off")
        word = int.from_bytes(data[pos : pos + 3], "little")
        last, form, size = word & 1, word >> 1 & 3, word >> 3
        if form == 3:
            raise ValueError("frame has a block of an unknown kind")
        pos += 3 + (1 if form == 1 else size)
    pos += 4 * kind.has_checksum
    if pos > len(data):
        raise ValueError("frame is cut off")
    return pos


def frames(data: bytes) -> Iterator[tuple[int, bytes | None, str | None]]:
    """Offset and content of each record of an archive, or what is wrong; what follows a broken frame can't be found."""
    view, at, unpacker = memoryview(data), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        start = at
        if at + 4 > len(view):
            yield start, None, "bytes after the last frame"
            return
        magic = struct.unpack_from("<I", view, at)[0]
        if magic in SKIPPABLE:
            size = struct.unpack_from("<I", view, at + 4)[0] if at + 8 <= len(view) else len(view)
            if at + 8 + size > len(view):
                yield start, None, "skippable frame is cut off"
                return
            body, at = bytes(view[at + 8 : at + 8 + size]), at + 8 + size
            if magic == DICTIONARY_FRAME and not start:
                try:
                    if body[:4] == struct.pack("<I", FRAME):
                        body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
                    if body[:4] != struct.pack("<I", DICTIONARY):
                        raise ValueError("no dictionary in the leading frame")
                    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
                except (zstandard.ZstdError, ValueError) as e:
                    yield start, None, f"dictionary: {e}"
                    return
            continue
        if magic != FRAME:
            yield start, None, "not a frame"
            return
        try:
            at = _frame_end(view, start)
        except (ValueError, zstandard.ZstdError) as e:
            yield start, None, str(e)
            return
        frame = bytes(view[start:at])
        try:
            size = zstandard.frame_content_size(frame)
            content = unpacker.decompress(frame) if size >= 0 else unpacker.decompressobj().decompress(frame)
            wrong = None if size in (-1, len(content)) else "frame has another size than it declares"
        except (zstandard.ZstdError, MemoryError) as e:
            content, wrong = None, f"frame: {e}"
        yield start, content, wrong


_FIELD = re.compile(rb"([!#$%&'*+.^_`|~0-9A-Za-z-]+):[ \t]*(.*?)[ \t]*\Z", re.S)


def _same(declared: str, data: bytes) -> bool:
    """Whether a digest field is that of the data, in hex or base 32; digests by other functions can't be compared and pass."""
    name, _, value = declared.partition(":")
    try:
        h = hashlib.new(name.lower(), data).digest()
    except (ValueError, TypeError):
        return True
    return value.lower() == h.hex() or value.upper().rstrip("=") == base64.b32encode(h).decode().rstrip("=")


def parse(content: bytes) -> tuple[dict[str, str], bytes, str | None]:
    """Fields (names in lower case), block and what is wrong with a record, if anything."""
    head, gap, rest = content.partition(b"\r\n\r\n")
    lines = re.sub(rb"\r\n[ \t]+", b" ", head).split(b"\r\n")
    if not gap or not re.fullmatch(rb"WARC/\d+\.\d+", lines[0]):
        return {}, b"", "no version line or no end of the header"
    fields: dict[str, str] = {}
    for line in lines[1:]:
        if not (m := _FIELD.match(line)):
            return fields, b"", f"header line {line[:40]!r}"
        fields[m[1].decode().lower()] = m[2].decode(errors="replace")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            return fields, b"", f"no field {name}"
    if not re.fullmatch(r"\d+", fields["content-length"]):
        return fields, b"", "content-length is no number"
    size = int(fields["content-length"])
    block, end = rest[:size], rest[size:]
    if len(block) < size or end != b"\r\n\r\n":
        return fields, block, "content-length differs from the block"
    if "warc-block-digest" in fields and not _same(fields["warc-block-digest"], block):
        return fields, block, "block digest"
    return fields, block, None


RECORDS = "archive string, at long, type string, page_id long, uri string, payload_bytes long, payload_digest string, refers_to long, problem string"


def _row(archive: str, at: int, content: bytes | None, wrong: str | None) -> tuple:
    fields, block = {}, b""
    if content is not None and wrong is None:
        fields, block, wrong = parse(content)
    kind = fields.get("warc-type")
    payload = digest = None
    number = lambda name: int(fields[name]) if re.fullmatch(r"-?\d+", fields.get(name, "")) else None
    if wrong is None and kind in ("response", "revisit"):
        _, gap, body = block.partition(b"\r\n\r\n")
        stated = fields.get("warc-payload-digest", "")
        if not gap or not block.startswith(b"HTTP/"):
            wrong = "no head of an answer"
        elif kind == "response":
            payload, digest = len(body), hashlib.sha256(body).hexdigest()
            if stated and not _same(stated, body):
                wrong = "payload digest"
        elif not re.fullmatch("sha256:[0-9a-f]{64}", stated) or number("warc-refers-to-page-id") is None:
            wrong = "revisit without a digest or the page it repeats"
        else:
            digest = stated.removeprefix("sha256:")
    return archive, at, kind, number("warc-page-id"), fields.get("warc-target-uri"), payload, digest, number("warc-refers-to-page-id"), wrong


def read(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """Every record of the archives under ``path`` with its place, type, ids, payload and ``problem`` (null if it is right).

    A task holds one archive; archives are as large as their writer made them.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    names = re.findall(r"(\w+) (?:long|string)", RECORDS)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1)):
                rows = [_row(name.as_py(), *x) for x in frames(data.as_py())]
                for k in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 10_000]), kinds)], names)

    return files.mapInArrow(task, RECORDS)


def pages(records: DataFrame) -> DataFrame:
    """One row for each response and revisit, revisits with the payload of what they repeat; an error if a record has a problem.

    A response that is repeated by a third of all rows is one row of its side of the join, and Spark may split the other side.
    """
    bad = F.raise_error(F.concat_ws(" ", F.col("archive"), F.col("at").cast("string"), "problem"))
    checked = records.withColumn("type", F.when(F.col("problem").isNull(), F.col("type")).otherwise(bad.cast("string")))
    out = materialise(checked.where(F.col("type").isin("response", "revisit")).select("page_id", "type", "payload_bytes", "payload_digest", "refers_to"))
    shown = lambda df, size: df.select("page_id", size.alias("payload_bytes"), "payload_digest", F.col("type").alias("record_type"), "refers_to")
    again = out.where("type = 'revisit'")
    wanted = again.select(F.col("refers_to").alias("p"), F.col("payload_digest").alias("d")).distinct()
    full = out.where("type = 'response'").groupBy(F.col("page_id").alias("p"), F.col("payload_digest").alias("d")).agg(F.max("payload_bytes").alias("size")).join(wanted, ["p", "d"], "left_semi")
    lost = F.raise_error(F.concat_ws(" ", F.lit("no response for the revisit of page"), F.col("refers_to").cast("string"))).cast("long")
    told = again.join(full, (again.refers_to == full.p) & (again.payload_digest == full.d), "left")
    return shown(out.where("type = 'response'"), F.col("payload_bytes")).unionByName(shown(told, F.coalesce("size", lost)))


def archived(table: DataFrame, path: str) -> DataFrame:
    """Write a table of pages (page_id, url, html) as archives under ``path`` and read it back as :func:`pages`."""
    write(decided(table), path, train(table))
    return pages(read(table.sparkSession, path))


def query(spark, sf_dir: str) -> DataFrame:
    return archived(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch_folder(spark, "archives"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS size FROM pages),
f AS (SELECT *, CASE WHEN size >= 100 THEN min(page_id) OVER (PARTITION BY html) ELSE page_id END AS first FROM p)
SELECT page_id, size AS payload_bytes, sha256(html) AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""

