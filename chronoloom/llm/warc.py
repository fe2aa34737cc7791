"""WARC archives: a writer that stores equal payloads once, and a splittable reader.

Writing. Every page becomes one gzip member holding one WARC record. Of the pages with equal
payloads of ``MIN_REVISIT`` bytes or more, the one with the largest page_id is a response, and the
others are revisits of it, without payload. Spark's text writer stores the members: its commit
protocol makes retried tasks harmless on every file system. It ends each row with a separator, for
which the zero byte serves: the last byte of a gzip member is the top byte of its length, zero below
16 MiB, and a longer member is followed by an empty one. So the files are plain .warc.gz data.

Reading. Files are listed by Spark and cut into byte ranges. A task scans its range for the gzip
magic. A candidate counts only if it inflates to a record header with the required fields, which
rejects magic bytes inside compressed data (but not a whole record that a payload holds and that the
outer member stores uncompressed across the start of a range). A task owns the records that start inside its range and
reads past its end to finish the last; after a record it goes on at the end of its member.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm.common import scratch_path, write_table

#: Payload bytes from which equal payloads are stored once.
MIN_REVISIT = 1000
#: Bytes of a range that one reading task owns.
SPLIT_BYTES = 8 << 20
#: Reading tasks at most; beyond that a task takes several ranges.
MAX_TASKS = 50_000
#: Bytes of a range that are held at a time, those read at a time past them, and those inflated at a time.
WINDOW, CHUNK, PIECE = 1 << 20, 1 << 16, 1 << 14
#: A header longer than this is none.
MAX_HEADER = 1 << 16

_MAGIC = b"\x1f\x8b\x08"
_EMPTY_MEMBER = zlib.compressobj(6, zlib.DEFLATED, 31).flush()
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_REQUIRED = ("warc-type", "warc-record-id", "content-length", "warc-date")
#: Pages have no fetch time, and a WARC-Date is required.
DEFAULT_DATE = "2000-01-01T00:00:00Z"


def _record_id(page_id: int | None, url: str | None, digest: str) -> str:
    """A record id that tells the page; equal rows get equal ids."""
    return f"<urn:page:{'' if page_id is None else page_id}:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>"


def _page_of(record_id: str | None) -> int | None:
    found = re.match(r"<urn:page:(-?\d+)[:>]", record_id or "")
    return int(found[1]) if found else None


def _clean(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head.encode()) + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, winner: int | None, date: str = DEFAULT_DATE) -> bytes:
    """The gzip member of one page; a revisit if ``winner``, the response's page_id, is another page."""
    sha1 = hashlib.sha1(payload)
    revisit = winner is not None and winner != page_id
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id(page_id, url, sha1.hexdigest())),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(sha1.digest()).decode()),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if url is not None:
        headers.append(("WARC-Target-URI", _clean(url)))
    if revisit:
        headers += [("WARC-Profile", _REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{winner}>")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _member(headers, http if revisit else http + payload)


def _record_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.UUID(int=0)}>"), ("WARC-Date", DEFAULT_DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
    for batch in batches:
        members = [first] if first else []
        first = b""
        for page_id, url, payload, winner in zip(*[batch.column(i) for i in range(4)]):
            members.append(page_record(page_id.as_py(), url.as_py(), payload.as_py() or b"", winner.as_py()))
        members = [m if m[-1:] == b"\0" else m + _EMPTY_MEMBER for m in members]
        yield pa.RecordBatch.from_arrays([pa.array([m[:-1] for m in members], pa.binary())], names=["member"])


def write_warc(pages: DataFrame, path: str) -> None:
    """Writes a record for each row of ``pages`` (page_id, url, html) below ``path``.

    A null html is an empty payload. A null page_id is the least; if all pages of a payload have
    none, all are responses. Repeated rows of the largest page_id are all responses. Other columns
    are not looked at. An empty table gives an archive without page records.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("payload")).withColumn("digest", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= MIN_REVISIT).groupBy("digest").agg(F.max("page_id").alias("winner"), F.count(F.lit(1)).alias("n"))
    # A table of its own, so that the join's two sides are plain exchanges and a hot payload can be split.
    shared = write_table(large.where("n > 1").select("digest", "winner"), "shared-payloads")
    decided = rows.join(shared, "digest", "left").select("page_id", "url", "payload", "winner")
    members = decided.mapInArrow(_record_batches, "member binary")
    # The cast takes the bytes as they are.
    members.select(F.col("member").cast("string")).write.option("lineSep", "\0").text(path)


def _parse(head: bytes) -> dict[str, str] | None:
    """The fields of a WARC header, or None if it is none."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not re.fullmatch(r"WARC/[0-9]+\.[0-9]+", lines[0]):
        return None
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    return fields if all(x in fields for x in _REQUIRED) and fields["content-length"].isdigit() else None


def _pieces(source, window: bytes, base: int, at: int) -> Iterator[bytes]:
    """The bytes of ``source`` from ``at`` on: first those that ``window`` holds, which begins at byte ``base``."""
    for here in range(at - base, len(window), PIECE):
        yield window[here : here + PIECE]
    source.seek(base + len(window))
    while chunk := source.read(CHUNK):
        yield chunk


def _inflate(pieces: Iterator[bytes], at: int) -> tuple[dict[str, str], bytes, int] | None:
    """(fields, block, end) of the member at byte ``at``, where ``pieces`` begin, or None if no record's header decodes there."""
    unpack, out, fields, start = zlib.decompressobj(31), bytearray(), None, 0
    used = 0
    while not unpack.eof:
        chunk = next(pieces, b"")
        if not chunk:
            if fields is None:
                return None
            raise ValueError(f"the record at byte {at} is cut off")
        used += len(chunk)
        try:
            out += unpack.decompress(chunk)
        except zlib.error:
            if fields is None:
                return None
            raise
        if fields is None:
            if not (out.startswith(b"WARC/") or b"WARC/".startswith(bytes(out[:5]))):
                return None
            start = out.find(b"\r\n\r\n", 0, MAX_HEADER)
            if start >= 0:
                fields = _parse(bytes(out[:start]))
                if fields is None:
                    return None
            elif len(out) > MAX_HEADER:
                return None
    if fields is None:
        return None
    block = bytes(out[start + 4 : start + 4 + int(fields["content-length"])])
    return fields, block, at + used - len(unpack.unused_data)


def scan_range(source, start: int, stop: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, fields, block) of the records that start in bytes [start, stop) of a seekable file.

    The range is read once, a window at a time, however many records it holds.
    """
    at, base, window = start, start, b""
    while at < stop:
        if at - base + len(_MAGIC) > len(window):
            source.seek(at)
            base, window = at, source.read(min(WINDOW, stop - at) + len(_MAGIC) - 1)
            if len(window) < len(_MAGIC):
                return
        found = window.find(_MAGIC, at - base)
        if found < 0:
            at = base + len(window) - len(_MAGIC) + 1
            continue
        at = base + found
        if at >= stop:
            return
        record = _inflate(_pieces(source, window, base, at), at)
        if record is None:
            at += 1
            continue
        fields, block, end = record
        yield at, fields, block
        at = end


def _open(path: str):
    from pyarrow import fs

    uri = re.sub(r"^file:/+", "file:///", path)
    system, inner = fs.FileSystem.from_uri(uri)
    return system.open_input_file(inner)


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "digest", "payload"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    for batch in batches:
        for path, start, stop in zip(*[batch.column(i).to_pylist() for i in range(3)]):
            rows, held = [], 0
            with _open(path) as source:
                for _, fields, block in scan_range(source, start, stop):
                    if fields["warc-type"] not in ("response", "revisit"):
                        continue
                    head, _, payload = block.partition(b"\r\n\r\n")
                    length = re.search(rb"(?im)^content-length:\s*(\d+)", head)
                    revisit = fields["warc-type"] == "revisit"
                    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                    stated = base64.b32decode(digest).hex() if digest else None
                    own = stated if revisit else hashlib.sha1(payload).hexdigest()
                    if stated and own != stated:
                        raise ValueError(f"{path}: the payload of {fields['warc-record-id']} does not match its digest")
                    rows.append((_page_of(fields["warc-record-id"]), fields.get("warc-target-uri"), fields["warc-type"], _page_of(fields.get("warc-refers-to")), int(length[1]) if revisit and length else len(payload), own, None if revisit else payload))
                    held += len(payload)
                    if held > SPLIT_BYTES or len(rows) >= 4096:
                        yield packed(rows)
                        rows, held = [], 0
            if rows:
                yield packed(rows)


def read_warc(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, digest, payload) of every page record below ``path``.

    digest is the payload's SHA-1 in hex, checked against the header for responses; payload is null
    and payload_bytes the full length for revisits. Archives may be anywhere pyarrow can open.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")  # lists, reads no content
    split = F.lit(split_bytes).cast("long")
    count = F.greatest(F.ceil(F.col("length") / split), F.lit(1)).cast("int")
    ranges = files.where("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0), count - 1)).alias("i")).select("path", (F.col("i") * split).alias("start"), F.least((F.col("i") + 1) * split, F.col("length")).alias("stop"))
    # A number that adaptive execution leaves alone: rows this small would all be put in one task.
    tasks = max(1, min(ranges.count(), MAX_TASKS))
    return ranges.repartition(tasks).mapInArrow(_read_batches, "page_id long, url string, record_type string, refers_to long, payload_bytes long, digest string, payload binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """What ``read_warc`` finds after ``write_warc`` wrote ``pages`` to the shared folder."""
    path = scratch_path(pages.sparkSession, "warc")
    write_warc(pages, path)
    return read_warc(pages.sparkSession, path)


def oracle(table: str = "pages") -> str:
    """DuckDB SQL for the registered query."""
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM {table}),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
w AS (SELECT *, CASE WHEN payload_bytes >= {MIN_REVISIT} THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS winner FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN winner <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN winner <> page_id THEN winner END AS refers_to
FROM w"""
