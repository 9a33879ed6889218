"""WARC archives: a writer of one gzip member per record, and a reader that salvages what a damaged archive still holds.

Writer. Payloads of at least ``LEAST`` bytes that are equal are written once: the record of the smallest id is the response,
the others are revisits that refer to it and hold its digest and length in place of the payload. Digests are
grouped before the join, and what is joined to the payloads are the revisits alone. The archives are written by Spark's own
file writer with its committer, so a task that runs again leaves no half file: a member ends with a zero byte (a
record whose last byte isn't zero is followed by an empty member), and that byte is the writer's line separator.

Salvage reader. Records are read one after another and checked: the member's checksum, the version line, header lines, the
header's length, the two line ends behind the block, and a sha256 or sha1 digest of block or payload. After a failed check the reader searches on:

* in the archive, for the next member that inflates to a version line, or the next version line behind a line end;
* in the inflated bytes of a member, for the next version line behind a line end.

It goes on from there and logs the gap as quarantined. A member that is cut off keeps its whole records; of one whose checksum
fails, or that can't be inflated any further, records whose digest fits are returned as ``suspect`` (what their headers say isn't confirmed).
What is searched is what lies behind the last record that was read, so the work is linear in the archive's bytes.

An archive is read in pieces. Files up to ``WHOLE`` bytes are a row of Spark's, handed over in pieces; larger ones, of any size, come
from Spark's line reader by ranges, put in order by a shuffle of those files alone. That reader inflates files whose names end like
compressed ones (``.gz``), which would lose their damage: they are a row at any size, up to the 2 GB beyond which Spark raises an error. A worker holds a record, at most ``LONGEST`` bytes (a longer one, which
no value of Spark's could hold, is a gap; header lines of any length below that are read whole), and what waits for its member's checksum: beyond ``HELD`` bytes, records whose digest fits don't wait, and others are suspect.

Defined results: a null payload is empty, and such records are responses. Rows repeated with an id and payload are records of
their own: as equal payloads of one id they are responses all. A row without an id gets a record without one, and never is another's response.
An empty file gives no records and no gaps.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import itertools
import re
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, map_arrow, stored, table

#: Shortest payload that a revisit may refer to; records of an archive file; the level of compression.
LEAST, RECORDS, LEVEL = 100, 5_000, 6
VERSION = b"WARC/1.1\r\n"
#: Longest file that is one row, and its pieces; the most bytes that a value of Spark's holds, and so a record; bytes that wait for a checksum; bytes inflated at once.
WHOLE, PIECE, LONGEST, HELD, STEP = 128 << 20, 1 << 20, (1 << 31) - 1, 64 << 20, 1 << 14
_VERSION_LINE = re.compile(rb"WARC/[0-9]+\.[0-9]+\r?\n")
_MEMBER = b"\x1f\x8b\x08"
_MEMBER_OR_LINE, _LINE_START = re.compile(rb"\x1f\x8b\x08|\nWARC/"), re.compile(rb"\nWARC/")
_EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff") + b"\x03\x00" + b"\x00" * 8


def member(record: bytes) -> bytes:
    """A gzip member whose last byte is zero: where the size's highest byte isn't, an empty member follows."""
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    out = c.compress(record) + c.flush()
    return out if out[-1] == 0 else out + _EMPTY_MEMBER


def record_bytes(id_: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    head = [b"WARC-Type: " + (b"response" if refers_to is None else b"revisit")]
    if id_ is not None:
        head.append(b"WARC-Record-ID: <urn:page:%d>" % id_)
    if url is not None:
        head.append(b"WARC-Target-URI: " + re.sub(rb"[\r\n]", b" ", url.encode("utf-8", "replace")))
    head += [b"WARC-Date: 1970-01-01T00:00:00Z", b"WARC-Payload-Digest: sha256:" + digest.encode(), b"WARC-Payload-Length: %d" % len(payload)]
    if refers_to is not None:
        head += [b"WARC-Refers-To: <urn:page:%d>" % refers_to, b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    head += [b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload)]
    return VERSION + b"\r\n".join(head) + b"\r\n\r\n" + payload + b"\r\n\r\n"


def write_archives(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """One record per row, in gzip members, in files of RECORDS records at most."""
    url = F.col(url_col).cast("string") if url_col in df.columns else F.lit(None).cast("string")
    rows = df.select(F.col(id_col).cast("long").alias("id"), url.alias("url"), F.coalesce(F.encode(F.col(payload_col).cast("string"), "utf-8"), F.lit(b"")).alias("payload"))
    digests = rows.filter((F.octet_length("payload") >= LEAST) & F.col("id").isNotNull()).select("id", F.unhex(F.sha2("payload", 256)).alias("h"))
    groups = digests.groupBy("h").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    revisits = digests.join(groups, "h").filter("id <> first").select(F.col("id").alias("i"), F.col("h").alias("g"), "first").distinct()
    revisits = stored(revisits, "revisits")  # its size is known then: payloads are shuffled only if it is too large to send about
    same = (rows["id"] == revisits["i"]) & (F.unhex(F.sha2("payload", 256)) == revisits["g"])
    whole = rows.join(revisits, same, "left").select("id", "url", "payload", F.col("first").alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for id_, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out.append(member(record_bytes(id_, url, payload, refers_to, hashlib.sha256(payload).hexdigest()))[:-1])
                size += len(out[-1])
                if size > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    members = map_arrow(whole, run, "value binary").select(F.col("value").cast("string").alias("value"))  # the bytes as they are
    members.write.option("lineSep", "\0").option("maxRecordsPerFile", RECORDS).text(path)


class Found(NamedTuple):
    """A record, a suspect or a gap: its place in the archive and, in a member, in the member's inflated bytes; sha256 of the block where it is known."""

    kind: str
    start: int
    stop: int
    inner_start: int | None
    inner_stop: int | None
    sha256: str | None
    headers: dict[str, str]
    block: bytes


class _Source:
    """Bytes that come in pieces, held from where they may still be needed. Places are counted from the beginning."""

    def __init__(self, pieces: Iterable[bytes]):
        self.pieces, self.held, self.base, self.ended = iter(pieces), bytearray(), 0, False

    def has(self, stop: int) -> bool:
        while not self.ended and self.base + len(self.held) < stop:
            piece = next(self.pieces, None)
            if piece is None:
                self.ended = True
            else:
                self.held += piece
        return self.base + len(self.held) >= stop

    def get(self, at: int, stop: int) -> bytes:
        """Those bytes, fewer at the end."""
        self.has(stop)
        return bytes(self.held[at - self.base : stop - self.base])

    def line(self, at: int) -> bytes | None:
        """The line at a place with its end, however long it is; None if it has none."""
        seen, size = at, 256
        while True:
            self.has(seen + size)
            end = self.held.find(b"\n", seen - self.base)
            if end >= 0:
                return bytes(self.held[at - self.base : end + 1])
            if self.base + len(self.held) < seen + size:
                return None
            seen, size = self.base + len(self.held), PIECE

    def search(self, pattern: re.Pattern[bytes], at: int) -> int:
        """Where the pattern (of 6 bytes at most) is found next, or the end; what is passed is let go."""
        while True:
            m = pattern.search(self.held, at - self.base)
            if m:
                return self.base + m.start()
            size = self.base + len(self.held)
            at = max(at, size - 5)
            self.free(at)
            if not self.has(size + 1):
                return size

    def free(self, at: int) -> None:
        if at > self.base:
            del self.held[: at - self.base]
            self.base = at


def _header(src: _Source, at: int) -> tuple[dict[str, str], int] | None:
    """The headers of a record and where its block begins; None if a line isn't one of a header.

    Header lines are read whole. One that isn't of a header ends the search, as the next version line does: failures cost linear time.
    """
    first = _VERSION_LINE.match(src.get(at, at + 64))
    if first is None:
        return None
    out, begin, name = {}, at + first.end(), ""
    while begin - at <= LONGEST:
        line = src.line(begin)
        if line is None:
            return None
        begin += len(line)
        words = line.strip()
        if not words:
            return out, begin
        if line[:1] in b" \t" and name:  # goes on from the line before
            out[name] += " " + words.decode("utf-8", "replace")
            continue
        key, colon, value = words.partition(b":")
        if not colon:
            return None
        name = key.strip().decode("latin-1").lower()
        out[name] = value.strip().decode("utf-8", "replace")
    return None


def _fits(digest: str, data: bytes) -> tuple[bool | None, str | None]:
    """Whether a digest is the data's (None: of another kind), and the data's sha256 if that was made."""
    kind, _, value = digest.partition(":")
    if kind.lower() == "sha256":
        own = hashlib.sha256(data).hexdigest()
        return value.lower() == own or value.upper().rstrip("=") == base64.b32encode(bytes.fromhex(own)).decode().rstrip("="), own
    if kind.lower() == "sha1":
        raw = hashlib.sha1(data).digest()
        return value.upper() == base64.b32encode(raw).decode() or value.lower() == raw.hex(), None
    return None, None


def _record(src: _Source, at: int) -> tuple[dict[str, str], bytes, int, bool, str | None] | None:
    """Headers, block, end, whether a digest confirms it, and the block's sha256 if known; None if a check fails."""
    found = _header(src, at)
    if found is None:
        return None
    headers, begin = found
    length = headers.get("content-length", "")
    if not length.isascii() or not length.isdigit() or int(length) > LONGEST:
        return None
    stop = begin + int(length)
    if src.get(stop, stop + 4) != b"\r\n\r\n":
        return None
    block = src.get(begin, stop)
    checks = [_fits(headers["warc-block-digest"], block)] if "warc-block-digest" in headers else []
    payload = block
    if headers.get("content-type", "").lower().startswith("application/http"):  # the payload is what follows the transfer's own headers
        payload = block.partition(b"\r\n\r\n")[2]
    own = [c[1] for c in checks]
    if "warc-payload-digest" in headers and headers.get("warc-type") != "revisit":
        checks.append(_fits(headers["warc-payload-digest"], payload))
        own += [checks[-1][1]] if payload is block else []
    if any(ok is False for ok, _ in checks):
        return None
    return headers, block, stop + 4, any(ok for ok, _ in checks), next((d for d in own if d), None)


def _plain(src: _Source) -> Iterator[tuple[bool, Found]]:
    """Records and gaps of plain bytes (places as inner ones), each with whether a digest confirms it."""
    at, bad = 0, None
    while src.has(at + 1):
        got = _record(src, at)
        if got is None:
            bad = at if bad is None else bad
            at = src.search(_LINE_START, at) + 1
            continue
        if bad is not None:
            yield False, Found("gap", 0, 0, bad, at, None, {}, b"")
            bad = None
        headers, block, end, sure, own = got
        yield sure, Found("record", 0, 0, at, end, own, headers, block)
        at = end
        src.free(at)
    if bad is not None:
        yield False, Found("gap", 0, 0, bad, src.base + len(src.held), None, {}, b"")


class _Inflated:
    """A member's inflated bytes in pieces; afterwards its state (whole, cut or broken) and, if whole, its end."""

    def __init__(self, src: _Source, at: int):
        self.src, self.next, self.end, self.state = src, at, None, "cut"

    def __iter__(self) -> Iterator[bytes]:
        d = zlib.decompressobj(31)
        while self.src.has(self.next + 1):
            raw = self.src.get(self.next, self.next + STEP)
            self.next += len(raw)
            while True:
                before = d.copy()
                try:
                    out = d.decompress(raw, 1 << 20)
                except zlib.error:  # what comes out before the error is worth having: again, byte by byte
                    self.state = "broken"
                    with contextlib.suppress(zlib.error):
                        for k in range(len(raw)):
                            yield before.decompress(raw[k : k + 1])
                    return
                if out:
                    yield out
                if d.eof:
                    self.state, self.end = "whole", self.next - len(d.unused_data)
                    return
                raw = d.unconsumed_tail
                if not raw and len(out) < 1 << 20:
                    break


def _starts(raw: bytes) -> bool:
    """Whether a member begins with a version line, or is empty; only its first bytes are inflated."""
    d = zlib.decompressobj(31)
    try:
        out = d.decompress(raw, 16)
    except zlib.error:
        return False
    return out.startswith(b"WARC/") or (d.eof and not out)


def _next_start(src: _Source, at: int) -> int:
    """The next place from ``at`` on where a member or a version line begins, or the end."""
    while True:
        k = src.search(_MEMBER_OR_LINE, max(at - 1, src.base))
        if not src.has(k + 1):
            return k
        if src.get(k, k + 1) == b"\n":
            if k + 1 >= at:
                return k + 1
        elif k >= at and _starts(src.get(k, k + 4096)):
            return k
        at = max(at, k + 2)


def salvage(raw: bytes | Iterable[bytes]) -> Iterator[Found]:
    """Records, suspects and gaps of an archive, or of its pieces, in order."""
    src = _Source([raw] if isinstance(raw, bytes) else raw)
    at, bad = 0, None
    gap = lambda start, stop, inner=None: Found("gap", start, stop, inner, None, None, {}, b"")
    while src.has(at + 1):
        if src.get(at, at + 3) != _MEMBER:
            got = _record(src, at)
            if got is None:
                bad = at if bad is None else bad
                at = _next_start(src, at + 1)
                continue
            if bad is not None:
                yield gap(bad, at)
                bad = None
            headers, block, end, _, own = got
            yield Found("record", at, end, None, None, own, headers, block)
            at = end
            src.free(at)
            continue
        inflated = _Inflated(src, at)
        waiting: list[tuple[bool, Found]] = []
        held, early, safe, good = 0, False, at, 0
        for sure, f in _plain(_Source(inflated)):
            waiting.append((sure, f))
            held += len(f.block)
            if f.kind == "record":
                good = f.inner_stop
                safe = max(at, inflated.next - STEP) if sure else safe  # if it breaks, the next start is searched from here
            if held > HELD:
                if bad is not None:
                    yield gap(bad, at)
                    bad = None
                for known, w in waiting:
                    yield w._replace(kind=w.kind if known or w.kind == "gap" else "suspect", start=at, stop=inflated.next)
                waiting, held, early = [], 0, True
                src.free(safe)
        broken, whole = inflated.state == "broken", inflated.state == "whole"
        stop = inflated.end if whole else _next_start(src, max(safe, at + 1))
        if broken:
            waiting = [(sure, f) for sure, f in waiting if sure or f.kind == "gap"]
        if not whole:  # the end of what could be read is part of the gap that is logged last
            waiting = [(sure, f) for sure, f in waiting if f.kind == "record" or f.inner_stop <= good]
        if early or any(f.kind == "record" for _, f in waiting) or (whole and not waiting):
            if bad is not None:
                yield gap(bad, at)
                bad = None
            for _, f in waiting:
                yield f._replace(kind="suspect" if broken and f.kind == "record" else f.kind, start=at, stop=stop)
            if not whole:
                yield gap(at, stop, good)
        elif bad is None:
            bad = at
        at = stop
        src.free(at)
    if bad is not None:
        yield gap(bad, src.base + len(src.held))


def _page(value: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?[0-9]+)>", value or "")
    return int(found[1]) if found else None


_SCHEMA = "path string, kind string, start long, stop long, inner_start long, inner_stop long, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """path, size, line, piece: the bytes of each file in order, all of it in one partition. line: a line end follows each piece."""
    inflated = "(?i)[.](gz|bz2|deflate|zst|lz4|snappy)$"
    files = spark.read.format("binaryFile").load(path).filter((F.col("length") > 0) & ((F.col("length") <= WHOLE) | F.col("path").rlike(inflated)))
    files = files.withColumn("k", F.explode(F.sequence(F.lit(0), F.ceil(F.col("length") / PIECE).cast("int") - 1)))
    small = files.select("path", F.col("length").alias("size"), F.lit(False).alias("line"), F.expr(f"substring(content, k * {PIECE} + 1, {PIECE})").alias("piece"))
    place = ["path", "block", "nth"]
    lines = spark.read.option("lineSep", "\n").text(path).filter((F.col("_metadata.file_size") > WHOLE) & ~F.col("_metadata.file_path").rlike(inflated))
    lines = lines.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_size").alias("size"),
        F.lit(True).alias("line"),
        F.col("value").cast("binary").alias("piece"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("nth"),  # in order within a range
    )
    return small.union(lines.repartition("path").sortWithinPartitions(*place).drop("block", "nth"))


def _joined(rows: Iterator[tuple[str, int, bool, bytes]]) -> Iterator[bytes]:
    """A file's bytes: line ends are put back, but not behind the last line if the file has none there."""
    total, last = 0, None
    for _, size, line, piece in rows:
        if last is not None:
            yield last
        last = piece + b"\n" if line else piece
        total += len(last)
    if last is not None:
        yield last[: len(last) - max(0, total - size)]


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each record (kind record), each that its member's checksum doesn't confirm (suspect) and each quarantined gap (gap) of the archives under a path.

    start and stop are places in the file; inner_start and inner_stop those in a member's inflated bytes, for what lies in a member. Of a record
    in a member of several, stop is the member's end, or how far it was read by then.
    payload_bytes and payload_digest are the full payload's; of a revisit they are those of the record it refers to, as its header holds them.
    """
    names = [c.split()[0] for c in _SCHEMA.split(", ")]
    kinds = [pa.string(), pa.string(), *[pa.int64()] * 5, pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        flat = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        rows, size = [], 0
        for name, pieces in itertools.groupby(flat, lambda r: r[0]):
            for kind, *place, sha256, headers, block in salvage(_joined(pieces)):
                if kind == "gap":
                    rows.append((name, kind, *place, *[None] * 7))
                    continue
                revisit = headers.get("warc-type") == "revisit"
                known = headers.get("warc-payload-length", "")
                length = int(known) if revisit and known.isdigit() else len(block)
                digest = headers.get("warc-payload-digest", "").removeprefix("sha256:") if revisit else sha256 or hashlib.sha256(block).hexdigest()
                ids = _page(headers.get("warc-record-id")), headers.get("warc-target-uri"), headers.get("warc-type")
                rows.append((name, kind, *place, *ids, length, digest, _page(headers.get("warc-refers-to")), block if payloads else None))
                size += len(block) if payloads else 0
                if len(rows) >= 4096 or size > 1 << 24:
                    yield packed(rows)
                    rows, size = [], 0
        if rows:
            yield packed(rows)

    return map_arrow(_pieces(spark, path), run, _SCHEMA)


def op1_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "archives")
    write_archives(table(spark, sf_dir, "pages"), path)
    found = read_archives(spark, path, payloads=False).filter("kind = 'record'")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op1_warc_salvage": op1_warc_salvage}
ORACLE = {
    "op1_warc_salvage": """
        WITH t AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
             g AS (SELECT payload_digest, min(page_id) AS first FROM t WHERE payload_bytes >= 100 GROUP BY payload_digest)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first < page_id THEN first END AS refers_to
        FROM t LEFT JOIN g USING (payload_digest)"""
}
