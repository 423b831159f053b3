"""WARC archives: writing with revisit records, and a salvage reader that goes on behind damaged bytes."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm.shared import discard, read_bytes, store, write_bytes

MIN_REVISIT_BYTES = 1000
DATE = "2000-01-01T00:00:00Z"
ID_PREFIX = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP = b"\x1f\x8b\x08"
VERSION = b"WARC/"
VERSION_LINE = re.compile(rb"WARC/\d\.\d\r?\n")
HEAD_END = re.compile(rb"\r?\n\r?\n")
END = b"\r\n\r\n"
RECORDS_PER_BATCH = 500
FEED = 1 << 14
CUT = "gzip: member without end"


def member(data: bytes, level: int = 6) -> bytes:
    """One gzip member without a time stamp."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


# an empty member between the records: readers see nothing of it
EMPTY_MEMBER = member(b"")


def sha1_label(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def record(page_id, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """A response record with the payload, or a revisit record that names the response instead."""
    digest = hashlib.sha1(payload).digest()
    block = payload if refers_to is None else b""
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<{ID_PREFIX}{'' if page_id is None else page_id}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": re.sub(r"[\r\n]+", " ", url) if url else None,
        "WARC-Payload-Digest": sha1_label(digest),
        "WARC-Block-Digest": sha1_label(hashlib.sha1(block).digest()),
        "WARC-Payload-Length": str(len(payload)),
        "WARC-Profile": PROFILE if refers_to is not None else None,
        "WARC-Refers-To": f"<{ID_PREFIX}{refers_to}>" if refers_to is not None else None,
        "Content-Type": "text/html; charset=utf-8",
        "Content-Length": str(len(block)),
    }
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return head.encode("utf-8") + b"\r\n" + block + END


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES, payload: str = "html", page_id: str = "page_id") -> DataFrame:
    """The pages with refers_to: the largest page_id with the same payload, null for that page and for short payloads.

    Only ids and digests are grouped and joined; a digest that many pages share is one row after the partial sums, and
    its pages are spread again by the join's own skew handling. Rows are told apart by id and digest, so a page_id that
    repeats with another payload is judged by that payload; rows with a null page_id are never revisits.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    marks = pages.select(F.col(page_id).alias("_id"), F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).alias("n"))
    marks = store(marks.filter(F.col("n") >= min_bytes).select("_id", "digest"), "payload-digests")
    first = marks.groupBy("digest").agg(F.max("_id").alias("refers_to"), F.count("*").alias("copies")).filter("copies > 1")
    revisits = store(marks.join(first, "digest").filter("_id <> refers_to").select("_id", "digest", "refers_to").distinct(), "revisits")
    discard(marks)
    kept = pages.drop("refers_to", "_id", "_digest").withColumn("_digest", F.sha1(body.cast("binary")))
    revisits = revisits.select("_id", F.col("digest").alias("_of"), "refers_to")
    return kept.join(revisits, (F.col(page_id) == F.col("_id")) & (F.col("_digest") == F.col("_of")), "left").drop("_id", "_of", "_digest")


def write_warc(pages: DataFrame, path: str, payload: str = "html", page_id: str = "page_id", url: str = "url", min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Write a record per page, each as a gzip member, one archive per partition. Null payloads are empty."""

    def run(batches):
        for batch in batches:
            found = []
            for p, u, body, refers in zip(*(batch.column(k) for k in range(4))):
                data = (body.as_py() or "").encode("utf-8")
                found.append(member(record(p.as_py(), u.as_py(), data, refers.as_py())))
                if len(found) == RECORDS_PER_BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["value"])
                    found = []
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["value"])

    rows = with_revisits(pages, min_bytes, payload, page_id).select(page_id, url, payload, "refers_to")
    write_bytes(rows.mapInArrow(run, "value binary"), path, EMPTY_MEMBER)


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(fields, block, bytes used) of the record at a place; ValueError says what is wrong with it."""
    first = VERSION_LINE.match(data, at)
    if not first:
        raise ValueError("no version line")
    head_end = HEAD_END.search(data, first.end() - 1)
    if not head_end:
        raise ValueError("header without end")
    fields: dict[str, str] = {}
    for line in data[first.end() : head_end.start()].decode("utf-8", "replace").splitlines():
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError("header line without colon")
        fields[name.strip().lower()] = value.strip()
    length = fields.get("content-length", "")
    if not length.isdigit():
        raise ValueError("no content length")
    stop = head_end.end() + int(length)
    block = data[head_end.end() : stop]
    if len(block) < int(length):
        raise ValueError("block too short")
    if data[stop : stop + 4] != END:
        raise ValueError("no record end")
    for name in ("warc-block-digest", *(("warc-payload-digest",) if fields.get("warc-type") == "response" and "http" not in fields.get("content-type", "") else ())):
        kind, _, digest = fields.get(name, "").partition(":")
        if kind == "sha1" and digest.upper() != base64.b32encode(hashlib.sha1(block).digest()).decode():
            raise ValueError(f"{name} differs")
    return fields, block, stop + 4 - at


def _member_at(content: bytes, at: int) -> tuple[bytes, int, str]:
    """(data, end, error) of the gzip member at a place; its checksum and length are tested.

    With an error the data are what came before it, and end is 0.
    """
    unpack, view, parts, fed = zlib.decompressobj(31), memoryview(content), [], at
    while not unpack.eof and fed < len(content):
        before = unpack.copy()
        try:
            parts.append(unpack.decompress(view[fed : fed + FEED]))
        except zlib.error as error:
            try:
                for k in range(fed, len(content)):
                    parts.append(before.decompress(view[k : k + 1]))
            except zlib.error:
                pass
            return b"".join(parts), 0, f"gzip: {error}"
        fed = min(len(content), fed + FEED)
    if not unpack.eof:
        return b"".join(parts), 0, CUT
    return b"".join(parts), fed - len(unpack.unused_data), ""


def _packed_place(content: bytes, at: int, length: int) -> int:
    """The place in the archive up to which the member at `at` has to be read for its first `length` bytes of data."""
    unpack, view, got, fed = zlib.decompressobj(31), memoryview(content), 0, at
    while True:
        before = unpack.copy()
        try:
            n = len(unpack.decompress(view[fed : fed + FEED]))
        except zlib.error:
            n = length
        if got + n >= length:
            break
        got, fed = got + n, fed + FEED
    while got < length:
        got, fed = got + len(before.decompress(view[fed : fed + 1])), fed + 1
    return fed


def _parts(data: bytes, proven: bool = False):
    """Yield ('record', start, stop, fields, block) and ('gap', start, stop, reason, None) through a member's data.

    After a failed check the next version line that leads to a valid record is searched. With `proven` a record must have
    a digest. Line ends between records are skipped.
    """
    at, gap, reason = 0, None, ""
    while at < len(data):
        if gap is None and data[at] in b"\r\n":
            at += 1
            continue
        try:
            fields, block, n = parse_record(data, at)
            if proven and not fields.get("warc-block-digest", "").lower().startswith("sha1:"):
                raise ValueError("no digest to prove it")
        except ValueError as error:
            if gap is None:
                gap, reason = at, str(error)
            following = data.find(VERSION, at + 1)
            at = following if following >= 0 else len(data)
            continue
        if gap is not None:
            yield "gap", gap, at, reason, None
            gap = None
        yield "record", at, at + n, fields, block
        at += n
    if gap is not None:
        yield "gap", gap, len(data), reason, None


def salvage(content: bytes):
    """Yield ('record', start, end, fields, block) and ('gap', start, end, reason, None) through a whole archive.

    At every place a gzip member or a plain record is tried. After a failed check the next member start or version line
    that leads to a valid record is searched, and the bytes between are one gap. Empty members and line ends between
    records are skipped. A member's data are searched in the same way, so that a failed record costs no other one; such a
    gap has the places of the member, and its reason names the bytes of the member's data. Of a member that is cut off or
    damaged, the records before that place are kept, the damaged one's if a digest proves their block, and the gap begins
    behind the last of them. Digests do not cover headers: where the checksum of a member differs and all its digests are
    right, an only record is dropped, and of several the gap behind them is the warning.
    """
    at, size, gap, reason = 0, len(content), None, ""
    while at < size:
        if gap is None and content[at : at + 1] in (b"\r", b"\n"):
            at += 1
            continue
        found, end, why = [], at, "neither a member nor a version line"
        if content.startswith(GZIP, at):
            data, end, why = _member_at(content, at)
            found = list(_parts(data, proven=why not in ("", CUT)))
            used = max((stop for kind, _, stop, _, _ in found if kind == "record"), default=0)
            if len(found) == 1 and "incorrect" in why:
                used = 0  # the checksum differs, not the digest: the header of the only record is wrong
            if why and used:
                end, why = _packed_place(content, at, used), f"{why}, behind byte {used} of the member's data"
                found = [x for x in found if x[1] < used]
            elif why:
                found, end = [], at
            elif gap is not None and data and not used:
                end = at  # a payload's own
            found = [(kind, a if kind == "record" else f"{a}, bytes {start} to {stop} of the member's data", b) for kind, start, stop, a, b in found]
        elif content.startswith(VERSION, at):
            try:
                fields, block, n = parse_record(content, at)
                found, end, why = [("record", fields, block)], at + n, ""
            except ValueError as error:
                why = str(error)
        if end > at:
            if gap is not None:
                yield "gap", gap, at, reason, None
                gap = None
            for kind, detail, block in found:
                yield kind, at, end, detail, block
            at = end
            if why:
                gap, reason = at, why
                at -= 1  # the search goes on at the gap's first byte
            else:
                continue
        if gap is None:
            gap, reason = at, why
        places = [p for p in (content.find(GZIP, at + 1), content.find(VERSION, at + 1)) if p >= 0]
        at = min(places, default=size)
    if gap is not None and gap < size:
        yield "gap", gap, size, reason, None


SCHEMA = (
    "path string, kind string, start long, end long, reason string, record_type string, record_id string, url string, "
    "refers_to string, payload_digest string, payload_bytes long, payload binary"
)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records and gaps of all archives below a path (each up to Spark's 2 GB for a binary file).

    kind is 'record' or 'gap'; start and end are places in the archive, the member's for compressed ones; a gap has the
    reason of its first failure, and one inside a member the bytes of the member's data. payload_digest is bare lower-case hex. The payload is null for gaps and revisits.
    """
    names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary()]

    def rows(content: bytes, name: str):
        for kind, start, end, detail, block in salvage(content):
            if kind == "gap":
                yield (name, kind, start, end, detail, *[None] * 7)
                continue
            digest = detail.get("warc-payload-digest", "").partition(":")[2]
            hexa = base64.b32decode(digest).hex() if re.fullmatch("[A-Z2-7]{32}", digest) else None
            revisit = detail.get("warc-type") == "revisit"
            length = detail.get("warc-payload-length", "")
            yield (
                name, kind, start, end, None, detail.get("warc-type"), detail.get("warc-record-id", "").strip("<>"), detail.get("warc-target-uri"),
                detail.get("warc-refers-to", "").strip("<>") or None, hexa,
                len(block) if not revisit else int(length) if length.isdigit() else None, None if revisit or not payload else block,
            )

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                held = []
                for row in rows(content.as_py(), name.as_py()):
                    held.append(row)
                    if len(held) == RECORDS_PER_BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)

    return read_bytes(spark, path).mapInArrow(run, SCHEMA)


def records(found: DataFrame) -> DataFrame:
    return found.filter("kind = 'record'").drop("kind", "reason")


def gaps(found: DataFrame) -> DataFrame:
    """The log of quarantined bytes."""
    return found.filter("kind = 'gap'").select("path", "start", "end", "reason")


def page_number(record_id: Column) -> Column:
    """page_id inside a record id; null where it had none."""
    digits = F.regexp_replace(record_id, f"^{ID_PREFIX}", "")
    return F.when(F.length(digits) > 0, digits).cast("long")
