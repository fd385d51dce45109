"""WARC archives: a writer with revisit records and a salvage reader (operator 10).

Writing: every row becomes one record in a gzip member of its own. Of the records with equal payloads (of at
least ``min_payload`` bytes) the one with the smallest page_id is a response, the others are revisits that refer
to it and carry the response's HTTP header only, whose Content-Length still tells the payload's size.

Reading: a record counts only if its member inflates with a good checksum, its header parses, its block has the
announced length and both digests agree. After a failed check the reader searches for the next member that
inflates to a version line (in plain archives: the next version line), goes on from there, and logs the bytes
between as a quarantined gap with the reason.

Archives are read through a window, so that a task holds one record (its compressed and its plain bytes) at a time.

A null html is an empty payload. A null page_id never is the smallest; where all page_ids of a payload are
null, all its records are responses. Rows that repeat the smallest page_id with its payload are all responses.
A null or empty url gives a record without a target; control characters in a url are percent-encoded. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, texts

#: An archive is closed beyond this size.
ARCHIVE_BYTES = 64 << 20
_ID_SPACE = 0x7061676573 << 80  # marks our record ids; the low 64 bits hold the page_id
_NO_ID = 1 << 64
_VERSION = re.compile(rb"^WARC/1\.[01]\r\n", re.M)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_urn(page_id: int | None, nth: int = 0) -> str:
    value = _ID_SPACE | (_NO_ID | nth if page_id is None else page_id & (2**64 - 1))
    return f"<urn:uuid:{uuid.UUID(int=value)}>"


def page_of(urn: str) -> int | None:
    value = uuid.UUID(urn.strip()[len("<urn:uuid:") : -1]).int ^ _ID_SPACE
    if value & _NO_ID:
        return None
    return value - 2**64 if value >= 2**63 else value


def sha1_32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _safe(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, nth: int = 0, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One record as a gzip member; a revisit if ``refers_to`` is given."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_urn(page_id, nth)}", f"WARC-Date: {date}"]
    if url:
        head.append(f"WARC-Target-URI: {_safe(url)}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_urn(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{sha1_32(payload)}", f"WARC-Block-Digest: sha1:{sha1_32(block)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    data = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Damaged(ValueError):
    pass


#: Bytes read at once from an archive, inflated at once, and of the longest record header.
STEP, PART, HEADER = 1 << 20, 1 << 16, 1 << 20


class Archive:
    """Bytes of an archive at any place: of a file, or of an object in memory."""

    def __init__(self, source, size: int | None = None):
        self.source, self.size = source, len(source) if size is None else size
        self.at, self.held = 0, b""

    @classmethod
    def open(cls, uri: str) -> Archive:
        fs, path = store.filesystem(uri)
        file = fs.open_input_file(path)
        return cls(file, file.size())

    def read(self, at: int, n: int) -> bytes:
        if not hasattr(self.source, "read_at"):
            return bytes(self.source[at : at + n])
        n = max(0, min(n, self.size - at))
        if not self.at <= at <= at + n <= self.at + len(self.held):
            self.at, self.held = at, self.source.read_at(max(n, min(STEP, self.size - at)), at)
        return self.held[at - self.at : at - self.at + n]


def _parse(data: Archive, at: int = 0) -> tuple[dict, int]:
    """A checked record at ``at``, and where it ends."""
    top = data.read(at, 4096)
    if not _VERSION.match(top):
        raise Damaged("no version line")
    end = top.find(b"\r\n\r\n")
    if end < 0:
        top = data.read(at, HEADER)
        end = top.find(b"\r\n\r\n")
    if end < 0:
        raise Damaged("header without end")
    fields = {}
    for line in top[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise Damaged("header line without colon")
        fields[name.strip().lower()] = value.strip()
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit()) or len(length) > 18:
        raise Damaged("no content length")
    start = at + end + 4
    stop = start + int(length)
    if stop + 4 > data.size or data.read(stop, 4) != b"\r\n\r\n":
        raise Damaged("block of another length")
    block = data.read(start, int(length))
    kind = fields.get("warc-type", "")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{sha1_32(block)}":
        raise Damaged("block digest differs")
    record = {"type": kind, "id": fields.get("warc-record-id", ""), "uri": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to"), "digest": digest, "payload": None, "payload_bytes": None}
    head, blank, payload = block.partition(b"\r\n\r\n")
    if kind == "response":
        if not blank:
            raise Damaged("no HTTP header")
        if digest and digest != sha1_32(payload):
            raise Damaged("payload digest differs")
        record |= {"payload": payload, "payload_bytes": len(payload)}
    elif kind == "revisit":
        told = re.search(rb"(?mi)^content-length:\s*(\d+)", head)
        record["payload_bytes"] = int(told[1]) if told else None
    return record, stop + 4


def _member(data: Archive, at: int) -> tuple[bytes, int]:
    """The inflated gzip member at ``at`` and where it ends."""
    opener = zlib.decompressobj(31)
    out, step = [], at
    try:
        while not opener.eof:
            part = data.read(step, PART)
            if not part:
                raise Damaged("truncated member")
            out.append(opener.decompress(part))
            step += len(part)
    except zlib.error as e:
        raise Damaged(f"member does not inflate: {e}") from None
    return b"".join(out), step - len(opener.unused_data)


def _begins(data: Archive, at: int) -> bool:
    """Whether a gzip member with a version line may begin here."""
    try:
        return zlib.decompressobj(31).decompress(data.read(at, 4096), 16).startswith(b"WARC/1.")
    except zlib.error:
        return False


def salvage(source) -> Iterator[tuple[str, object, int, int]]:
    """("record", record, start, end) and ("gap", reason, start, end) over a whole archive (or its bytes), in order."""
    data = source if isinstance(source, Archive) else Archive(source)
    at, size = 0, data.size
    gap, why = None, ""
    while at < size:
        try:
            if data.read(at, 3) == b"\x1f\x8b\x08":
                inner, end = _member(data, at)
                record, used = _parse(Archive(inner))
                if used != len(inner):
                    raise Damaged("bytes behind the record")
            else:
                if not _VERSION.match(data.read(at, 16)):
                    raise Damaged("neither a member nor a version line")
                record, end = _parse(data, at)
        except Damaged as e:
            if gap is None:
                gap, why = at, str(e)
            at = _next_start(data, at + 1)
            continue
        if gap is not None:
            yield "gap", why, gap, at
            gap = None
        yield "record", record, at, end
        at = end
    if gap is not None:
        yield "gap", why, gap, size


def _next_start(data: Archive, at: int) -> int:
    """The next place where a member or a plain record may begin: both marks are looked for window by window."""
    while at < data.size:
        part = data.read(at, STEP)
        for mark in re.finditer(rb"\x1f\x8b\x08|WARC/1\.", part):
            place = at + mark.start()
            if mark[0][:1] == b"W":
                if place and data.read(place - 1, 1) == b"\n" or not place:
                    return place
            elif _begins(data, place):
                return place
        at += max(1, len(part) - 6)
    return data.size


# --- Spark ----------------------------------------------------------------------------------------------------


#: Payloads that occur twice or more are broadcast up to this number (about 100 bytes each), and joined by a shuffle beyond.
BROADCAST_PAYLOADS = 200_000
#: Parts of the rows of one payload in that shuffle.
SALTS = 32


def with_roles(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """page_id, url, html and ``refers_to`` (null for responses)."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", "html", F.sha1(F.encode(payload, "UTF-8")).alias("digest"), (F.octet_length(payload) >= min_payload).alias("counts"))
    shared = rows.filter("counts").groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first_id is not null")
    shared = store.materialise(shared.select("digest", "first_id", F.lit(True).alias("counts")), "payloads")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    if shared.count() <= BROADCAST_PAYLOADS:
        joined = rows.join(F.broadcast(shared), ["digest", "counts"], "left")
    else:
        salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
        parts = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", salt).join(parts, ["digest", "counts", "salt"], "left")
    return joined.select("page_id", "url", "html", refers.alias("refers_to"))


def write_warc(pages: DataFrame, out_dir: str, min_payload: int = 0) -> list[str]:
    """Write the archives; gives their files (one or more for each task, so bounded by the tasks' bytes)."""
    store.make_dir(out_dir)
    texts.small_batches(pages.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, nth, out, names = TaskContext.get().partitionId(), 0, 0, None, []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if out is None:
                    names.append(f"{out_dir}/pages-{part:06d}-{k:04d}.warc.gz")
                    out, k = store.AtomicFile(names[-1]), k + 1
                page_id, url, html, refers = row
                out.write(encode_record(page_id, url, (html or "").encode(), refers, (part << 40) + nth))
                nth += 1
                if out.size >= ARCHIVE_BYTES:
                    out.commit()
                    out = None
        if out is not None:
            out.commit()
        if names:
            yield pa.RecordBatch.from_pydict({"file": names})

    return [r["file"] for r in with_roles(pages, min_payload).mapInArrow(write, "file string").collect()]


RECORD_SCHEMA = "file string, start long, stop long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, uri string, gap string"


def read_warc(spark, files: list[str]) -> DataFrame:
    """Every record of the archives, and a row with ``gap`` (the reason) for every quarantined byte range."""
    if not files:
        return spark.createDataFrame([], RECORD_SCHEMA)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("uri", pa.string()), ("gap", pa.string())])
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                for kind, what, start, stop in salvage(Archive.open(name)):
                    if kind == "gap":
                        rows.append({"file": name, "start": start, "stop": stop, "gap": what})
                    else:
                        refers = what["refers_to"]
                        rows.append({"file": name, "start": start, "stop": stop, "page_id": _page(what["id"]), "payload_bytes": what["payload_bytes"], "payload_digest": what["digest"], "record_type": what["type"], "refers_to": _page(refers) if refers else None, "uri": what["uri"]})
                    if len(rows) >= 4096:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    listed = spark.sparkContext.parallelize([(f,) for f in files], len(files)).toDF("file string")
    return listed.mapInArrow(read, RECORD_SCHEMA)


def _page(urn: str) -> int | None:
    try:
        return page_of(urn)
    except ValueError:  # an archive of other origin
        return None
