"""WARC writing, and reading that salvages what it can.

The writer makes one gzip member per record.  Rows with equal payloads keep one
``response`` record, that of the smallest id; the others become ``revisit`` records
without payload that name it.

The reader checks every record: gzip checksum, version line, header syntax, declared
length, record end, block and payload digests.  After a failed check it searches for the
next place where a gzip member or a version line begins a record that passes, goes on
from there, and reports the bytes between as a quarantined gap.

Defined results: null payloads are empty; null urls have no target header; a null id
is written as ``none`` and read back as null, and never counts as the smallest unless
all ids of a payload are null (then each is a response).  Rows that repeat the smallest
id are all responses.  An empty table gives no archive and no records; other columns, whatever
their names, are not read.  A payload, and an archive when it is read, is held whole by one
task: archives of more than 2 GB must be cut before they are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import make_dir, scratch, streamed

#: Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP_MAGIC = b"\x1f\x8b\x08"
_VERSION_LINE = re.compile(rb"WARC/\d+\.\d+\r\n")
_DATE = "1970-01-01T00:00:00Z"
#: A new file begins after so many compressed bytes, so that a reader's task stays small.
FILE_BYTES = 16 << 20
#: Bytes given to the decompressor at once; what it leaves is copied.
_READ = 1 << 14

RECORDS = "path string, offset long, length long, kind string, headers map<string,string>, payload binary, reason string"
_RECORDS = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("kind", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("reason", pa.string())])


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def _block(headers: list[tuple[str, str]], body: bytes) -> bytes:
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in headers)
    return VERSION + b"\r\n" + head + f"Content-Length: {len(body)}\r\n".encode() + b"\r\n" + body + b"\r\n\r\n"


def record(record_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One uncompressed response record, or a revisit record if ``refers_to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'none' if record_id is None else record_id}>"), ("WARC-Date", _DATE)]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%-._~")))
    headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Block-Digest", f"sha1:{digest(body)}"), ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    if refers_to is not None:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("X-Payload-Length", str(len(payload)))]
    return _block(headers, body)


def with_first_of_payload(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int = 0) -> DataFrame:
    """Add ``refers_to``: the smallest id with the same payload, if it is another row's.

    Only one digest and id per row is aggregated, partly before the shuffle; a payload
    that a third of the rows share is one row of the join's small side.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    keyed = pages.withColumn("_sha", F.when(F.octet_length(payload) >= min_bytes, F.sha2(payload, 256)))
    shared = keyed.where("_sha IS NOT NULL").groupBy("_sha").agg(F.min(id_col).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("_sha").alias("_shared"), "_first")
    joined = keyed.join(shared, keyed["_sha"] == shared["_shared"], "left")
    return joined.withColumn("refers_to", F.when(F.col(id_col).isNull() | (F.col(id_col) != F.col("_first")), F.col("_first"))).drop("_sha", "_shared", "_first")


def write(pages: DataFrame, directory: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", file_bytes: int = FILE_BYTES) -> int:
    """Write ``refers_to``-annotated rows as ``*.warc.gz`` files under ``directory``; return the number of records.

    Each task writes to a name of its own attempt and then moves the file to its final
    name, so that an attempt which is lost or repeated leaves nothing half written.
    """
    make_dir(pages.sparkSession, directory)
    rows = pages.select(F.col(id_col).cast("long").alias("i"), F.col(url_col).cast("string").alias("u"), F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("p"), F.col("refers_to").cast("long").alias("r")).sortWithinPartitions("i", "u", "p")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(directory)
        fs.create_dir(root, recursive=True)
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        state = {"out": None, "size": 0, "seq": 0, "n": 0}
        own = f"{root}/attempt-{part:06d}-{attempt}.tmp"

        def close() -> None:
            if state["out"] is None:
                return
            state["out"].close()
            final = f"{root}/part-{part:06d}-{state['seq']:04d}.warc.gz"
            try:
                fs.move(own, final)
            except OSError:
                fs.delete_file(final)
                fs.move(own, final)
            state.update(out=None, size=0, seq=state["seq"] + 1)

        for batch in batches:
            for i, u, p, r in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if state["out"] is None:
                    state["out"] = fs.open_output_stream(own, compression=None)
                data = gzip.compress(record(i, u, p, r), 1, mtime=0)
                state["out"].write(data)
                state["n"] += 1
                state["size"] += len(data)
                if state["size"] >= file_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([state["n"]], pa.int64())], ["n"])

    return int(rows.mapInArrow(streamed(run), "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])


@dataclass
class Found:
    """A record, or a gap if ``kind`` is ``gap``."""

    offset: int
    length: int
    kind: str
    headers: dict[str, str] = field(default_factory=dict)
    payload: bytes | None = None
    reason: str | None = None


class BadRecord(ValueError):
    """What is wrong with a record or gzip member; ``found`` are intact records of a damaged member."""

    def __init__(self, why: str, found: Sequence[Found] = ()):
        super().__init__(why)
        self.found = found


def _checked(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """The headers and block of the record at ``at`` and where it ends."""
    if not _VERSION_LINE.match(data, at):
        raise BadRecord("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise BadRecord("headers do not end")
    headers: dict[str, str] = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise BadRecord("malformed header")
        headers[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    size = headers.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        raise BadRecord("no content length")
    body = data[end + 4 : end + 4 + int(size)]
    stop = end + 4 + int(size)
    if len(body) < int(size) or data[stop : stop + 4] != b"\r\n\r\n":
        raise BadRecord("length does not reach a record end")
    if (want := headers.get("warc-block-digest", "")).startswith("sha1:") and want[5:] != digest(body):
        raise BadRecord("block digest differs")
    return headers, body, stop + 4


def _payload(headers: dict[str, str], body: bytes) -> bytes | None:
    if headers.get("warc-type") == "revisit":
        return None
    payload = body
    if headers.get("content-type", "").startswith("application/http"):
        _, blank, payload = body.partition(b"\r\n\r\n")
        if not blank:
            raise BadRecord("HTTP headers do not end")
    if (want := headers.get("warc-payload-digest", "")).startswith("sha1:") and want[5:] != digest(payload):
        raise BadRecord("payload digest differs")
    return payload


def _member(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """The content of the gzip member at ``at``, where it ends, and what is wrong with it if it is only a part."""
    engine, out = zlib.decompressobj(31), []
    while not engine.eof:
        if at >= len(data):
            return b"".join(out), at, "gzip member is cut off"
        before = engine.copy()
        try:
            out.append(engine.decompress(data[at : at + _READ]))
        except zlib.error as e:
            for k in range(at, at + _READ):  # what comes before the damage, byte by byte
                try:
                    out.append(before.decompress(data[k : k + 1]))
                except zlib.error:
                    break
            return b"".join(out), at, f"gzip: {e}"
        at += _READ
    return b"".join(out), min(at, len(data)) - len(engine.unused_data), None


def _records_at(data: bytes, at: int) -> tuple[list[Found], int]:
    """The records of the gzip member at ``at``, or the plain record there."""
    if not data.startswith(GZIP_MAGIC, at):
        headers, body, end = _checked(data, at)
        return [Found(at, end - at, "record", headers, _payload(headers, body))], end
    inner, end, wrong = _member(data, at)
    found = [Found(at, end - at, x.kind, x.headers, x.payload, x.reason) for x in salvage(inner)] if _VERSION_LINE.search(inner) else []
    if wrong:
        raise BadRecord(wrong, [x for x in found if x.kind == "record"])
    if not any(x.kind == "record" for x in found):
        raise BadRecord("the member holds no record")
    return found, end


class _Starts:
    """Where the next gzip member or version line begins.  Each of the two searches goes over the data once."""

    def __init__(self, data: bytes):
        self.data, self.member, self.line = data, -1, -1

    def after(self, at: int) -> int:
        data = self.data
        if self.member < at:
            found = data.find(GZIP_MAGIC, at)
            self.member = found if found >= 0 else len(data)
        if self.line < at:
            match = _VERSION_LINE.search(data, at)
            self.line = match.start() if match else len(data)
        return min(self.member, self.line)


def salvage(data: bytes) -> Iterator[Found]:
    """All records of an archive in order, and the gaps between those that pass the checks."""
    at, gap, why, starts = 0, None, "", _Starts(data)
    while at < len(data):
        try:
            found, end = _records_at(data, at)
        except BadRecord as e:
            if e.found:
                if gap is not None:
                    yield Found(gap, at - gap, "gap", reason=why)
                    gap = None
                yield from e.found
            if gap is None:
                gap, why = at, str(e)
            at = starts.after(at + 1)
            continue
        if gap is not None:
            yield Found(gap, at - gap, "gap", reason=why)
            gap = None
        yield from found
        at = end
    if gap is not None:
        yield Found(gap, len(data) - gap, "gap", reason=why)


def read(spark: SparkSession, directory: str, pattern: str = "*.warc*") -> DataFrame:
    """Records and gaps of all archives below a folder, one row each (``kind``)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(directory).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, size = [], 0
                for x in salvage(content.as_py()):
                    rows.append((path.as_py(), x.offset, x.length, x.kind, list(x.headers.items()), x.payload, x.reason))
                    size += len(x.payload or b"")
                    if size > 4 << 20 or len(rows) >= 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _RECORDS.types, strict=True)], schema=_RECORDS)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _RECORDS.types, strict=True)], schema=_RECORDS)

    return files.mapInArrow(streamed(run), RECORDS)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write pages as archives in a new shared folder and read them back."""
    spark = pages.sparkSession
    directory = scratch(spark, "warc")
    annotated = with_first_of_payload(pages.select("page_id", "url", "html"), "page_id", "html", min_bytes)
    write(annotated, directory)
    return read(spark, directory, "*.warc.gz")


def page_digests(records: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    page = lambda name: F.expr(f"try_cast(regexp_extract(headers['{name}'], '^<urn:page:(-?[0-9]+)>$', 1) AS bigint)")
    return records.where("kind = 'record'").select(
        page("warc-record-id").alias("page_id"),
        F.coalesce(F.expr("try_cast(headers['x-payload-length'] AS bigint)"), F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.substring(F.expr("headers['warc-payload-digest']"), 6, 32).alias("payload_digest"),
        F.expr("headers['warc-type']").alias("record_type"),
        page("warc-refers-to").alias("refers_to"),
    )
