"""WARC archives (operator 12): a writer that deduplicates payloads, and a salvage reader.

Writing: each page becomes a record in the WARC 1.1 format, an HTTP response whose payload is
the page.  Of equal payloads the one of least page_id is stored; the others become revisit
records of the profile identical-payload-digest, with the HTTP header but no payload.  Records
are gzip members of their own (or plain), and a warcinfo record opens each archive.  Spark's
text writer puts the bytes into the given folder, so a lost executor leaves no half archive.
It ends each line by a separator; the separator here is the last byte of every record, a
newline, or of a member the zero byte that ends the length of all members below 16 MiB (a
larger one is followed by an empty member).  Archives are cut by a hash of the rows into parts
of about ARCHIVE_BYTES at most.

Reading: members and plain records are told by their first bytes and checked: the gzip sum,
the version line, the mandatory fields, the length and the closing blank lines, and both
SHA-1 digests.  After a check fails, the reader searches for the next place where a valid
member or version line starts, goes on there, and reports what lies between as a gap (file,
first byte, end, reason).  So damage costs the records that it touches and no others.  A
record that stands whole inside the payload of a damaged one is taken for a record.

Edge cases: a null text is an empty payload; payloads of any length are compared, empty ones
too.  Rows that share page_id and payload are one response and its revisits.  A row without
page_id counts as the last of its payload.  Null URLs are left out of the header, and control
characters are percent-encoded there.  An empty table writes one archive without pages; extra columns are not looked
at.  The reader takes each archive whole, as Spark's binaryFile does: below 2 GB.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import MOST_HOT, drop, save, shared_dir, ship, table

#: Payload bytes of an archive, about.
ARCHIVE_BYTES = 32 << 20

_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_VERSION = re.compile(rb"WARC/\d+\.\d+\r\n")
_START = re.compile(rb"\x1f\x8b\x08[\x00-\x1f]|WARC/\d+\.\d+\r\n")
_MANDATORY = (b"warc-record-id", b"content-length", b"warc-date", b"warc-type")
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
_ID = re.compile(r"urn:page:(-?\d*):")


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _info(date: str) -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    return _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], block)


def _page(url: str | None, payload: bytes, own: str, first: str | None, date: str) -> bytes:
    """A page as a response, or as a revisit of the record `first`."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first else http + payload
    fields = [("WARC-Type", "revisit" if first else "response"), ("WARC-Record-ID", f"<{own}>"), ("WARC-Date", date), ("Content-Type", "application/http; msgtype=response")]
    fields += [("WARC-Target-URI", _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url))] if url else []
    fields += [("WARC-Payload-Digest", f"sha1:{_sha1(payload)}"), ("WARC-Block-Digest", f"sha1:{_sha1(block)}")]
    fields += [("WARC-Profile", _REVISIT), ("WARC-Refers-To", f"<{first}>")] if first else []
    return _record(fields, block)


def _line(record: bytes, gzipped: bool) -> bytes:
    """A record as a line of the text writer, that is without the byte that the writer puts at each end."""
    if not gzipped:
        return record[:-1]
    member = zlib.compress(record, 6, wbits=31)
    if member[-1]:
        member += zlib.compress(b"", 6, wbits=31)
    return member[:-1]


def _writer(gzipped: bool, date: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch([pa.array([_line(_info(date), gzipped)], pa.binary())], ["line"])
        for batch in batches:
            for k in range(batch.num_rows):  # one at a time: pages may be long
                url, payload, own, first = (batch.column(c)[k].as_py() for c in ("url", "payload", "own", "first"))
                yield pa.record_batch([pa.array([_line(_page(url, payload, own, first, date), gzipped)], pa.binary())], ["line"])

    return run


def write_archives(pages: DataFrame, path: str, gzipped: bool = True, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write page_id, url and html as archives into a folder that all executors reach."""
    ship(pages.sparkSession)
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    # the writer's rows and the choice of the first ones must see the same numbers of rows
    rows = save(pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", payload.alias("payload"), F.sha2(payload, 256).alias("key"), F.monotonically_increasing_id().alias("row")), "pages", "zstd")
    own = F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(":"), F.col("row").cast("string"))
    size = rows.agg(F.count("*").alias("rows"), F.sum(F.octet_length("payload")).alias("bytes")).first()
    least = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row", own.alias("own"))).alias("least")
    groups = save(rows.groupBy("key").agg(least, F.count("*").alias("n")).where("n > 1").select("key", "n", F.col("least.own").alias("first")), "payloads")
    # payloads that many pages share are few: their rows stay where they are; payloads are moved once, to their archive
    is_hot = F.col("n") * MOST_HOT > size.rows
    marked = rows.select("row", "key", own.alias("own")).join(F.broadcast(groups.where(is_hot).select("key", F.col("first").alias("hot"))), "key", "left")
    rest = marked.where("hot is null").join(groups.where(~is_hot).select("key", "first"), "key")
    firsts = marked.where("hot is not null").withColumn("first", F.col("hot")).unionByName(rest, allowMissingColumns=True).where(F.col("first") != F.col("own")).select("row", "first")
    # not fewer than Spark joins by, or it would move the payloads again
    parts = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(size.bytes or 0) // archive_bytes))
    whole = rows.select("url", "payload", own.alias("own"), "row").repartition(parts, "row").join(firsts.repartition(parts, "row").hint("shuffle_hash"), "row", "left")
    lines = whole.select("url", "payload", "own", "first").mapInArrow(_writer(gzipped, date), "line binary")
    lines.select(F.col("line").cast("string")).write.option("lineSep", "\0" if gzipped else "\n").mode("append").text(path)
    drop(groups)
    drop(rows)


class Invalid(ValueError):
    """A check that failed."""


def _head(data: bytes, at: int) -> tuple[dict[bytes, bytes], int]:
    """The fields of the record that starts at a place, in lower case, and where its block starts."""
    version = _VERSION.match(data, at)
    if not version:
        raise Invalid("no version line")
    end = data.find(b"\r\n\r\n", version.end() - 2)
    if end < 0:
        raise Invalid("no end of the header")
    fields = {}
    for line in data[version.end() : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise Invalid("a header line without a colon")
        fields[name.strip().lower()] = value.strip()
    if lost := [m.decode() for m in _MANDATORY if m not in fields]:
        raise Invalid(f"no {lost[0]}")
    if not re.fullmatch(rb"\d{1,18}", fields[b"content-length"]):
        raise Invalid("content-length is no number")
    return fields, end + 4


def _checked(data: bytes, at: int) -> tuple[dict, int]:
    """The record that starts at a place, and where it ends."""
    fields, start = _head(data, at)
    end = start + int(fields[b"content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise Invalid("the block does not end where content-length says")
    block = data[start:end]
    text = lambda name: fields[name].decode("utf-8", "replace") if name in fields else None
    kind, said = text(b"warc-type"), text(b"warc-block-digest")
    if said and said.startswith("sha1:") and said[5:] != _sha1(block):
        raise Invalid("the block has another digest")
    head, _, payload = block.partition(b"\r\n\r\n") if (text(b"content-type") or "").startswith("application/http") else (b"", b"", block)
    length = re.search(rb"(?im)^content-length:\s*(\d{1,18})\s*$", head)
    digest = (text(b"warc-payload-digest") or "").removeprefix("sha1:") or None
    if kind != "revisit" and digest and digest != _sha1(payload):
        raise Invalid("the payload has another digest")
    size = int(length[1]) if kind == "revisit" and length else len(payload)
    trim = lambda x: x and x.strip("<>")
    return {"type": kind, "record_id": trim(text(b"warc-record-id")), "refers_to_id": trim(text(b"warc-refers-to")), "url": text(b"warc-target-uri"), "digest": digest or _sha1(payload), "payload_bytes": size, "payload": None if kind == "revisit" else payload}, end + 4


def _member(data: bytes, at: int) -> tuple[list[dict], int]:
    """The records of the member or the plain record that starts at a place, and where it ends."""
    if not data.startswith(b"\x1f\x8b", at):
        record, end = _checked(data, at)
        return [record], end
    inflate = zlib.decompressobj(wbits=31)
    parts, end = [], at
    try:
        while not inflate.eof:  # piece by piece: what follows the member is not copied
            piece = data[end : end + (1 << 16)]
            if not piece:
                raise Invalid("the member is cut off")
            parts.append(inflate.decompress(piece))
            end += len(piece)
    except zlib.error as e:
        raise Invalid(f"gzip: {e}") from None
    raw, records, inner = b"".join(parts), [], 0
    while inner < len(raw):
        record, inner = _checked(raw, inner)
        records.append(record)
    return records, end - len(inflate.unused_data)


def salvage(data: bytes) -> Iterator[tuple[int, int, dict | str]]:
    """Start, end and either a record or, for a gap, why the check at its start failed."""
    at, gap, why = 0, None, ""
    while at < len(data):
        try:
            records, end = _member(data, at)
        except Invalid as e:
            if gap is None:
                gap, why = at, str(e)
            found = _START.search(data, at + 1)
            at = found.start() if found else len(data)
            continue
        if gap is not None:
            yield gap, at, why
            gap = None
        for record in records:
            yield at, end, record
        at = end
    if gap is not None:
        yield gap, len(data), why


_READ = "file string, start bigint, end bigint, gap string, type string, record_id string, refers_to_id string, url string, digest string, payload_bytes bigint, payload binary"
_COLUMNS = [c.split()[0] for c in _READ.split(", ")]


def _reader(with_payload: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([(c, {"bigint": pa.int64(), "binary": pa.binary()}.get(kind, pa.string())) for c, kind in (x.split() for x in _READ.split(", "))])

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{c: r.get(c) for c in _COLUMNS} for r in rows], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for k in range(files.num_rows):
                file, rows, size = files.column("path")[k].as_py(), [], 0
                for start, end, got in salvage(files.column("content")[k].as_py()):
                    row = {"file": file, "start": start, "end": end} | ({"gap": got} if isinstance(got, str) else got)
                    if not with_payload:
                        row["payload"] = None
                    rows.append(row)
                    size += 200 + len(row.get("payload") or b"")
                    if size > 1 << 20:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """file, start, end, gap, type, record_id, refers_to_id, url, digest, payload_bytes, payload: a row for each record, and for each gap one whose `gap` says why.

    A revisit has the digest and the length of the payload that it stands for, and no payload.
    """
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_reader(with_payload), _READ)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back from the archives."""
    path = f"{shared_dir(spark)}/quillspark/archives-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    page = lambda c: F.nullif(F.regexp_extract(c, _ID.pattern, 1), F.lit("")).cast("bigint")
    records = read_archives(spark, path, with_payload=False).where("type in ('response', 'revisit')")
    out = save(records.select(page("record_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), page("refers_to_id").alias("refers_to")), "records")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
    return out


OP12_SQL = """
with p as (select page_id, coalesce(html, '') as html, row_number() over (order by page_id) as row from pages),
d as (
  select page_id, octet_length(encode(html)) as payload_bytes, upper(sha1(html)) as hex,
    row_number() over (partition by html order by page_id nulls last, row) as nth, first_value(page_id) over (partition by html order by page_id nulls last, row) as first
  from p),
b as (
  select *, list_transform(range(32), lambda k: cast(floor(
      cast('0x' || substr(hex, cast(5 * (k // 4) + 1 as bigint), 5) as integer) / pow(32, 3 - k % 4)) as integer) % 32) as fives
  from d)
select page_id, payload_bytes, array_to_string(list_transform(fives, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(v + 1 as bigint), 1)), '') as payload_digest,
  case when nth = 1 then 'response' else 'revisit' end as record_type, case when nth > 1 then first end as refers_to
from b
"""
