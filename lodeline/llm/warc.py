"""WARC writing, revisit resolution and reading.

``archive`` writes one response record per row into gzip archives (a member per
record, a file per task, a warcinfo record first) and returns their index: where
each record lies, its date, its payload's digest and length. ``resolve`` shuffles these headers - never the
payloads - by digest, names the record with the smallest id as the original and
joins the others to it. ``rewrite`` copies each archive into a deduplicated one
with fresh headers and record ids: originals keep their payload, the others become
revisit records that name its copy, with its URL and date. Dates of records stay
those of their capture; a warcinfo record has that of the writing. ``read`` parses
archives back.

How it scales. Payloads move only from file to file within the task that owns
the file. A hot digest is pre-aggregated before its shuffle; the originals are
written to a table first, so the join back deals both sides anew and adaptive
execution splits the hot digest. Files appear under their names only when whole
and are the same on a second attempt.

Edge cases: a null payload is empty; payloads shorter than ``min_bytes`` are never
deduplicated; rows without an id come after all others as originals and are
never named; rows without a date have that of the writing, which the driver
fixes once, so a second attempt writes the same bytes; repeated rows with one id are one original and revisits of that
id; a null URL has no target line, control characters in URLs are escaped; very long payloads are
held whole, one at a time in the task that writes or reads them; an empty
table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import drop, new_dir, open_fs, parts, table

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
LEVEL = 4
#: Bytes read at a time, and rows sent on at a time.
READ, ROWS = 1 << 20, 1000


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(fields: dict[str, object], block: bytes) -> bytes:
    """One record as a gzip member; fields that are None are left out."""
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in fields.items() if v is not None), b"Content-Length: %d" % len(block)]
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress(b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of an unpacked record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if version != VERSION:
        raise ValueError("not a WARC record")
    fields = {k: v for k, _, v in (line.decode().partition(": ") for line in lines)}
    return fields, rest[: int(fields["Content-Length"])]


def _uri(url: str | None) -> str | None:
    return None if url is None else "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def now() -> str:
    """This second, as records write it."""
    return datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def _info(kind: str, name: str, dated: str) -> bytes:
    """The record that opens an archive."""
    fields = {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:x-{kind}:info:{name}>", "WARC-Date": dated, "WARC-Filename": name, "Content-Type": "application/warc-fields"}
    return record(fields, b"software: lodeline\r\nformat: WARC File Format 1.1\r\n")


class _Archive:
    def __init__(self, uri: str, info: bytes):
        self.fs, self.path = open_fs(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.private, self.size = f"{self.path}.{uuid.uuid4().hex}.tmp", 0
        self.out = self.fs.open_output_stream(self.private, compression=None)
        self.add(info)

    def add(self, data: bytes) -> int:
        self.out.write(data)
        self.size += len(data)
        return self.size - len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.private, self.path)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_INDEX = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("date", pa.string())])


def archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date_col: str | None = None, dated: str | None = None) -> DataFrame:
    """Writes the archives; the index has a row per record. ``date_col`` has dates of capture as WARC writes them, ``dated`` is that of the rest."""
    dated = dated or now()
    date = F.coalesce(F.col(date_col) if date_col else F.lit(None).cast("string"), F.lit(dated))
    rows = pages.select(F.col(id_col).cast("long"), F.col(url_col), F.col(payload_col).cast("binary"), date)

    def run(batches):
        part, out = TaskContext.get().partitionId(), None
        name = f"part-{part:06d}.warc.gz"
        for batch in batches:
            made = []
            for page, url, payload, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                out = out or _Archive(f"{folder}/{name}", _info("page", name, dated))
                data, url = payload.as_py() or b"", _uri(url)
                fields = {
                    "WARC-Type": "response",
                    "WARC-Record-ID": f"<urn:x-page:{'' if page is None else page}:{part}:{out.size}>",
                    "WARC-Date": at,
                    "WARC-Target-URI": url,
                    "WARC-Payload-Digest": f"sha1:{(sha := digest(data))}",
                    "X-Page-ID": page,
                    "Content-Type": "application/http; msgtype=response",
                }
                packed = record(fields, HTTP + data)
                made.append((page, url, name, out.add(packed), len(packed), len(data), sha, at))
            if made:
                yield _batch(made, _INDEX)
        if out:
            out.close()

    schema = "page_id long, url string, file string, offset long, length long, payload_bytes long, payload_digest string, date string"
    return table(rows.mapInArrow(run, schema), "warc-index")


def resolve(index: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``index`` with the original of each record that revisits one: original_page, original_url, original_date, original_record (else null)."""
    key = ["payload_digest", "payload_bytes"]
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "file", "offset", "url", "date")
    groups = index.where(F.col("payload_bytes") >= min_bytes).groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("o")).where("n > 1").select(*key, "o")
    joined = index.join(table(groups, "warc-originals"), key, "left")
    revisit = F.col("o").isNotNull() & ~((F.col("file") == F.col("o.file")) & (F.col("offset") == F.col("o.offset")))
    name = F.concat(F.lit("<urn:x-copy:"), F.coalesce(F.col("o.page_id").cast("string"), F.lit("")), F.lit(":"), F.regexp_extract("o.file", "part-(\\d+)", 1).cast("long").cast("string"), F.lit(":"), F.col("o.offset").cast("string"), F.lit(">"))
    return joined.select("file", "offset", "length", F.col("o.page_id").alias("original_page"), F.col("o.url").alias("original_url"), F.col("o.date").alias("original_date"), F.when(revisit, name).alias("original_record"))


def rewrite(decisions: DataFrame, source: str, target: str, dated: str | None = None) -> DataFrame:
    """Writes the deduplicated archives; a row per file with its number of records, the first one not counted."""
    dated = dated or now()
    placed = decisions.repartition(parts(decisions.sparkSession), "file").sortWithinPartitions("file", "offset")

    def run(batches):
        out, name, count, reader = None, None, 0, None
        for batch in batches:
            for file, offset, length, page, url, date, original in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if file != name:
                    if out:
                        out.close()
                        yield pa.RecordBatch.from_pydict({"file": [name], "records": [count]})
                    fs, path = open_fs(f"{source}/{file}")
                    out, name, count, reader = _Archive(f"{target}/{file}", _info("copy", file, dated)), file, 0, fs.open_input_file(path)
                fields, block = parse(zlib.decompress(reader.read_at(length, offset), 31))
                fields.pop("Content-Length")
                fields["WARC-Record-ID"] = fields["WARC-Record-ID"].replace("<urn:x-page:", "<urn:x-copy:", 1)
                if original is not None:
                    fields |= {"WARC-Type": "revisit", "WARC-Profile": PROFILE, "WARC-Refers-To": original, "WARC-Refers-To-Target-URI": url, "WARC-Refers-To-Date": date, "X-Refers-To-Page-ID": page, "X-Payload-Bytes": len(block) - len(HTTP)}
                    block = HTTP
                out.add(record(fields, block))
                count += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "records": [count]})

    return table(placed.mapInArrow(run, "file string, records long"), "warc-files")


def records(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive, one at a time."""
    fs, path = open_fs(uri)
    with fs.open_input_stream(path, compression=None) as file:
        unpack, raw, data = zlib.decompressobj(31), [], file.read(READ)
        while data:
            raw.append(unpack.decompress(data))
            if unpack.eof:
                yield parse(b"".join(raw))
                data, unpack, raw = unpack.unused_data or file.read(READ), zlib.decompressobj(31), []
            else:
                data = file.read(READ)


_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read(files: DataFrame, folder: str) -> DataFrame:
    """Every record of the listed archives; the payloads of responses are held against their digests."""
    number = lambda v: None if v is None else int(v)

    def run(batches):
        for batch in batches:
            for file in batch.column(0).to_pylist():
                made = []
                for fields, block in records(f"{folder}/{file}"):
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Type"] == "response" and digest(block[len(HTTP) :]) != said:
                        raise ValueError(f"{file}: a payload differs from its digest")
                    size = number(fields.get("X-Payload-Bytes", len(block) - len(HTTP)))
                    made.append((number(fields.get("X-Page-ID")), fields.get("WARC-Target-URI"), size, said, fields["WARC-Type"], number(fields.get("X-Refers-To-Page-ID"))))
                    if len(made) >= ROWS:
                        yield _batch(made, _READ)
                        made = []
                if made:
                    yield _batch(made, _READ)

    count = max(1, files.count())
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return files.select("file").repartitionByRange(count, "file").mapInArrow(run, schema)


def deduplicated(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, date_col: str | None = None, dated: str | None = None) -> DataFrame:
    """The whole way: archives, revisit resolution, deduplicated archives in ``folder``, and their records read back."""
    spark: SparkSession = pages.sparkSession
    dated = dated or now()
    source, target = new_dir(spark, "warc"), folder or new_dir(spark, "warc-dedup")
    files = rewrite(resolve(archive(pages, source, date_col=date_col, dated=dated), min_bytes), source, target, dated)
    drop(spark, source)
    return read(files, target)
