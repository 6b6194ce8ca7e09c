"""Legacy archive converter: ARC files in, WARC files out.

ARC comes in two versions that the file's first record declares: version 1 has five fields in a record's header line
(URL, IP, date, type, length), version 2 has ten (with result code, checksum, location, offset, file name). The parser
reads the header line by the declared version and then exactly the declared number of bytes. The converter synthesises
the WARC side: record ids (version 8 UUIDs that hold the page id), ISO timestamps, record types, payload and block
digests. Equal payloads become one response (the largest page id) and revisits of it.

Files are written by Spark's own text sink (committed, on any file system, recoverable) and read by its binary source;
the gzip codec compresses whole files. A file ends after PER_FILE rows of the sink, each of CHUNK bytes of records (or
one larger record), so a task holds a bounded file. Which record is a response is decided on (digest, page id) rows
alone. The decisions are few and go to the files in waves, each broadcast to its own files, so payloads are never
shuffled and no more than WAVE decisions are broadcast at a time. Where there are several waves, the decisions are
written once, a folder for each wave, and a wave reads its own.

Defined cases: a null html is an empty payload; a null url is written as `urn:none`, white space and control characters
in URLs are percent-encoded; rows without page_id are responses and never referred to; repeated rows with the largest
page_id are all responses, each with a record id of its own, the last of which the revisits refer to; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from readloom.llm.common import cut, remove, scratch, table, tidy

FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Date of records whose source has none.
DATE = "20240101000000"
#: Bytes of records in a row of the sink, and rows of a file.
CHUNK, PER_FILE = 1 << 22, 16
#: Decisions (about 100 bytes each) that are broadcast at a time.
WAVE = 500_000


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def safe_url(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" and not c.isspace() else "".join(f"%{b:02X}" for b in c.encode()) for c in url) if url else "urn:none"


@dataclass
class Record:
    """A record of an ARC file: the fields of its header line by name, and its body."""

    version: int
    fields: dict[str, str]
    body: bytes

    @property
    def http(self) -> tuple[bytes, bytes]:
        """Head (with the empty line) and payload."""
        head, empty_line, payload = self.body.partition(b"\r\n\r\n")
        return head + empty_line, payload


def arc_record(url: str, ip: str, date: str, mime: str, body: bytes, version: int, offset: int = 0, name: str = "-", result: int = 200) -> bytes:
    """Header line, body and the newline that ends a record."""
    fields = [url, ip, date, mime] + ([str(result), digest(body), "-", str(offset), name] if version == 2 else [])
    return " ".join([*fields, str(len(body))]).encode() + b"\n" + body + b"\n"


def arc_head(name: str, date: str, version: int) -> bytes:
    """The first record of a file, which declares its version."""
    body = f"{version} 0 readloom\n{FIELDS[version]}\n".encode()
    fields = [f"filedesc://{name}", "0.0.0.0", date, "text/plain"] + (["200", "-", "-", "0", name] if version == 2 else [])
    return " ".join([*fields, str(len(body))]).encode() + b"\n" + body + b"\n"


def parse_arc(data: bytes) -> Iterator[Record]:
    """The records of an ARC file after its first, which gives the version and the names of the fields."""
    at, version, names = 0, 0, FIELDS[1].split()
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):  # records are kept apart by empty lines
            at += 1
            continue
        end = data.index(b"\n", at)
        parts = data[at:end].rstrip(b"\r").decode().split(" ")
        if not parts[-1].isdigit() or end + 1 + int(parts[-1]) > len(data):
            raise ValueError(f"byte {at}: no header line with the length of what follows")
        body = data[end + 1 : end + 1 + int(parts[-1])]
        if parts[0].startswith("filedesc://"):
            lines = body.decode().split("\n")
            version, names = int(lines[0].split()[0]), lines[1].split()
            if version not in FIELDS or names != FIELDS[version].split():
                raise ValueError(f"unknown version or fields: {lines[:2]}")
        elif len(parts) != len(names) or not version:
            raise ValueError(f"byte {at}: {len(parts)} fields where version {version} has {len(names)}")
        else:
            yield Record(version, dict(zip(names, parts, strict=True)), body)
        at = end + 1 + len(body)


def record_id(page_id: int | None, seed: str) -> str:
    """A version 8 UUID: 48 bits from the seed, then the page id, or without one 64 more bits from the seed."""
    tag = hashlib.md5(seed.encode()).hexdigest()
    s = tag[12:28] if page_id is None else f"{page_id & (1 << 64) - 1:016x}"
    last = "00" if page_id is not None else "ff"
    return f"<urn:uuid:{tag[:8]}-{tag[8:12]}-8{s[:3]}-8{s[3:6]}-{s[6:16]}{last}>"


def page_of(record: str) -> int | None:
    """The page id in a record id."""
    x = record.strip("<>").rpartition(":")[2].split("-")
    value = int(x[2][1:] + x[3][1:] + x[4][:10], 16)
    return None if x[4][10:] == "ff" else value - (1 << 64) * (value >> 63)


def warc_record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def iso(date: str) -> str:
    """An ARC date (14 digits, or 12 or 8 in old files) as WARC writes it."""
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of every record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split("\r\n")
        if not first.startswith("WARC/1."):
            raise ValueError(f"byte {at}: no WARC record")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        n = int(fields["content-length"])
        block, at = data[end + 4 : end + 4 + n], end + 4 + n + 4
        if len(block) != n or data[at - 4 : at] != b"\r\n\r\n":
            raise ValueError("a record is cut off")
        yield fields, block


def _header(head: bytes, name: str) -> str | None:
    for line in head.decode().split("\r\n")[1:]:
        k, _, v = line.partition(":")
        if k.strip().lower() == name:
            return v.strip()
    return None


def _rolled(items: Iterator, head, build, chunk: int, per_file: int) -> Iterator[pa.RecordBatch]:
    """Rows of the text sink, which ends each by the newline that is cut off here: head(file) and build(item, file, offset).

    The sink begins a file after every per_file rows of `chunk` bytes or more, counted from the task's first.
    """
    parts: list[bytes] = []
    size = rows = offset = file = 0
    for item in items:
        if not parts and rows % per_file == 0:
            file = rows // per_file
            parts.append(head(file))
            offset = size = len(parts[0])
        parts.append(build(item, file, offset))
        offset, size = offset + len(parts[-1]), size + len(parts[-1])
        if size >= chunk:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)[:-1]], pa.binary())], ["value"])
            parts, size, rows = [], 0, rows + 1
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)[:-1]], pa.binary())], ["value"])
    tidy()


def _write(rows: DataFrame, path: str) -> None:
    sink = rows.select(F.col("value").cast("string").alias("value")).write.mode("append")
    sink.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", PER_FILE).text(path)


def write_arc(pages: DataFrame, path: str) -> None:
    """pages as ARC files: even partitions in version 1, odd ones in version 2."""
    chunk, per_file = CHUNK, PER_FILE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version, name = 1 + part % 2, lambda file: f"part-{part:06d}-{file:06d}.arc"

        def build(row, file: int, offset: int) -> bytes:
            page_id, url, html = row
            payload = (html or "").encode()
            page = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{page}Content-Length: {len(payload)}\r\n\r\n".encode()
            return arc_record(safe_url(url), "0.0.0.0", DATE, "text/html", head + payload, version, offset, name(file))

        rows = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
        yield from _rolled(rows, lambda file: arc_head(name(file), DATE, version), build, chunk, per_file)

    held = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    _write(held.mapInArrow(run, "value binary"), path)


def _files(spark, path: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")


def waves_of(sizes: dict[str, int], most: int) -> list[list[str]]:
    """The names in parts whose sizes come to `most` at most, or that are one name."""
    out: list[list[str]] = []
    total = 0
    for name, n in sorted(sizes.items()):
        if not out or total + n > most:
            out.append([])
            total = 0
        out[-1].append(name)
        total += n
    return out


def convert(spark, arc: str, warc: str) -> None:
    """The ARC files of a folder as WARC files in another. A record's id is made from its file's name and its place there."""
    chunk, per_file = CHUNK, PER_FILE

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = [(i, _header(r.http[0], "x-page-id"), digest(r.http[1]), r.fields["URL"]) for i, r in enumerate(parse_arc(gzip.decompress(content.as_buffer())))]
                yield pa.RecordBatch.from_arrays([
                    pa.array([path.as_py()] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([None if r[1] is None else int(r[1]) for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string()),
                    pa.array([r[3] for r in rows], pa.string()),
                ], ["path", "i", "page_id", "digest", "uri"])
        tidy()

    def writer(wave: int):
        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()

            def records() -> Iterator[tuple]:
                for batch in batches:
                    for path, content, decisions in zip(batch.column("path").to_pylist(), batch.column("content"), batch.column("decisions"), strict=True):
                        refer = {d["i"]: d["to"] for d in decisions.as_py() or ()}
                        name = path.rpartition("/")[2]
                        yield from ((f"{name} {i}", r, refer.get(i)) for i, r in enumerate(parse_arc(gzip.decompress(content.as_buffer()))))

            def build(item, file: int, offset: int) -> bytes:
                seed, r, to = item
                head, payload = r.http
                page, url, date = _header(head, "x-page-id"), r.fields["URL"], iso(r.fields["Archive-date"])
                fields = [("WARC-Record-ID", record_id(None if page is None else int(page), seed)), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-IP-Address", r.fields["IP-address"]), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("Content-Type", "application/http;msgtype=response")]
                block = r.body
                if to:
                    block = head
                    fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(to["page_id"], f"{to['path'].rpartition('/')[2]} {to['i']}")), ("WARC-Refers-To-Target-URI", to["uri"])]
                return warc_record("revisit" if to else "response", [*fields, ("WARC-Block-Digest", f"sha1:{digest(block)}")], block)

            def info(file: int) -> bytes:
                name = f"info {warc.rpartition('/')[2]} {wave} {part} {file}"
                return warc_record("warcinfo", [("WARC-Record-ID", record_id(None, name)), ("WARC-Date", iso(DATE)), ("Content-Type", "application/warc-fields")], b"software: readloom\r\nformat: WARC File Format 1.1\r\n")

            yield from _rolled(records(), info, build, chunk, per_file)

        return write

    found = cut(_files(spark, arc).mapInArrow(index, "path string, i long, page_id long, digest string, uri string"))
    largest = found.where("page_id is not null").groupBy("digest").agg(F.max(F.struct("page_id", "path", "i", "uri")).alias("to"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = cut(found.where("page_id is not null").join(largest, "digest").where("page_id < to.page_id").select("path", "i", "to"))
    sizes = {r[0]: r[1] for r in found.select("path").distinct().join(revisits.groupBy("path").count(), "path", "left").fillna(0).collect()}  # a row for each file
    waves = waves_of(sizes, WAVE)
    if len(waves) > 1:
        told = scratch(spark, "decisions")
        wave_of = spark.createDataFrame([(path, number) for number, paths in enumerate(waves) for path in paths], "path string, wave int")
        revisits.join(wave_of, "path").repartition(len(waves), "wave").write.partitionBy("wave").parquet(told)
        revisits = spark.read.schema(StructType([*revisits.schema.fields, StructField("wave", IntegerType())])).parquet(told)
    for number, paths in enumerate(waves or [[]]):
        some = revisits if len(waves) < 2 else revisits.where(F.col("wave") == number)
        decisions = some.groupBy("path").agg(F.collect_list(F.struct("i", "to")).alias("decisions"))
        files = _files(spark, arc if len(waves) < 2 else paths)
        _write(files.join(F.broadcast(decisions), "path", "left").select("path", "content", "decisions").mapInArrow(writer(number), "value binary"), warc)
    if len(waves) > 1:
        remove(spark, told)


def read_warc(spark, warc: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the responses and revisits of WARC files."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                out: list[list] = [[] for _ in names]
                for fields, block in parse_warc(gzip.decompress(content.as_buffer())):
                    kind = fields["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    head, _, payload = block.partition(b"\r\n\r\n")
                    n, stated = int(_header(head, "content-length")), fields["warc-payload-digest"].removeprefix("sha1:")
                    if digest(block) != fields["warc-block-digest"].removeprefix("sha1:") or kind == "response" and (digest(payload) != stated or len(payload) != n):
                        raise ValueError("a record's digest or length is wrong")
                    row = (page_of(fields["warc-record-id"]), n, stated, kind, page_of(fields["warc-refers-to"]) if kind == "revisit" else None)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names)

    return _files(spark, warc).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def query(spark, sf_dir: str) -> DataFrame:
    arc, warc = scratch(spark, "arc"), scratch(spark, "warc")
    write_arc(table(spark, sf_dir, "pages"), arc)
    convert(spark, arc, warc)
    return read_warc(spark, warc)


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (i // 4)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < last THEN last END AS refers_to
FROM g
"""
