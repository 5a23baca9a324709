"""WARC archives as a Spark data source, with identical payloads stored once.

``spark.read.format("warc")`` plans its partitions from the sizes of the files: small files together, large ones, compressed or not,
cut at record boundaries. Every record's headers are parsed first; filters on record type and header columns
that Spark pushes down are decided there, and a record they reject, or any with
option ``payload`` = false, is skipped by its length without being inflated. The writer stores each record as a
gzip member with the ``sl`` skip lengths of the format's annex; archives of other writers are read too: members without them or with
many records, and header names in any case.

A task writes files of names of its own and each commit lists the files that count in a ``_manifest-….json`` of its own, so retried or
speculative tasks leave nothing that a reader sees, and appended jobs add up. Overwriting removes the lists and files of before. Folders are
read with all below them, each by its own lists. Files are opened through ``pyarrow.fs`` (local, HDFS, S3, GCS by
the path's scheme) and must be visible to all executors.

``archive``: a null payload counts as empty. Of equal payloads of at least ``least`` bytes the rows with the smallest id are
responses and all others revisits of it; a repeated row of that id is stored again; rows with a null id come last,
as revisits where an id exists, else as responses. An empty table gives an archive without records.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from docloom.llm.base import table
from docloom.llm.registry import register
from docloom.session import scratch_dir

SCHEMA = (
    "record_type string, record_id string, date string, target_uri string, refers_to string, payload_digest string, "
    "payload_bytes long, headers map<string,string>, payload binary"
)
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "date": "WARC-Date",
    "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
}
MANIFEST = r"_manifest.*\.json"
BREAK = b"\r\n\r\n"


def _filesystem(path: str):
    return pafs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else path.replace("file:", "file://"))


# -- records ------------------------------------------------------------------------------------


def member(record: bytes, level: int) -> bytes:
    """A gzip member whose extra field tells its compressed and its inflated length."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(record) + z.flush()
    whole = 24 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + (12).to_bytes(2, "little") + b"sl" + (8).to_bytes(2, "little")
    sizes = whole.to_bytes(4, "little") + (len(record) & 0xFFFFFFFF).to_bytes(4, "little")
    return head + sizes + body + zlib.crc32(record).to_bytes(4, "little") + (len(record) & 0xFFFFFFFF).to_bytes(4, "little")


def record(row: dict) -> bytes:
    """The bytes of one record. A revisit keeps its HTTP headers, with the payload's length, and no payload."""
    payload = row["payload"] or b""
    size = len(payload) if row.get("payload_bytes") is None else row["payload_bytes"]
    revisit = row["record_type"] == "revisit"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block += b"" if revisit else payload
    out = ["WARC/1.1"]
    for name, header in HEADERS.items():
        if row.get(name) is not None:
            value = f"sha256:{row[name]}" if name == "payload_digest" else row[name]
            out.append(f"{header}: {_one_line(value)}")
    if revisit:
        out.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    out += [f"{_one_line(k)}: {_one_line(v)}" for k, v in dict(row.get("headers") or {}).items()]
    out.append("Content-Type: application/http; msgtype=response")
    out.append(f"Content-Length: {len(block)}")
    return "\r\n".join(out).encode() + BREAK + block + BREAK


def _one_line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", str(value))


class Headers(dict):
    """Header fields as they were written; ``of`` finds one whatever its case."""

    def of(self, name: str, otherwise: str | None = None) -> str | None:
        low = name.lower()
        return next((v for k, v in self.items() if k.lower() == low), otherwise)

    def length(self) -> int:
        value = self.of("Content-Length", "0")
        return int(value) if value.isdigit() else 0


def parse_headers(head: bytes) -> Headers:
    lines = re.sub(rb"\r\n[ \t]+", b" ", head).split(b"\r\n")
    pairs = (line.partition(b":") for line in lines[1:] if b":" in line)
    return Headers((k.strip().decode("utf-8", "replace"), v.strip().decode("utf-8", "replace")) for k, _, v in pairs)


class _Cursor:
    """Bytes of records one after another; ``out`` holds what was read from the current position on."""

    out = b""

    def _more(self, n: int) -> bool:
        raise NotImplementedError

    def upto(self, mark: bytes, start: int = 0) -> int:
        """The position of ``mark``, or -1."""
        while (i := self.out.find(mark, start)) < 0:
            start = max(start, len(self.out) - len(mark))
            if not self._more(8192):
                break
        return i

    def whole(self, n: int) -> bytes:
        while len(self.out) < n and self._more(max(8192, min(n - len(self.out), 1 << 20))):
            pass
        return self.out[:n]

    def skip(self, n: int) -> None:
        """Move on by ``n`` bytes without keeping them."""
        while len(self.out) < n:
            n -= len(self.out)
            self.out = b""
            if not self._more(min(max(n, 8192), 1 << 20)):
                return
        self.out = self.out[n:]


class _Member(_Cursor):
    """A gzip member with one or more records, inflated only as far as asked for.

    ``sizes``: its compressed and its inflated length, if its extra field tells them.
    """

    def __init__(self, f, at: int, sizes: tuple[int, int] | None):
        self.f, self.at, self.sizes, self.z, self.out = f, at, sizes, zlib.decompressobj(31), b""
        self.read = 0

    def single(self, n: int) -> bool:
        """Whether a record of ``n`` bytes, the first, is known to be all."""
        return self.sizes is not None and n & 0xFFFFFFFF == self.sizes[1]

    def end(self) -> int:
        """Where the next member begins."""
        if self.sizes is not None:
            return self.at + self.sizes[0]
        while self._more(1 << 20):
            self.out = b""
        return self.at + self.read - len(self.z.unused_data)

    def _more(self, n: int) -> bool:
        if self.z.eof:
            return False
        if self.z.unconsumed_tail:
            data = self.z.unconsumed_tail
        else:
            n = n if self.sizes is None else min(n, self.sizes[0] - self.read)
            data = self.f.read_at(n, self.at + self.read) if n > 0 else b""
            self.read += len(data)
        self.out += self.z.decompress(data, 4 << 20)  # a small input may inflate to much more
        return bool(data)


class _Plain(_Cursor):
    """The records of an archive that is not compressed."""

    def __init__(self, f, at: int):
        self.f, self.at, self.out = f, at, b""

    @property
    def here(self) -> int:
        return self.at - len(self.out)

    def skip(self, n: int) -> None:
        if n <= len(self.out):
            self.out = self.out[n:]
        else:
            self.at, self.out = self.here + n, b""

    def _more(self, n: int) -> bool:
        data = self.f.read_at(n, self.at)
        self.at += len(data)
        self.out += data
        return bool(data)


def _skip_lengths(head: bytes) -> tuple[int, int] | None:
    if head[3:4] != b"\x04" or head[12:14] != b"sl":
        return None
    return int.from_bytes(head[16:20], "little"), int.from_bytes(head[20:24], "little")


def _first_member(f, start: int, end: int) -> int:
    """The first record at or after ``start`` that begins before ``end``, else ``end``."""
    at, step = start, 1 << 20
    while at < end:
        data = f.read_at(min(step, end - at) + 3, at)
        for m in re.finditer(rb"\x1f\x8b\x08", data):
            if at + m.start() < end:
                try:
                    if _Member(f, at + m.start(), None).whole(5) == b"WARC/":
                        return at + m.start()
                except zlib.error:
                    continue
        at += step
    return end


def _follows(f, at: int, end: int, size: int) -> bool:
    """Whether records follow on each other from ``at`` to beyond ``end``, or to the end of the file."""
    cursor = _Plain(f, at)
    while cursor.here < end:
        if cursor.here >= size:
            return True
        head = cursor.upto(BREAK) if cursor.whole(5) == b"WARC/" else -1
        headers = parse_headers(cursor.out[:head]) if head >= 0 else Headers()
        if headers.of("WARC-Type") is None or headers.of("Content-Length") is None:
            return False
        cursor.skip(head + 4 + headers.length())
        if cursor.whole(4) != BREAK and cursor.here < size:
            return False
        cursor.skip(4)
    return cursor.here >= size or cursor.whole(5) == b"WARC/"


def _first_plain(f, start: int, end: int, size: int) -> int:
    """The first record at or after ``start`` in an archive that is not compressed, else ``end``.

    What looks like records inside a payload does not follow on to the end of the range, unless the payload is
    an archive that is longer than the range.
    """
    at, step, mark = max(0, start - 4), 1 << 20, BREAK + b"WARC/"
    while at < end:
        data = f.read_at(min(step, end - at) + len(mark), at)
        i = data.find(mark)
        while i >= 0 and at + i + 4 < end:
            if _follows(f, at + i + 4, end, size):
                return at + i + 4
            i = data.find(mark, i + 1)
        at += step
    return end


def _rows(cursor: _Cursor, payload: bool, wanted, stop):
    """Rows of the records at the cursor until ``stop()`` or their end; a record is passed over by its length."""
    first = True
    while not stop():
        head = cursor.upto(BREAK)
        if head < 0:
            return
        skipped = len(cursor.out[:head]) - len(cursor.out[:head].lstrip(b"\r\n"))
        headers = parse_headers(cursor.out[skipped:head])
        body, length = head + 4, headers.length()
        whole = body + length + 4
        row = {name: headers.of(h) for name, h in HEADERS.items()}
        if row["payload_digest"]:
            row["payload_digest"] = row["payload_digest"].removeprefix("sha256:")
        if wanted(row):
            known, content = {h.lower() for h in (*HEADERS.values(), "WARC-Profile", "Content-Type", "Content-Length")}, body
            row["headers"] = [(k, v) for k, v in headers.items() if k.lower() not in known]
            http = headers.of("Content-Type", "").lower().startswith("application/http")
            if http:
                cut = cursor.upto(BREAK, body)
                content = cut + 4 if 0 <= cut < body + length else body + length
                inner = parse_headers(cursor.out[body:content])
            row["payload_bytes"] = body + length - content
            if row["record_type"] == "revisit":
                row["payload_bytes"], row["payload"] = inner.length() if http else 0, None
            else:
                row["payload"] = cursor.whole(body + length)[content:] if payload else None
            yield row
        if first and isinstance(cursor, _Member) and cursor.single(whole):
            return
        first = False
        cursor.skip(whole)


def read_records(f, size: int, start: int, end: int, payload: bool, wanted):
    """Rows of the records that begin in [start, end), of compressed archives those of the members that do; ``wanted`` decides on the headers alone."""
    if f.read_at(2, 0) == b"\x1f\x8b":
        at = _first_member(f, start, end) if start else start
        while at < end and at < size:
            member = _Member(f, at, _skip_lengths(f.read_at(24, at)))
            yield from _rows(member, payload, wanted, lambda: False)
            at = member.end()
    else:
        at = _first_plain(f, start, end, size) if start else start
        cursor = _Plain(f, at)
        yield from _rows(cursor, payload, wanted, lambda: cursor.here >= min(end, size))


# -- the data source ------------------------------------------------------------------------------


@dataclass
class _Ranges(InputPartition):
    ranges: list  # (file, its size, start, end)


@dataclass
class _Written(WriterCommitMessage):
    files: list


TESTS = {
    EqualTo: lambda f: lambda v: v is not None and v == f.value,
    In: lambda f: lambda v: v is not None and v in f.value,
    IsNotNull: lambda f: lambda v: v is not None,
    StringStartsWith: lambda f: lambda v: v is not None and v.startswith(f.value),
    StringEndsWith: lambda f: lambda v: v is not None and v.endswith(f.value),
    StringContains: lambda f: lambda v: v is not None and f.value in v,
}


class WarcReader(DataSourceReader):
    def __init__(self, schema, options):
        self.path, self.names = options["path"], [x.name for x in schema.fields]
        self.schema = schema
        self.payload = str(options.get("payload", "true")).lower() == "true" and "payload" in self.names
        self.split = int(options.get("splitbytes", options.get("splitBytes", 64 << 20)))
        self.filters = []

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in TESTS and f.attribute[0] in HEADERS and len(f.attribute) == 1:
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        fs, root = _filesystem(self.path)
        infos = fs.get_file_info(pafs.FileSelector(root, recursive=True))
        names = {i.path: i.size for i in infos if i.is_file and i.path.endswith((".warc", ".warc.gz"))}
        # each commit has left a list; in a folder with lists only what they name counts
        listed: dict[str, set[str]] = {}
        for i in infos:
            if i.is_file and re.fullmatch(MANIFEST, os.path.basename(i.path)):
                with fs.open_input_stream(i.path) as s:
                    listed.setdefault(os.path.dirname(i.path), set()).update(json.loads(s.read()))
        names = {n: s for n, s in names.items() if os.path.basename(n) in listed.get(os.path.dirname(n), {os.path.basename(n)})}
        out, now, load = [], [], 0
        for name, size in sorted(names.items()):
            for start in range(0, size, self.split):
                end = min(start + self.split, size)
                if now and load + end - start > self.split:
                    out, now, load = [*out, _Ranges(now)], [], 0
                now.append((name, size, start, end))
                load += end - start
        return [*out, _Ranges(now)] if now else [_Ranges([])]

    def read(self, partition):
        fs, _ = _filesystem(self.path)
        tests = [(f.attribute[0], TESTS[type(f)](f)) for f in self.filters]
        wanted = lambda row: all(t(row[name]) for name, t in tests)
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, rows, load = to_arrow_schema(self.schema), [], 0
        for name, size, start, end in partition.ranges:
            with fs.open_input_file(name) as f:
                for row in read_records(f, size, start, end, self.payload, wanted):
                    rows.append({n: row.get(n) for n in self.names})
                    load += len(row.get("payload") or b"") + 500
                    if load > 16 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, load = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.level, self.overwrite = options["path"], int(options.get("level", 6)), overwrite
        self.most = int(options.get("filebytes", options.get("fileBytes", 1 << 30)))

    def write(self, iterator):
        fs, root = _filesystem(self.path)
        fs.create_dir(root, recursive=True)
        files, out, load = [], None, 0
        for batch in iterator:
            for i in range(batch.num_rows):
                if out is None or load > self.most:
                    if out is not None:
                        out.close()
                    files.append(f"part-{os.urandom(12).hex()}.warc.gz")
                    out, load = fs.open_output_stream(f"{root}/{files[-1]}", compression=None), 0
                row = {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}
                data = member(record(row), self.level)
                out.write(data)
                load += len(data)
        if out is not None:
            out.close()
        return _Written(files)

    def commit(self, messages):
        fs, root = _filesystem(self.path)
        fs.create_dir(root, recursive=True)
        before = [i.path for i in fs.get_file_info(pafs.FileSelector(root)) if i.is_file] if self.overwrite else []
        files = [f for m in messages if m for f in m.files]
        with fs.open_output_stream(f"{root}/_manifest-{os.urandom(12).hex()}.json") as out:
            out.write(json.dumps(files).encode())
        # lists first, so that a reader never meets a list without its files; then what no list names any more
        old = [p for p in before if os.path.basename(p) not in files and re.fullmatch(rf"{MANIFEST}|part-[0-9a-f]+\.warc\.gz", os.path.basename(p))]
        for p in sorted(old, key=lambda p: not re.fullmatch(MANIFEST, os.path.basename(p))):
            fs.delete_file(p)

    def abort(self, messages):
        fs, root = _filesystem(self.path)
        for m in messages:
            for f in m.files if m else ():
                fs.delete_file(f"{root}/{f}")


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(schema, self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register_source(spark: SparkSession) -> None:
    """Make the format known. Spark refuses a source that takes filters unless pushdown is switched on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def records(pages: DataFrame, least: int, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """A record row per page; payloads travel once, to meet the revisit verdict on (id, digest)."""
    body = F.coalesce(F.encode(F.col(payload_col).cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    narrow = rows.where(F.octet_length("payload") >= least).select("id", "digest")
    firsts = narrow.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = (
        narrow.join(firsts.select("digest", "first"), "digest")
        .where("first IS NOT NULL AND NOT id <=> first")
        .groupBy("id", "digest")
        .agg(F.first("first").alias("first"))
    )
    later = later.select(F.col("id").alias("i"), F.col("digest").alias("d"), "first")
    met = rows.join(later, F.col("id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d")), "left")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    revisit = F.col("first").isNotNull()
    return met.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.coalesce(name("id"), F.concat(F.lit("<urn:sha256:"), "digest", F.lit(">"))).alias("record_id"),
        F.date_format(F.lit("1970-01-01").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
        F.col("url").alias("target_uri"),
        name("first").alias("refers_to"),
        F.col("digest").alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(F.col("id").isNotNull(), F.create_map(F.lit("X-Page-Id"), F.col("id").cast("string"))).alias("headers"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def archive(
    pages: DataFrame,
    path: str,
    least: int = 100,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
) -> None:
    """Write a record per row of ``pages`` to archives under ``path``."""
    register_source(pages.sparkSession)
    rows = records(pages, least, id_col, url_col, payload_col)
    rows.write.format("warc").mode("append").save(path)


SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) END AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f"""


@register("op1_warc", SQL)
def op1(spark, sf_dir):
    path = scratch_dir(spark, "warc")
    archive(table(spark, sf_dir, "pages"), path)
    back = spark.read.format("warc").load(path)
    page = lambda c: F.regexp_extract(c, "urn:page:(-?[0-9]+)", 1).try_cast("long")
    return back.select(
        F.element_at("headers", "X-Page-Id").cast("long").alias("page_id"),
        "payload_bytes",
        F.coalesce(F.sha2("payload", 256), F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )
