"""Archives written in several jobs and by other writers."""

import gzip
import hashlib
import io
import os

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from docloom.llm import warc

PAGES = "page_id long, url string, html string"


def pages(spark, ids):
    return spark.createDataFrame([(i, f"u{i}", f"the payload of page {i} " * 20) for i in ids], PAGES)


def ids(spark, path, **options):
    back = spark.read.format("warc").options(**options).load(path)
    return sorted(int(r[0]) for r in back.select(F.element_at("headers", "X-Page-Id")).collect())


def test_appended_jobs_add_up_and_overwriting_starts_anew(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    warc.archive(pages(spark, [1, 2, 3]).repartition(2), path)
    warc.archive(pages(spark, [4, 5, 6]), path)
    assert ids(spark, path) == [1, 2, 3, 4, 5, 6]
    (tmp_path / "a" / "part-00ff.warc.gz").write_bytes(b"left by a task that died")
    assert ids(spark, path) == [1, 2, 3, 4, 5, 6]
    rows = warc.records(pages(spark, [7]), 100, "page_id", "url", "html")
    rows.write.format("warc").mode("overwrite").save(path)
    assert ids(spark, path) == [7]
    assert len([f for f in os.listdir(tmp_path / "a") if f.startswith("_manifest")]) == 1


def test_folders_of_archives(spark, tmp_path):
    warc.archive(pages(spark, [1, 2, 3]), f"file://{tmp_path}/all/a")
    warc.archive(pages(spark, [4, 5]), f"file://{tmp_path}/all/b/c")
    (tmp_path / "all" / "d").mkdir()
    (tmp_path / "all" / "d" / "foreign.warc").write_bytes(raw([9]))
    assert ids(spark, f"file://{tmp_path}/all") == [1, 2, 3, 4, 5, 9]


def raw(numbers, lower=False, size=300, inside=b""):
    out = b""
    for i in numbers:
        body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\npage {i} ".encode() + b"x" * size + inside
        head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: u{i}\r\nX-Page-Id: {i}\r\nContent-Type: application/http\r\nContent-Length: {len(body)}\r\n\r\n"
        out += (head.replace("WARC-T", "warc-t").replace("Content-L", "content-l") if lower else head).encode() + body + b"\r\n\r\n"
    return out


def read(data, splits, payload=True, wanted=lambda row: True):
    with pafs.LocalFileSystem().open_input_file(data) as f:
        size = f.size()
        bounds = list(range(0, size, splits)) + [size]
        return [r for a, b in zip(bounds, bounds[1:]) for r in warc.read_records(f, size, a, b, payload, wanted)]


@pytest.mark.parametrize("lower", [False, True])
@pytest.mark.parametrize("form", ["plain", "one member", "members", "members of many"])
def test_other_writers(tmp_path, form, lower):
    many = list(range(40))
    data = {
        "plain": lambda: raw(many, lower),
        "one member": lambda: gzip.compress(raw(many, lower)),
        "members": lambda: b"".join(gzip.compress(raw([i], lower)) for i in many),
        "members of many": lambda: b"".join(gzip.compress(raw(many[i : i + 7], lower)) for i in range(0, 40, 7)),
    }[form]()
    (tmp_path / "x").write_bytes(data)
    for splits in (1 << 20, 5000, 333, 97):
        rows = read(str(tmp_path / "x"), splits)
        assert sorted(r["target_uri"] for r in rows) == sorted(f"u{i}" for i in many), splits
        for r in rows:
            i = r["target_uri"][1:]
            assert r["payload"] == f"page {i} ".encode() + b"x" * 300 and r["payload_bytes"] == len(r["payload"]) and dict(r["headers"]) == {"X-Page-Id": i}
        some = read(str(tmp_path / "x"), splits, payload=False, wanted=lambda row: row["target_uri"] in ("u3", "u39"))
        assert [(r["target_uri"], r["payload"]) for r in some] == [("u3", None), ("u39", None)]


def test_an_archive_inside_a_payload_is_payload(tmp_path):
    inner = b"\r\n\r\n" + raw([100, 101, 102], size=50)
    (tmp_path / "x").write_bytes(raw([1], inside=inner) + raw([2], inside=inner) + raw([3]))
    for splits in (1 << 20, 2500, 3001):
        assert [r["target_uri"] for r in read(str(tmp_path / "x"), splits)] == ["u1", "u2", "u3"], splits


def test_unwanted_payloads_are_skipped_without_reading_them(tmp_path):
    (tmp_path / "x").write_bytes(raw(range(20), size=200_000))

    class Counting(io.RawIOBase):
        def __init__(self):
            self.f, self.read_bytes = open(tmp_path / "x", "rb"), 0

        def read_at(self, n, at):
            self.f.seek(at)
            data = self.f.read(n)
            self.read_bytes += len(data)
            return data

    f = Counting()
    size = os.path.getsize(tmp_path / "x")
    rows = list(warc.read_records(f, size, 0, size, True, lambda row: row["target_uri"] == "u7"))
    assert len(rows) == 1 and f.read_bytes < 1_000_000
    assert hashlib.sha256(rows[0]["payload"]).digest() == hashlib.sha256(b"page 7 " + b"x" * 200_000).digest()
