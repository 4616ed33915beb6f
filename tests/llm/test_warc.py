import base64
import hashlib
import io
import zipfile

import pyarrow as pa
import pytest

from threadloom.llm import warc_zip
from threadloom.scratch import scratch_path

PAGES = "page_id long, url string, html string"


def brute(rows):
    best = {}
    for page, _, html in rows:
        key = html or ""
        best[key] = max(best.get(key, -(1 << 63)), -(1 << 63) if page is None else page)
    seen, out = set(), []
    for page, _, html in rows:
        payload = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        top = (-(1 << 63) if page is None else page) == best[html or ""] and html not in seen and not (html is None and "" in seen)
        if top:
            seen.add(html or "")
        target = None if top or best[html or ""] == -(1 << 63) else best[html or ""]
        out.append((page, len(payload), digest, "response" if top else "revisit", target))
    return sorted(out, key=repr)


def test_query(spark, save):
    rows = [(i, f"http://h/{i}", f"<p>page {i % 40}</p>") for i in range(200)]
    rows += [(300 + i, None, "hot") for i in range(100)] + [(500, "u", None), (501, "u\nv é", ""), (502, "", "é" * 100_000)]
    rows += [(600, "x", "tie"), (600, "y", "tie"), (599, "z", "tie"), (None, "n", "alone"), (None, "n", "pair"), (7000, "n", "pair")]
    found = [tuple(r) for r in warc_zip.op5_zip_packages(spark, save("pages", rows, PAGES)).collect()]
    assert sorted(found, key=repr) == brute(rows)
    assert warc_zip.op5_zip_packages(spark, save("pages", [], PAGES)).count() == 0


def test_several_packages_and_payloads(spark):
    rows = [(i, f"http://h/{i}", f"text {i} " * 50) for i in range(100)]
    pages = spark.createDataFrame(rows, PAGES).repartition(2)
    manifest = warc_zip.write_packages(pages, scratch_path(spark, "packages"), package_bytes=2000)
    assert manifest.count() > 4 and manifest.agg({"records": "sum"}).first()[0] == 100
    found = {r["page_id"]: r for r in warc_zip.read_packages(manifest).collect()}
    assert all(bytes(found[i]["payload"]).decode() == html and found[i]["url"] == url for i, url, html in rows)


def test_one_payload_without_ids(spark, save):
    """A third of the rows is one payload without id: one of them is the response, the others revisit."""
    rows = [(None, f"http://h/{i % 7}", "same") for i in range(40)] + [(i, "u", f"page {i}") for i in range(80)]
    found = warc_zip.op5_zip_packages(spark, save("pages", rows, PAGES)).collect()
    same = [r for r in found if r["page_id"] is None]
    assert sorted(r["record_type"] for r in same) == ["response"] + ["revisit"] * 39 and all(r["refers_to"] is None for r in same)


def test_batches_are_bounded_by_bytes():
    records = [{"page_id": i, "payload": b"x" * (3 << 20)} for i in range(7)] + [{"page_id": i, "payload": b""} for i in range(1200)]
    schema = pa.schema([("page_id", pa.int64()), ("payload", pa.binary())])
    batches = list(warc_zip._bounded(records, schema))
    assert [b.num_rows for b in batches] == [1] * 6 + [500, 500, 201]
    narrow = list(warc_zip._bounded(records, schema.remove(1)))  # without payloads only rows count
    assert [b.num_rows for b in narrow] == [500, 500, 207]


def test_zip64_and_compressed_members():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.comment = b"a comment"
        with z.open(zipfile.ZipInfo("wide"), "w", force_zip64=True) as f:
            f.write(b"0123456789")
        z.writestr(zipfile.ZipInfo("plain"), b"abc")
        z.writestr("packed", b"x" * 999, zipfile.ZIP_DEFLATED)
    data = raw.getvalue()
    directory = warc_zip.ZipDirectory(lambda at, n: data[at : at + n], len(data))
    assert directory.read("wide") == b"0123456789" and directory.read("plain") == b"abc"
    with pytest.raises(ValueError):
        directory.read("packed")


def test_zip64_directory_records():
    """A directory whose entries and end record hold their numbers in ZIP64 fields only."""
    import struct

    body = b"PK\x03\x04" + struct.pack("<HHHHHLLLHH", 45, 0, 0, 0, 0, 0, 5, 5, 1, 0) + b"a" + b"hello"
    extra = struct.pack("<HHQQQ", 1, 24, 5, 5, 0)
    entry = b"PK\x01\x02" + struct.pack("<HHHHHHLLLHHHHHLL", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + b"a" + extra
    at = len(body)
    wide = b"PK\x06\x06" + struct.pack("<QHHLLQQQQ", 44, 45, 45, 0, 0, 1, 1, len(entry), at)
    locator = b"PK\x06\x07" + struct.pack("<LQL", 0, at + len(entry), 1)
    end = b"PK\x05\x06" + struct.pack("<HHHHLLH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    data = body + entry + wide + locator + end
    directory = warc_zip.ZipDirectory(lambda i, n: data[i : i + n], len(data))
    assert directory.read("a") == b"hello"


def test_against_sql(spark, sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    df = warc_zip.op5_zip_packages(spark, sf_dir)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({warc_zip.ORACLE})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))
