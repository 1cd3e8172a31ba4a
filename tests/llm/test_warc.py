"""Packages of other writers, made by hand, and indexes."""

import gzip
import io
import json
import zipfile

import pytest
from pyarrow import fs

from corvane.llm import warc
from corvane.llm.common import shared_path, store_of


def record(kind, block, **headers):
    lines = [f"{name.replace('_', '-')}: {value}" for name, value in ({"WARC_Type": kind} | headers | {"content-length": len(block)}).items()]
    return ("WARC/1.0\r\n" + "\r\n".join(lines)).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


HTTP = b"HTTP/1.1 200 OK\r\ncontent-TYPE: text/html\r\n\r\n"
DIGEST = warc.base64.b32encode(warc.hashlib.sha1(b"<p>one</p>").digest()).decode()
FIRST = [
    record("warcinfo", b"software: by hand"),
    record("response", HTTP + b"<p>one</p>", Warc_Record_Id="<urn:uuid:1>", WARC_Target_URI="http://a.example/x", Content_Type="application/http; msgtype=response", WARC_Payload_Digest=f"sha1:{DIGEST}"),
    record("request", b"GET / HTTP/1.1\r\n\r\n", Content_Type="application/http; msgtype=request"),
    record("revisit", HTTP, warc_record_id="<urn:uuid:2>", Warc_Refers_To="<urn:uuid:1>", Content_Type="application/http", WARC_Payload_Digest=f"SHA1:{DIGEST}"),
]
SECOND = [record("resource", b"plain", WARC_RECORD_ID="<urn:uuid:3>", Content_Type="text/plain"), record("response", HTTP + b"<p>two</p>", WARC_Record_ID="<urn:uuid:4>", Content_Type="application/http")]


def package(path, index=True, whole=False):
    """Two WARC members, the second one not packed; an index of the first one's response and revisit, in any order."""
    data, lines = b"", []
    for i, r in enumerate(FIRST):
        packed = gzip.compress(r)
        if i in (1, 3):
            place = {"filename": "first.warc.gz", "offset": len(data), "length": str(len(packed))}
            lines.insert(0, f"example,a)/x 2024 {json.dumps(place)}")
        data += packed
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
        archive.writestr("datapackage.json", "{}")
        archive.writestr("archive/first.warc.gz", gzip.compress(b"".join(FIRST)) if whole else data)
        if index:
            archive.writestr("indexes/index.cdxj", "!meta 0 {}\n" + "\n".join(lines) + "\n")
        archive.writestr("archive/second.warc", b"".join(SECOND))
    with fs.LocalFileSystem().open_output_stream(path) as file:
        file.write(out.getvalue())


@pytest.mark.parametrize(("index", "whole"), [(True, False), (False, False), (False, True)])
def test_package_of_another_writer(spark, index, whole):
    folder = shared_path(spark, "given")
    store, base = store_of(folder)
    store.create_dir(base, recursive=True)
    package(f"{base}/by-hand.wacz", index, whole)
    got = warc.read(spark.createDataFrame([(f"{base}/by-hand.wacz",)], "path string"), folder).collect()
    found = {r.record_id: (r.page_id, r.payload_bytes, r.record_type, r.url, r.refers_to_id) for r in got}
    assert found == {
        "<urn:uuid:1>": (None, 10, "response", "http://a.example/x", None),
        "<urn:uuid:2>": (None, None, "revisit", None, "<urn:uuid:1>"),
        "<urn:uuid:3>": (None, 5, "resource", None, None),
        "<urn:uuid:4>": (None, 10, "response", None, None),
    }
    digests = {r.record_id: r.payload_digest for r in got}
    assert digests["<urn:uuid:1>"] == digests["<urn:uuid:2>"] == DIGEST
    assert digests["<urn:uuid:4>"] == warc.base64.b32encode(warc.hashlib.sha1(b"<p>two</p>").digest()).decode()


def test_index_of_own_packages(spark):
    rows = [(3, "http://b.example/Path?q=1", "x"), (1, "https://www.a.example", "y"), (2, None, "x"), (4, "no url at all", None)]
    folder = shared_path(spark, "own")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    (path,) = (r.path for r in warc.write(pages, folder).collect())
    with zipfile.ZipFile(path) as archive:
        lines = archive.read("indexes/index.cdxj").decode().splitlines()
        data = archive.read("archive/data.warc.gz")
        assert archive.testzip() is None
    assert lines == sorted(lines) and len(lines) == 4
    assert {line.split(" ", 2)[0] for line in lines} >= {"example,b)/path?q=1", "example,a,www)/"}
    for line in lines:
        key, time, entry = line.split(" ", 2)
        place = json.loads(entry)
        assert time == "20240101000000" and place["filename"] == "data.warc.gz"
        part = data[int(place["offset"]) : int(place["offset"]) + int(place["length"])]
        assert gzip.decompress(part).startswith(b"WARC/1.1")
    assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.read(spark.createDataFrame([(path,)], "path string"), folder).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("revisit", 2), 4: ("response", None)}


@pytest.mark.parametrize(("url", "key"), [("http://[::1", "http://%5B::1"), ("", ")/"), ("http://a.b/c d", "b,a)/c%20d"), ("HTTP://A.B:80/", "b,a)/")])
def test_sort_key(url, key):
    assert warc.sort_key(url) == key
