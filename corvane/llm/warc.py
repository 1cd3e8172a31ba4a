"""WARC records in ZIP-packaged archives, written and read back by Spark tasks.

Each task writes archives of its own: a ZIP file whose stored members are the WARC (a gzip member
for each record) and an index, a line a record with its url's sort key, time, and offset and length. Reading begins at the
central directory, finds the WARC members and the indexes, and deals out ranges of records; each range is
one read, and nothing is extracted. Packages of other writers may hold several WARC members, records of any
kind and header names in any case; a member that no index lists is read through, record by record.

Only archives that a finished task has reported are read, so those of lost or repeated tasks do no
harm. The folder is one that driver and executors share.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import zip_reader
from corvane.llm.common import only, partitions, saved, shared_path, small, store_of, text_of

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Records and bytes of one archive, and bytes of one range, at most (a record is never cut).
ARCHIVE_RECORDS = 50_000
ARCHIVE_BYTES = 256 << 20
RANGE_BYTES = 1 << 20
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
# Fixed values of the format: the profile of revisits; kinds of records that hold or name a payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
KINDS = frozenset(["response", "revisit", "resource", "conversion"])
COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string, date string, refers_to_id string"
RANGES = "path string, member string, start long, bytes long, offsets array<long>, lengths array<long>"
RECORD_SCHEMA = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in RECORDS.split(", ")])


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _id(name: str | None) -> int | None:
    """The page of a record that this module wrote; None for others."""
    text = name[len("<urn:page:") : -1] if name and name.startswith("<urn:page:") else "none"
    return None if text == "none" else int(text)


def sort_key(url: str) -> str:
    """The url for the index: its host's labels from the last to the first, then its path, in lower case, without white space."""
    try:
        parts = urlsplit(url)
        host = ",".join(reversed((parts.hostname or "").split(".")))
        key = f"{host}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")
    except ValueError:
        key = url
    return quote(key.lower(), safe="/?:=&,;)(~%!$*'+@", errors="replace") or "-"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record. A revisit holds the HTTP header of its response, with the payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe=":/?#[]@!$&'()*+,;=%~", errors="replace"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    """The headers below the first line, by their names in lower case."""
    lines = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, colon, value in lines if colon}


def parsed(data: bytes) -> tuple | None:
    """The columns of ``RECORDS`` for a record of ``KINDS``, None for others; a payload is verified by its digest, if it has one.

    The payload is what follows the HTTP header, or the whole block of a record without one. Without digest, or with one that is not
    SHA-1, it is computed; a revisit holds no payload, so what its headers do not say is null.
    """
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    kind = fields.get("warc-type", "")
    if kind not in KINDS:
        return None
    block = rest[: int(fields["content-length"])]
    payload, length = block, None
    if fields.get("content-type", "").lower().startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        said = _fields(http).get("content-length", "")
        length = int(said) if said.isdigit() else None
    given = fields.get("warc-payload-digest", "")
    digest = given[5:].upper() if given.lower().startswith("sha1:") else None
    if kind != "revisit":
        own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if digest not in (None, own):
            raise ValueError(f"the payload of {fields.get('warc-record-id')} is not what its digest says")
        digest, length = own, len(payload)
    refers = fields.get("warc-refers-to") if kind == "revisit" else None
    own_id = fields.get("warc-record-id")
    return _id(own_id), length, digest, kind, _id(refers), own_id, fields.get("warc-target-uri"), fields.get("warc-date"), refers


def records_of(data: bytes) -> Iterator[bytes]:
    """The records that lie one after another in unpacked data."""
    at = 0
    while data.startswith(b"WARC/", at):
        end = data.index(b"\r\n\r\n", at)
        size = end + 4 + int(_fields(data[at:end])["content-length"])
        yield data[at:size]
        at = size
        while data.startswith(b"\r\n", at):
            at += 2


def unpacked(read: Callable[[int, int], bytes], start: int, size: int) -> Iterator[bytes]:
    """The records of a whole WARC member, gzip or not; of it, one gzip member at a time is held."""
    if read(start, 2) != b"\x1f\x8b":
        yield from records_of(read(start, size))
        return
    at, rest = start, b""
    while rest or at < start + size:
        packer, parts = zlib.decompressobj(31), []
        while not packer.eof and (rest or at < start + size):
            if not rest:
                rest = read(at, min(RANGE_BYTES, start + size - at))
                at += len(rest)
            parts.append(packer.decompress(rest))
            rest = packer.unused_data
        yield from records_of(b"".join(parts))


def _gzipped(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def index_line(url: str | None, name: str, digest: str, offset: int, length: int) -> str:
    """A line of the index: sort key, time, and the record's place in its WARC member as JSON."""
    entry = {"url": url or name, "digest": f"sha1:{digest}", "mime": "text/html", "filename": DATA.split("/")[-1], "offset": str(offset), "length": str(length)}
    return f"{sort_key(url or name)} {''.join(c for c in DATE if c.isdigit())} {json.dumps(entry)}"


def _write(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow: rows to archives; gives each archive's path and number of records."""
    info = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:page:none>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n\r\n"

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, str, str, bytes]]:
        for batch in batches:
            for page_id, url, html, sha1, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                payload = html.encode("utf-8", "replace")
                yield url, _name(page_id), digest, _gzipped(record(page_id, url, payload, digest, refers_to, revisit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(folder)
        rest = records(batches)
        following = next(rest, None)
        while following is not None:
            path, index = f"{base}/{uuid.uuid4().hex}.wacz", []
            with store.open_output_stream(path) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
                with archive.open(DATA, "w", force_zip64=True) as member:
                    at = member.write(_gzipped(info.encode()))
                    while following is not None and len(index) < ARCHIVE_RECORDS and at < ARCHIVE_BYTES:
                        url, name, digest, data = following
                        index.append(index_line(url, name, digest, at, len(data)))
                        at += member.write(data)
                        following = next(rest, None)
                archive.writestr(INDEX, "".join(f"{line}\n" for line in sorted(index)))
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [len(index)]})

    return run


def write(pages: DataFrame, folder: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record for every row; gives path and number of records of each archive.

    Of records with equal payloads of at least ``min_bytes`` the one with the smallest page_id is a
    response (each of them, if rows repeat), the others revisit it. Only digests that several rows have are joined to the
    rows: they are broadcast if they are few, so that no page is shuffled, and else adaptive execution splits a frequent one.
    """
    html = text_of(html_col)
    rows = only(pages, page_id=F.col(id_col).cast("long"), url=F.col(url_col), html=html, sha1=F.sha1(html.cast("binary")))
    known = only(pages, page_id=F.col(id_col).cast("long"), sha1=F.sha1(html.cast("binary")))
    first = known.groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    first = small(saved(first.filter("n > 1")))
    again = F.col("n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")) & (F.octet_length("html") >= min_bytes)
    store, base = store_of(folder)
    store.create_dir(base, recursive=True)
    found = rows.join(first, "sha1", "left")
    ready = found.select("page_id", "url", "html", "sha1", "first_id", again.alias("revisit"))
    return saved(ready.mapInArrow(_write(folder), "path string, records long"))


def index_of(text: str) -> dict[str, list[tuple[int, int]]]:
    """By the name of a WARC member the offsets and lengths of its records, ascending, from the lines of an index."""
    found: dict[str, list[tuple[int, int]]] = {}
    for line in text.split("\n"):
        brace = line.find("{")
        if brace < 0 or line.startswith("!"):
            continue
        entry = json.loads(line[brace:])
        if "offset" in entry and "length" in entry:
            found.setdefault(entry.get("filename", "").split("/")[-1], []).append((int(entry["offset"]), int(entry["length"])))
    return {name: sorted(set(entries)) for name, entries in found.items()}


def ranges_of(read: Callable[[int, int], bytes], size: int) -> list[dict]:
    """Ranges of records of one package: WARC member, first byte, bytes, and each record's offset and length in it; none of these for a member that is read through."""
    members = zip_reader.members(read, size)
    index: dict[str, list[tuple[int, int]]] = {}
    for m in members:
        if m.name.startswith("indexes/") and m.name.removesuffix(".gz").endswith((".cdxj", ".cdx")):
            data = read(zip_reader.start_of(read, m), m.size)
            text = zlib.decompress(data, 47) if m.name.endswith(".gz") else data
            for name, entries in index_of(text.decode("utf-8", "replace")).items():
                index.setdefault(name, []).extend(entries)
    warcs = [m for m in members if m.name.startswith("archive/") and m.name.removesuffix(".gz").endswith(".warc")]
    found: list[dict] = []
    for m in warcs:
        start = zip_reader.start_of(read, m)
        # an index without file names belongs to the only member
        entries = index.get(m.name.split("/")[-1]) or (index.get("") if len(warcs) == 1 else None)
        if not entries:
            found.append({"member": m.name, "start": start, "bytes": m.size, "offsets": None, "lengths": None})
            continue
        last = None
        for offset, length in sorted(entries):
            if last is None or last["bytes"] >= RANGE_BYTES:
                last = {"member": m.name, "start": start + offset, "bytes": 0, "offsets": [], "lengths": []}
                found.append(last)
            last["offsets"].append(start + offset - last["start"])
            last["lengths"].append(length)
            last["bytes"] = last["offsets"][-1] + length
    return found


def _ranges(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow: paths of archives to ranges of their records."""
    kinds = {"path": pa.string(), "member": pa.string(), "start": pa.int64(), "bytes": pa.int64(), "offsets": pa.list_(pa.int64()), "lengths": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_file(path) as file:
                    found = ranges_of(lambda at, n, file=file: file.read_at(n, at), file.size())
                rows = [{"path": path} | r for r in found]
                yield pa.RecordBatch.from_pydict({c: pa.array([r[c] for r in rows], t) for c, t in kinds.items()})

    return run


def records_in(read: Callable[[int, int], bytes], start: int, size: int, offsets: list[int] | None, lengths: list[int] | None) -> Iterator[bytes]:
    """The records of a range."""
    if offsets is None:
        yield from unpacked(read, start, size)
        return
    data = read(start, size)
    for at, n in zip(offsets, lengths, strict=True):
        part = data[at : at + n]
        yield zlib.decompress(part, 31) if part[:2] == b"\x1f\x8b" else part


def _read(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(row["path"]) as file:
                    parts = records_in(lambda at, n, file=file: file.read_at(n, at), row["start"], row["bytes"], row["offsets"], row["lengths"])
                    found = [r for r in map(parsed, parts) if r is not None]
                if found:
                    columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), RECORD_SCHEMA.types, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, schema=RECORD_SCHEMA)

    return run


def read(archives: DataFrame, folder: str) -> DataFrame:
    """One row a record of the archives (path) that holds or names a payload: the columns of ``RECORDS``.

    page_id and refers_to are those of records that ``write`` wrote, and null for others. Records of other kinds have no row.
    """
    n = partitions(archives.sparkSession)
    ranges = archives.select("path").repartition(n, "path").mapInArrow(_ranges(folder), RANGES)
    return ranges.repartition(n, "path", "member", "start").mapInArrow(_read(folder), RECORDS)


def round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes archives of all pages to a new shared folder and reads their records back: the first five columns of ``RECORDS``.

    A null page is an empty payload; a null page_id comes after all others; an empty table has no
    archives and no records. Other columns are ignored.
    """
    folder = shared_path(spark, "archives")
    return read(write(pages, folder, min_bytes), folder).select(*COLUMNS)


# Base32 is made of five bits a letter of the SHA-1 in hexadecimal digits.
ORACLE_SQL = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
    SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex FROM p
), b AS (
    SELECT page_id, payload_bytes, hex,
           list_aggregate(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111',
               4 * (strpos('0123456789abcdef', substr(hex, i::INT, 1)) - 1) + 1, 4)), 'string_agg', '') AS bits
    FROM d
), e AS (
    SELECT page_id, payload_bytes,
           list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1
               + 16 * substr(bits, (5 * i + 1)::INT, 1)::INT + 8 * substr(bits, (5 * i + 2)::INT, 1)::INT
               + 4 * substr(bits, (5 * i + 3)::INT, 1)::INT + 2 * substr(bits, (5 * i + 4)::INT, 1)::INT
               + substr(bits, (5 * i + 5)::INT, 1)::INT), 1)), 'string_agg', '') AS payload_digest
    FROM b
), f AS (
    SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM e
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM f
"""
