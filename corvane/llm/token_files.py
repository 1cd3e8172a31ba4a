"""Token ids of whole corpora in binary files, by a canonical length-limited Huffman code of global counts.

Every text is tokenised once, where it is read, and its ids are kept. Their counts over all documents,
one row for each id of the vocabulary, give the code; only its lengths are stored, in every file, so
that each can be read on its own. The documents are sorted into ranges of ids, and each task writes its
range, in order, as files of blocks.

A file: the mark, the code's lengths (their packed size, then zlib), blocks, the table of blocks (first
byte, ids before it), its number of blocks and ids, its first byte, the mark. A block holds whole documents, has
no need of any other, and is read from all its checkpoints at once: its header (documents, ids,
checkpoints, bytes of coded ids, CRC-32 of what follows), the documents' ids, whether they have one, and their sizes, the
checkpoints' first bits, the coded ids. All numbers are little-endian.

The list of files is written last and has those of finished tasks only, so what lost or repeated tasks
leave is never read. The folder is one that driver and executors share.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm import huffman
from corvane.llm.common import batches_of, only, partitions, ready, saved, shared_path, store_of, text_of
from corvane.llm.tokens import encoder, vocabulary_size

END_ID = 2
MARK = b"CRVTOK1\0"
HEADER, TAIL = "<5Q", "<3Q8s"
#: Ids of a block, from which on it is closed; of a range that a task reads; and of a file.
BLOCK_IDS, RANGE_IDS, FILE_IDS = 1 << 16, 1 << 20, 1 << 28
FILES = "part int, nth int, path string, documents long, ids long"


def _ids_of(path: str, end_id: int, kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow: (doc_id, text) to (doc_id, ids, check), the end id included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for a, b in batches_of(batch.column(1)):
                ids, sizes = encode(batch.column(1).slice(a, b - a))
                out = np.full(len(ids) + len(sizes), end_id, dtype=kind)
                out[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)] = ids
                width = out.itemsize
                ends = np.cumsum(sizes + 1) * width
                data = memoryview(out).cast("B")
                coded = [data[x:y].tobytes() for x, y in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
                columns = [batch.column(0).slice(a, b - a), pa.array(coded, pa.binary()), pa.array([zlib.crc32(x) for x in coded], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "check"])

    return run


def _flat(ids: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of them, and the number of each row's."""
    rows = ids.to_pylist()
    return np.frombuffer(b"".join(rows), dtype=kind), np.array([len(x) for x in rows], dtype=np.int64) // np.dtype(kind).itemsize


def _counted(kind: str, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow: the ids of a task's documents to one row for each id that occurs in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, dtype=np.int64)
        for batch in batches:
            counts += np.bincount(_flat(batch.column(0), kind)[0], minlength=size)
        used = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["id", "n"])

    return run


def global_counts(coded: DataFrame, kind: str, size: int) -> np.ndarray:
    """How often each id of the vocabulary occurs in all documents: as many numbers as the vocabulary has ids."""
    found = coded.select("ids").mapInArrow(_counted(kind, size), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(size, dtype=np.int64)
    for id_, n in found:
        counts[id_] = n
    return counts


def _block(docs: list[tuple[int | None, int]], ids: np.ndarray, code: huffman.Code) -> bytes:
    data, checkpoints = huffman.encoded(ids, code)
    body = b"".join(
        (
            np.array([doc or 0 for doc, _ in docs], dtype="<i8").tobytes(),
            np.array([doc is not None for doc, _ in docs], dtype="u1").tobytes(),
            np.array([n for _, n in docs], dtype="<u8").tobytes(),
            checkpoints.astype("<u8").tobytes(),
            data,
        )
    )
    return struct.pack(HEADER, len(docs), len(ids), len(checkpoints), len(data), zlib.crc32(body)) + body


def _blocks(batches: Iterator[pa.RecordBatch], kind: str, code: huffman.Code) -> Iterator[tuple[int, int, bytes]]:
    """Documents, ids and bytes of blocks of whole documents, in order."""
    docs: list[tuple[int | None, int]] = []
    held: list[bytes] = []
    total = 0

    def block() -> tuple[int, int, bytes]:
        return len(docs), total, _block(docs, np.frombuffer(b"".join(held), dtype=kind), code)

    for batch in batches:
        for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            held.append(ids.as_py())
            docs.append((doc, len(held[-1]) // np.dtype(kind).itemsize))
            total += docs[-1][1]
            if total >= BLOCK_IDS:
                yield block()
                docs, held, total = [], [], 0
    if docs:
        yield block()


def _write(folder: str, kind: str, lengths: bytes, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow: sorted documents to files; gives each file's place in the order, path and numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(folder)
        code = huffman.canonical(np.frombuffer(lengths, dtype=np.uint8), limit)
        packed = zlib.compress(lengths)
        rest, part = _blocks(batches, kind, code), TaskContext.get().partitionId()
        following, nth = next(rest, None), 0
        while following is not None:
            path = f"{base}/{part:06d}-{nth:06d}-{uuid.uuid4().hex}.tok"
            documents, ids, table = 0, 0, []
            with store.open_output_stream(path) as out:
                out.write(MARK + struct.pack("<2Q", len(packed), limit) + packed)
                while following is not None and ids < FILE_IDS:
                    table += [out.tell(), ids]
                    out.write(following[2])
                    documents, ids = documents + following[0], ids + following[1]
                    following = next(rest, None)
                first = out.tell()
                out.write(np.array(table, dtype="<u8").tobytes() + struct.pack(TAIL, len(table) // 2, ids, first, MARK))
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "nth": pa.array([nth], pa.int32()), "path": [path], "documents": [documents], "ids": [ids]})
            nth += 1

    return run


def write(docs: DataFrame, folder: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, limit: int = huffman.LIMIT) -> None:
    """Writes the ids of every document, each ended by ``end_id``, to ``folder`` in ascending order of doc_id.

    A null or empty text is the end id alone. A null id comes after all others. Rows that repeat are
    written as often as they occur, those of one id by their ids' CRC-32. An empty table has a list without files. Other columns are ignored.
    """
    spark = docs.sparkSession
    size = max(vocabulary_size(tokenizer_path), end_id + 1)
    kind = "<u2" if size <= 1 << 16 else "<u4"
    named = only(docs, doc_id=F.col(id_col).cast("long"), text=text_of(text_col))
    coded = shared_path(spark, "ids")
    named.mapInArrow(_ids_of(tokenizer_path, end_id, kind), "doc_id long, ids binary, check long").write.option("compression", "zstd").parquet(coded)
    rows = spark.read.parquet(coded)
    lengths = huffman.code_lengths(global_counts(rows, kind, size), limit)
    # rows of one id are parted too, by where they were read
    key = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("check"), F.col("place")]
    ordered = rows.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(partitions(spark), *key).sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "check")
    store, base = store_of(f"{folder}/data")
    store.create_dir(base, recursive=True)
    files = ordered.select("doc_id", "ids").mapInArrow(_write(f"{folder}/data", kind, lengths.tobytes(), limit), FILES)
    files.write.parquet(f"{folder}/files")


def _ranges(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow: (path, start) of files to ranges of their blocks: path, first byte, bytes, ids before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(folder)
        for batch in batches:
            for path, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_file(path) as file:
                    blocks, ids, first, mark = struct.unpack(TAIL, file.read_at(struct.calcsize(TAIL), file.size() - struct.calcsize(TAIL)))
                    if mark != MARK:
                        raise ValueError(f"{path} is not a whole file of ids")
                    table = np.frombuffer(file.read_at(16 * blocks, first), dtype="<u8").astype(np.int64).reshape(-1, 2)
                begin = np.unique(table[:, 1] // RANGE_IDS, return_index=True)[1]
                ends = np.append(table[begin[1:], 0], first)
                columns = [pa.array([path] * len(begin)), pa.array(table[begin, 0]), pa.array(ends - table[begin, 0]), pa.array(table[begin, 1] + before)]
                yield pa.RecordBatch.from_arrays(columns, ["path", "first", "bytes", "start"])

    return run


def code_of(file: pa.NativeFile) -> huffman.Code:
    """The code of an open file."""
    mark, size, limit = struct.unpack("<8s2Q", file.read_at(24, 0))
    if mark != MARK:
        raise ValueError("not a file of ids")
    return huffman.canonical(np.frombuffer(zlib.decompress(file.read_at(size, 24)), dtype=np.uint8), limit)


def documents_of(data: bytes, code: huffman.Code) -> Iterator[tuple[int | None, np.ndarray]]:
    """The documents of blocks that lie one after another."""
    at = 0
    while at < len(data):
        docs, ids, checkpoints, size, crc = struct.unpack_from(HEADER, data, at)
        at += struct.calcsize(HEADER)
        end = at + 17 * docs + 8 * checkpoints + size
        if zlib.crc32(memoryview(data)[at:end]) != crc:
            raise ValueError("a block is not what its checksum says")
        doc_ids = np.frombuffer(data, "<i8", docs, at).tolist()
        has_id = np.frombuffer(data, "u1", docs, at + 8 * docs).tolist()
        sizes = np.frombuffer(data, "<u8", docs, at + 9 * docs).astype(np.int64)
        starts = np.frombuffer(data, "<u8", checkpoints, at + 17 * docs)
        counts = np.full(checkpoints, huffman.CHECKPOINT, dtype=np.int64)
        counts[-1:] = ids - huffman.CHECKPOINT * (checkpoints - 1)
        found = huffman.decoded(data[end - size : end], starts, counts, code)
        for doc, has, part in zip(doc_ids, has_id, np.split(found, np.cumsum(sizes)[:-1]), strict=True):
            yield (doc if has else None), part
        at = end


def _read(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow: ranges to their documents: doc_id, start, ids as little-endian numbers of 32 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(folder)
        last, code = b"", None
        for batch in batches:
            for path, first, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_file(path) as file:
                    head = file.read_at(24 + struct.unpack("<Q", file.read_at(8, 8))[0], 0)
                    if head != last:
                        last, code = head, code_of(file)
                    data = file.read_at(size, first)
                docs, parts = zip(*documents_of(data, code), strict=True)
                sizes = np.array([len(p) for p in parts])
                columns = [pa.array(docs, pa.int64()), pa.array(start + np.cumsum(sizes) - sizes), pa.array([p.astype("<u4").tobytes() for p in parts], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "ids"])

    return run


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (the ids of all documents before it) and ids (binary, little-endian, 32 bits each) of every document of a folder.

    The files' places in the order come from their list, one row a file; the blocks are dealt out in ranges of some million ids.
    """
    ready(spark)
    n = partitions(spark)
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = saved(spark.read.parquet(f"{folder}/files").select("path", before.alias("start")))
    ranges = files.repartition(n, "path").mapInArrow(_ranges(folder), "path string, first long, bytes long, start long")
    return ranges.repartition(n, "path", "first").mapInArrow(_read(folder), "doc_id long, start long, ids binary")


def round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Writes all documents to a new shared folder and reads them back as ``read`` does."""
    folder = shared_path(docs.sparkSession, "tokens")
    write(docs, folder, tokenizer_path, id_col, text_col, end_id)
    return read(docs.sparkSession, folder)


def checksums(read_back: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of the documents that ``read`` gives."""
    return read_back.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
