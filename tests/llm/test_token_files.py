"""Codes against the best ones, files against the tokenizer, and broken files."""

import heapq
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs
from tokenizers import Tokenizer

import __spark_entry__ as entry
from corvane.llm import huffman, token_files
from corvane.llm.common import shared_path
from corvane.llm.queries import tokenizer_path

MIDDLE = "/root/testdata/sf0.01"
COUNTS = st.lists(st.integers(0, 2000), max_size=40)


def best_cost(counts):
    """Bits of all ids under a Huffman code without limit: the sums of all merges."""
    heap = [c for c in counts if c]
    heapq.heapify(heap)
    total = sum(heap) if len(heap) == 1 else 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        total += both
        heapq.heappush(heap, both)
    return total


@settings(max_examples=150, deadline=None)
@given(COUNTS)
def test_code_lengths(counts):
    counts = np.array(counts, dtype=np.int64)
    lengths = huffman.code_lengths(counts)
    assert ((lengths > 0) == (counts > 0)).all()
    assert int((lengths.astype(np.int64) * counts).sum()) == best_cost(counts.tolist())
    if np.count_nonzero(counts) > 1:
        assert sum(Fraction(1, 1 << int(n)) for n in lengths if n) == 1


def test_limit():
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55], dtype=np.int64)
    best = {3: None}
    for limit in (4, 5, 6, 9):
        lengths = huffman.code_lengths(counts, limit)
        assert lengths.max() <= limit and sum(Fraction(1, 1 << int(n)) for n in lengths) == 1
        best[limit] = int((lengths * counts).sum())
    assert best[4] >= best[5] >= best[6] >= best[9] == best_cost(counts.tolist())
    # by hand: of ten ids in four bits at most, 2^4 places, six ids can be shorter only by dropping others to four bits
    assert best[4] == min(cost for cost in limited_costs(counts.tolist(), 4))
    with pytest.raises(ValueError, match="bits at most"):
        huffman.code_lengths(counts, 3)


def limited_costs(counts, limit):
    """The costs of all non-increasing lengths for ascending counts that fill the code exactly."""

    def lengths(i, most, room):
        if i == len(counts):
            if room == 0:
                yield 0
            return
        for n in range(1, most + 1):
            if room >= 1 << (limit - n):
                for rest in lengths(i + 1, n, room - (1 << (limit - n))):
                    yield rest + n * counts[i]

    return lengths(0, limit, 1 << limit)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 2, 3, 7, 200, 49_000]), max_size=900), st.integers(0, 900))
def test_round_trip_of_ids(ids, cut):
    ids = np.array(ids, dtype=np.uint32)
    code = huffman.canonical(huffman.code_lengths(np.bincount(ids, minlength=3)))
    data, checkpoints = huffman.encoded(ids, code)
    counts = np.full(len(checkpoints), huffman.CHECKPOINT)
    counts[-1:] = len(ids) - huffman.CHECKPOINT * (len(checkpoints) - 1)
    assert huffman.decoded(data, checkpoints, counts, code).tolist() == ids.tolist()
    if len(checkpoints):
        # from one checkpoint alone
        i = cut % len(checkpoints)
        assert huffman.decoded(data, checkpoints[i : i + 1], counts[i : i + 1], code).tolist() == ids[i * huffman.CHECKPOINT :][: counts[i]].tolist()


def test_ids_without_code():
    code = huffman.canonical(huffman.code_lengths(np.array([0, 5])))
    with pytest.raises(ValueError, match="no code"):
        huffman.encoded(np.array([0]), code)
    with pytest.raises(ValueError, match="not a coded id"):
        huffman.decoded(b"\xff" * 8, np.array([0]), np.array([3]), code)


def expected(docs, end_id=2):
    tokenizer, at, out = Tokenizer.from_file(tokenizer_path()), 0, []
    for doc_id, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end_id], dtype="<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").orderBy("doc_id").collect()]
    got = entry.queries()["op13_token_files"](spark, MIDDLE)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == expected(docs)


def test_edges(spark, monkeypatch):
    for name, value in (("BLOCK_IDS", 40), ("RANGE_IDS", 90), ("FILE_IDS", 200)):
        monkeypatch.setattr(token_files, name, value)
    long = "one two three four five " * 20_000
    rows = [(5, "five"), (1, None), (2, ""), (3, long), (-7, "minus"), (None, "none"), (None, None), (4, " \t"), (4, " \t"), (9, "Ünïcödé 中文 😀"), *((100 + i, "some words here " * 9) for i in range(40))]
    docs = spark.createDataFrame([(*r, "?", "?") for r in rows], "doc_id long, text string, ids string, place string").repartition(3)
    folder = shared_path(spark, "tokens")
    token_files.write(docs, folder, tokenizer_path())
    found = token_files.checksums(token_files.read(spark, folder)).collect()
    key = lambda r: r[1]
    got = sorted(map(tuple, found), key=key)
    assert got[:-2] == expected(sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]))
    assert sorted(r[2] for r in got[-2:]) == sorted(r[2] for r in expected([(None, None), (None, "none")]))
    assert [r[0] for r in got[-2:]] == [None, None] and sum(r[2] for r in got) == got[-1][1] + got[-1][2]
    assert spark.read.parquet(f"{folder}/files").agg({"documents": "sum"}).first()[0] == len(rows)
    assert token_files.round_trip(docs.limit(0), tokenizer_path()).collect() == []


def test_broken_file(spark):
    docs = spark.createDataFrame([(i, f"some words of {i} " * 50) for i in range(20)], "doc_id long, text string").coalesce(1)
    folder = shared_path(spark, "tokens")
    token_files.write(docs, folder, tokenizer_path())
    path = spark.read.parquet(f"{folder}/files").first().path
    store = fs.LocalFileSystem()
    with store.open_input_file(path) as file:
        data = bytearray(file.read())
        code = token_files.code_of(file)
    assert code.limit == huffman.LIMIT
    data[len(data) // 2] ^= 1
    with store.open_output_stream(path) as out:
        out.write(bytes(data))
    with pytest.raises(Exception, match="checksum"):
        token_files.read(spark, folder).collect()
    with store.open_output_stream(path) as out:
        out.write(bytes(data[:-1]))
    with pytest.raises(Exception, match="whole file"):
        token_files.read(spark, folder).collect()
