"""The Golay code, the ZIP reader, components and tokens on their own."""

import io
import zipfile
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corvane.llm import golay, packing, tokens, warc, zip_reader
from corvane.llm.graph import LEADERS, bucket_components, components
from corvane.llm.queries import tokenizer_path

WORDS = st.integers(0, (1 << golay.LENGTH) - 1)
BITS = st.integers(0, golay.LENGTH - 1)


@settings(max_examples=60, deadline=None)
@given(WORDS, BITS, BITS)
def test_near_words_share_codewords(word, a, b):
    other = word ^ (1 << a)
    near = {int(x) for x in golay.near(np.array([word]))[0] if x >= 0}
    assert len(near) in (1, golay.NEAR)
    assert int(golay.decoded(np.array([word]))[0]) in near
    assert int(golay.decoded(np.array([other]))[0]) in near
    assert near & {int(x) for x in golay.near(np.array([other ^ (1 << b)]))[0] if x >= 0}


def opened(data):
    return lambda at, n: data[at : at + n]


def test_zip64_directory():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for i in range(66_000):
            archive.writestr(f"m{i}", f"v{i}")
        archive.comment = b"PK\5\6 in a comment"
    data = out.getvalue()
    found = zip_reader.members(opened(data), len(data))
    assert len(found) == 66_000
    at = zip_reader.start_of(opened(data), found[-1])
    assert data[at : at + found[-1].size] == b"v65999"


def test_zip_member_that_is_not_stored():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("x", "y" * 100)
    data = out.getvalue()
    with pytest.raises(ValueError, match="compressed"):
        zip_reader.start_of(opened(data), zip_reader.members(opened(data), len(data))[0])
    with pytest.raises(ValueError, match="not a ZIP"):
        zip_reader.members(opened(b"x" * 100), 100)


def test_broken_payload_is_found():
    good = warc.record(1, "http://a/", b"payload", "A" * 32, None, False)
    with pytest.raises(ValueError, match="payload"):
        warc.parsed(good)


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 3), (3, 9), (7, 7), (-4, 9), (20, 21), (21, 20)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(100, 161), 100), **dict.fromkeys((5, 3, 9, -4), -4), 20: 20, 21: 20}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("by_window", [False, True])
@pytest.mark.parametrize("size", [2, 3, 5, 9, 3 * LEADERS - 1])
def test_all_links_of_a_bucket(spark, size, by_window):
    members = [(key, 100 * key + node, 0) for key in range(20) for node in range(size)]
    frame = spark.createDataFrame(members, "key long, node long, sign long")
    halves = lambda ids: ids.select("node", (ids["node"] % 2).alias("body"))
    got = bucket_components(frame, None, halves, lambda a, b: a == b, by_window=by_window).collect()
    want = {(node, 100 * key + node % 2) for key, node, _ in members if (size - 1 - node % 2) // 2}
    assert {(r.node, r.component) for r in got} == want


@cache
def reference():
    return Tokenizer.from_file(tokenizer_path())


TEXTS = st.text(st.sampled_from("abcXYZ'sdlvemrt 019 \n\t.,!<|>éÉßÀŸİΣςﬁ中́½² ​😀endoftext"), max_size=40)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_tokens_are_the_tokenizers(text):
    texts = [text, "", text[:7], "the end, it's 42", text + "x"]
    ids, sizes = tokens.encoder(tokenizer_path())(pa.array(texts))
    parts = np.split(ids, np.cumsum(sizes)[:-1])
    assert [p.tolist() for p in parts] == [reference().encode(t, add_special_tokens=False).ids for t in texts]


def plain_differencing(sizes, k):
    """The same merges as packing.differencing, one by one, with lists of the sizes behind every sum."""
    parts = [sorted([(size, [i]), *[(0, [])] * (k - 1)], key=lambda x: -x[0]) for i, size in enumerate(sizes)]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[-1][0] - p[0][0])
        n = max(1, int(len(parts) * packing.MERGED / 2))
        merged = []
        for a, b in zip(parts[: 2 * n : 2], parts[1 : 2 * n : 2], strict=True):
            merged.append(sorted([(x + y, u + v) for (x, u), (y, v) in zip(a, b[::-1], strict=True)], key=lambda x: -x[0]))
        parts = merged + parts[2 * n :]
    return {i: w for w, (_, members) in enumerate(parts[0] if parts else []) for i in members}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=40), st.integers(1, 9))
def test_differencing(sizes, k):
    got = packing.differencing(np.array(sizes, dtype=np.int64), k)
    assert dict(enumerate(got.tolist())) == plain_differencing(sizes, k)
