"""Runs of words against a plain search by every period, and words appended in any parts."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from corvane.llm import periodic_runs
from corvane.llm.periodic_runs import EXPONENT, LENGTH, Catchers

SMALL = "/root/testdata/sf0.001"


def plain_runs(words):
    """For every period, from the least on, the stretches of words that equal those a period later."""
    words, found = np.array(words), {}
    for period in range(1, len(words) // EXPONENT + 1):
        differ = np.nonzero(words[:-period] != words[period:])[0]
        bounds = np.concatenate([[-1], differ, [len(words) - period]])
        for a, b in zip(bounds[:-1] + 1, bounds[1:] + period, strict=True):
            if b - a >= max(LENGTH, EXPONENT * period):
                found.setdefault((int(a), int(b)), period)
    return sorted(((a, b - a, p) for (a, b), p in found.items()), key=lambda r: (r[0], r[2]))


def repeated(parts):
    return [w for base, times, more in parts for w in base * times + base[: more % len(base)]]


PARTS = st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=30), st.sampled_from([1, 1, 2, 3, 4, 9, 30]), st.integers(0, 99)), max_size=6)


@settings(max_examples=200, deadline=None)
@given(PARTS, st.lists(st.integers(1, 40), min_size=1, max_size=40))
def test_catchers(parts, cuts):
    words = np.array(repeated(parts), dtype=np.int64)
    whole, by_parts = Catchers(len(words)), Catchers()
    whole.append(words)
    at = 0
    while at < len(words):
        for cut in cuts:
            by_parts.append(words[at : at + cut])
            at += cut
            assert by_parts.runs() == plain_runs(words[:at])
    assert whole.runs() == plain_runs(words)


def test_word_by_word():
    words = repeated([([1, 2, 3, 4, 5], 9, 3), ([7], 40, 0), (list(range(40)), 4, 11), ([7, 8], 12, 1)])
    catchers = Catchers()
    for i, word in enumerate(words):
        catchers.append(np.array([word]))
        assert catchers.runs() == plain_runs(words[: i + 1])


def test_words_whose_sums_of_powers_agree():
    """The Thue-Morse sequence, on which polynomials modulo 2^64 agree for different words, holds no cube."""
    words = [0]
    while len(words) < 8192:
        words += [1 - w for w in words]
    catchers = Catchers()
    catchers.append(np.array(words + words[:3000] * 4))
    assert catchers.runs() == plain_runs(words + words[:3000] * 4)


@pytest.mark.parametrize("word", [[1], [1, 2, 3], list(range(500))])
def test_long_run(word):
    catchers = Catchers()
    catchers.append(np.array([*word * (300_000 // len(word)), -1]))
    assert catchers.runs() == [(0, 300_000 // len(word) * len(word), len(word))]


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a, period = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % period] for i, w in enumerate(words)]
    codes = {w: i for i, w in enumerate(dict.fromkeys(words))}
    runs = plain_runs([codes[w] for w in words])
    dropped = {i for start, length, period in runs for i in range(start + period, start + length)}
    collapsed = " ".join(w for i, w in enumerate(words) if i not in dropped)
    top = None
    for r in runs:
        if top is None or r[1] * top[2] > top[1] * r[2]:
            top = r
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return doc_id, len(runs), *best, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(collapsed)


@pytest.mark.parametrize("sf_dir", [SMALL])
def test_query(spark, sf_dir):
    want = [expected(*r) for r in duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet' ORDER BY doc_id").fetchall()]
    got = entry.queries()["op11_periodic_runs"](spark, sf_dir)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect())) == want
    assert sum(r[1] > 0 for r in want) > len(want) // 20


def test_edges(spark):
    rows = [
        (1, None, "x"),
        (2, "", "x"),
        (3, " \t\n\x0b ", "x"),
        (None, "a b " * 30, None),
        (None, None, None),
        (4, "no space \x1c here 　", "x"),
        (5, " lead  and   trail ", "x"),
        (5, " lead  and   trail ", "x"),
        (6, "x y z " * 100_000, "x"),
        (7, "a " * 24, "x"),
        (7, "a " * 23, "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(3)
    got = periodic_runs.digests(periodic_runs.periodic_runs(docs)).collect()
    plain = lambda i, t: expected(None, t)[1:]  # noqa: E731  crc32 of "None" is not a multiple of ten
    assert zlib.crc32(b"None") % 10
    small = sorted((tuple(r) for r in got if r.doc_id != 6), key=str)
    assert small == sorted(((i, *plain(i, t)) for i, t, _ in rows if i != 6), key=str)
    (long,) = (r for r in got if r.doc_id == 6)
    assert (long.n_runs, long.start, long.length, long.period) == (1, 0, 300_000, 3)
    texts = {r.doc_id: r.collapsed for r in periodic_runs.periodic_runs(docs).collect()}
    assert texts[6] == "x y z" and texts[5] == "lead and trail"
    tails = periodic_runs.with_periodic_tails(docs).collect()
    assert sum(r.doc_id is None for r in tails) == 2 and len(tails) == len(rows)
    assert periodic_runs.digests(periodic_runs.periodic_runs(docs.limit(0))).collect() == []
