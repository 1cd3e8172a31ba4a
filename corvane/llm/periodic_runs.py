"""Runs of words that repeat with a period, caught while words are appended.

A catcher watches a completed block of 2^k words: while the words after it are appended, each new
suffix of as many words is compared with the block, at distances from 2^k to 2^(k+1) - 1. A run of such a
period that is long enough to count holds a block and its equal: more than 2^(k+1) of its words in a
row are equal to those a period later. From an equal suffix, a repeat grows to the left at once and to
the right as words come; with ``EXPONENT`` periods and ``LENGTH`` words it is a run. Suffixes within
a known run, at a multiple of its period, say nothing new and are left out.

A call appends any number of words, and each level compares all their suffixes at once, by
differences of prefix hashes. Words can be appended one by one or all together with the same runs; here a
batch of texts is appended together, each followed by a word that is like no other. Hashes only
suggest: the words themselves are compared before a run is reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import SPACE, batches_of, only, text_of

#: Least words and periods of a run.
LENGTH, EXPONENT = 24, 3
#: Words of the smallest blocks. A run of LENGTH words and a period below 16 holds one with its equal.
LEAST_BLOCK = 8
RUNS = "array<struct<start:long,length:long,period:long>>"
#: An odd number and its inverse modulo 2^64.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 64 bits of each number."""
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(29)


def _powers(base: int, first: int, n: int) -> np.ndarray:
    """base to the powers first, first + 1, ... modulo 2^64."""
    steps = np.full(n, base, dtype=np.uint64)
    steps[:1] = pow(base, first, 1 << 64)
    return np.multiply.accumulate(steps)


class Catchers:
    """The runs of a sequence of words, given as numbers, that grows at its end.

    ``longest``: words that a run has at most, if that is known; longer blocks are not watched.
    """

    def __init__(self, longest: int | None = None) -> None:
        self.longest = longest
        self.words = np.empty(0, dtype=np.int64)
        # the sums of the words' hashes times powers of the factor before each place, and the inverse powers
        self._sums, self._inverse = np.zeros(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)
        # the period of each known run by its first word and the word after it; the run's number at its words
        self._found: dict[tuple[int, int], int] = {}
        self._run_at, self._periods = np.empty(0, dtype=np.int64), [0]
        # first word and period of repeats that reach the last word appended
        self._open: set[tuple[int, int]] = set()

    def append(self, words: np.ndarray) -> None:
        """Appends words; equal numbers are equal words."""
        old, n = len(self.words), len(self.words) + len(words)
        self.words = np.concatenate([self.words, words])
        self._run_at = np.concatenate([self._run_at, np.zeros(len(words), dtype=np.int64)])
        sums = np.cumsum(_mixed(words) * _powers(FACTOR, old, len(words)), dtype=np.uint64)
        self._sums = np.concatenate([self._sums, self._sums[-1] + sums])
        self._inverse = np.concatenate([self._inverse, _powers(INVERSE, old + 1, len(words))])
        for left, period in sorted(self._open, key=lambda x: x[1]):
            self._found.pop((left, old), None)
        going, self._open = sorted(self._open, key=lambda x: (x[1], x[0])), set()
        if going:
            lefts, periods = (np.array(x, dtype=np.int64) for x in zip(*going, strict=True))
            self._grown(lefts + periods, periods, lefts)
        size = LEAST_BLOCK
        while size <= n and (self.longest is None or EXPONENT * size <= max(self.longest, EXPONENT * LEAST_BLOCK)):
            starts, periods = self._caught(size, old, n)
            if len(starts):
                run = self._run_at[starts - periods]
                known = (run > 0) & (self._run_at[starts + size - 1] == run)
                known[known] = periods[known] % np.array(self._periods)[run[known]] == 0
                starts, periods = starts[~known], periods[~known]
                lefts = starts - periods - self._equal_before(starts, periods)
                each, first = np.unique(np.stack([periods, lefts], axis=1), axis=0, return_index=True)
                self._grown(starts[first], each[:, 0], each[:, 1])
            size *= 2

    def runs(self) -> list[tuple[int, int, int]]:
        """Start, length and period of every run so far, by start and period."""
        return sorted(((a, b - a, p) for (a, b), p in self._found.items()), key=lambda x: (x[0], x[2]))

    def _hashes(self, starts: np.ndarray, size: int) -> np.ndarray:
        """Of ``size`` words from each start on."""
        return (self._sums[starts + size] - self._sums[starts]) * self._inverse[starts]

    def _caught(self, size: int, old: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of suffixes of ``size`` words, ended by a word from ``old`` on, that equal a block; their distances from it."""
        first, end = max(0, old - size + 1), n - size + 1
        hashes = (self._sums[first + size : n + 1] - self._sums[first:end]) * self._inverse[first:end]
        starts = np.arange(first, end)
        nth, least = starts // size, first // size
        found = []
        for back in (0, 1) if size == LEAST_BLOCK else (1,):
            # the blocks that are watched, from the one before that of the first suffix on
            watched = self._hashes(np.maximum(np.arange(least - back, (end - 1) // size - back + 1), 0) * size, size)
            hit = np.nonzero((watched[nth - least] == hashes) & (nth >= back))[0]
            distance = starts[hit] - (nth[hit] - back) * size
            found.append((starts[hit][distance > 0], distance[distance > 0]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _equal_before(self, starts: np.ndarray, periods: np.ndarray) -> np.ndarray:
        """Words before ``starts`` that equal those a period before them, by hashes."""
        n = np.zeros(len(starts), dtype=np.int64)
        for size in self._sizes():
            low = starts - periods - n - size
            room = np.nonzero(low >= 0)[0]
            low = low[room]
            n[room] += size * (self._hashes(low, size) == self._hashes(low + periods[room], size))
        return n

    def _equal_from(self, starts: np.ndarray, periods: np.ndarray) -> np.ndarray:
        """Words from ``starts`` on that equal those a period before them, by hashes."""
        n = np.zeros(len(starts), dtype=np.int64)
        for size in self._sizes():
            room = np.nonzero(starts + n + size <= len(self.words))[0]
            low = (starts + n)[room]
            n[room] += size * (self._hashes(low, size) == self._hashes(low - periods[room], size))
        return n

    def _sizes(self) -> list[int]:
        """Powers of two, descending: a number of equal words is their sum, each taken at most once."""
        return [1 << k for k in reversed(range(len(self.words).bit_length()))]

    def _grown(self, starts: np.ndarray, periods: np.ndarray, lefts: np.ndarray) -> None:
        """Lets repeats, in the order of their periods, grow to the right; reports runs and keeps what reaches the end."""
        n = len(self.words)
        rights = starts + self._equal_from(starts, periods)
        counts = (rights - lefts >= np.maximum(LENGTH, EXPONENT * periods)) | (rights == n)
        for start, period, left, right in zip(*(x[counts].tolist() for x in (starts, periods, lefts, rights)), strict=True):
            a, b = left, right
            if not np.array_equal(self.words[a : b - period], self.words[a + period : b]):
                # equal hashes of different words: grow by the words alone
                differ = np.nonzero(self.words[period:] != self.words[: n - period])[0] + period
                a = int(max(differ[differ < start], default=period - 1)) + 1 - period
                b = int(min(differ[differ >= start], default=n))
            if b == n:
                self._open.add((a, period))
            if b - a >= max(LENGTH, EXPONENT * period) and self._found.get((a, b), period) >= period:
                self._found[a, b] = period
                self._run_at[a:b] = len(self._periods)
                self._periods.append(period)


def _runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, runs, collapsed)."""
    entry = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    for batch in batches:
        for a, b in batches_of(batch.column(1)):
            words = pc.ascii_split_whitespace(batch.column(1).slice(a, b - a))
            coded = words.flatten().dictionary_encode()
            codes = coded.indices.to_numpy().astype(np.int64)
            empty = pc.index(coded.dictionary, "").as_py()
            doc = np.repeat(np.arange(b - a), pc.list_value_length(words).to_numpy())[codes != empty]
            codes = codes[codes != empty]
            sizes = np.bincount(doc, minlength=b - a)
            firsts = np.cumsum(sizes) - sizes
            # each text is followed by a number of its own
            sequence = np.empty(len(codes) + b - a, dtype=np.int64)
            sequence[np.arange(len(codes)) + doc] = codes
            sequence[np.cumsum(sizes) + np.arange(b - a)] = len(coded.dictionary) + np.arange(b - a)
            catchers = Catchers(int(sizes.max(initial=0)))
            catchers.append(sequence)
            runs = np.array(catchers.runs(), dtype=np.int64).reshape(-1, 3)
            of = np.searchsorted(firsts + np.arange(b - a), runs[:, 0], side="right") - 1
            dropped = np.zeros(len(codes) + 1, dtype=np.int64)
            np.add.at(dropped, runs[:, 0] - of + runs[:, 2], 1)
            np.add.at(dropped, runs[:, 0] - of + runs[:, 1], -1)
            kept = np.cumsum(dropped)[:-1] == 0
            ends = np.concatenate([[0], np.cumsum(np.bincount(doc[kept], minlength=b - a))])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), coded.dictionary.take(pa.array(codes[kept])))
            spans = pa.StructArray.from_arrays([pa.array(x) for x in (runs[:, 0] - (firsts + np.arange(b - a))[of], runs[:, 1], runs[:, 2])], fields=list(entry))
            offsets = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=b - a))])
            columns = [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans), pc.binary_join(lists, " ")]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row: doc_id, runs (start, length and period in words, by start and period), collapsed.

    A run is a stretch of words of smallest period q, of ``LENGTH`` words and ``EXPONENT`` periods at
    least, that no neighbouring word extends. ``collapsed`` has the text's words, joined by one space,
    without those that any run contains after its first period. A null or empty text has no run and
    is empty. Null ids and repeated rows have a row each; an empty table has none. Other columns are
    ignored. Nothing is shuffled; a task holds one text, or some megabytes of shorter ones.
    """
    named = only(docs, doc_id=F.col(id_col).cast("long"), text=text_of(text_col))
    return named.mapInArrow(_runs_of, f"doc_id long, runs {RUNS}, collapsed string")


def with_periodic_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text, of which one in ten by the CRC-32 of its id has a periodic tail.

    With h the checksum of the decimal id and g = h div 10: if 10 divides h, of the n words those from a = g mod n on
    repeat the first p = 1 + (n - a) div (3 + g mod 8) of them. A text without words, or without an id, stays as it is.
    """
    named = only(docs, doc_id=F.col(id_col).cast("long"), text=text_of(text_col))
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(h % 10 == 0, F.filter(F.split("text", f"{SPACE}+"), lambda w: w != ""))
    g, n = F.floor(h / 10), F.size("words").cast("long")
    first = F.pmod(g, n)
    found = named.withColumn("words", words).withColumns({"first": first, "period": 1 + F.floor((n - first) / (3 + g % 8))})

    def whole(c: Column | str) -> Column:
        return F.col(c).cast("int") if isinstance(c, str) else c.cast("int")

    rest = whole(n - F.col("first"))
    cycle = F.slice("words", whole(F.col("first") + 1), whole("period"))
    tail = F.slice(F.flatten(F.array_repeat(cycle, whole(F.ceil(rest / F.col("period"))))), F.lit(1), rest)
    edited = F.array_join(F.concat(F.slice("words", F.lit(1), whole("first")), tail), " ")
    return found.select("doc_id", F.when(F.col("words").isNotNull() & (n > 0), edited).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Of what ``periodic_runs`` gives: the number of runs, the run of greatest exponent (ties: the first), SHA-256 of all runs and of the collapsed text."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    greater = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    top = F.reduce("runs", none, lambda best, r: F.when(greater(best, r), r).otherwise(best))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return found.withColumn("top", top).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "top.start",
        "top.length",
        "top.period",
        F.floor(1000 * F.col("top.length") / F.col("top.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
