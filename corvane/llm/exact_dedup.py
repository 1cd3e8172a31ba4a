"""Exact dedup by a tree merge of sorted digest runs.

Every document becomes an entry with its normalised text's digest. Each partition sorts its entries into a run,
with one entry for each digest: how many rows it stands for and the best of them. In each round
neighbouring runs meet, eight at a time, which is three binomial rounds at once, and a multiway merge of the
sorted runs again leaves one entry a digest, until a single run is left. A run is cut into shards, ranges of
digests: a row holds one shard of one run, and no task ever holds a whole run. A merge of eight runs
cuts its shards into eight, so a shard stands for about as many rows in the first runs, however
many partitions there are, as in the last.

A group of copies of any size is one entry in each run, so hot groups cost no more than others.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import SPACE, only, packed, power_of_two, saved, small, text_of

#: Runs that meet in a round, as a power of two.
FAN_BITS = 3
#: Rows that a shard stands for, about; and the most bits of a digest that name a shard.
SHARD_ROWS = 20_000
SHARD_BITS = 28

LISTS = ("digest", "size", "check", "n_chars", "doc_id", "rows")
RUN = "shard int, run int, digest array<string>, size array<long>, check array<long>, n_chars array<long>, doc_id array<long>, rows array<long>"
#: digest, size, check, then better ones first: more characters, an id, a smaller id; at last the rows.
Entry = tuple[str, int, int, int, bool, int, int]


def normalised(text: Column) -> Column:
    """The text without ASCII white space."""
    return F.regexp_replace(text, f"{SPACE}+", "")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars (code points of the whole text), and digest, size and check of the normalised text."""
    whole = text_of(text_col)
    bare = only(docs, doc_id=F.col(id_col).cast("long"), n_chars=F.length(whole).cast("long"), bare=normalised(whole))
    return bare.select(
        "doc_id",
        "n_chars",
        F.sha2("bare", 256).alias("digest"),
        F.octet_length("bare").cast("long").alias("size"),
        F.xxhash64("bare").alias("check"),
    )


def merged(runs: Iterable[Iterable[Entry]]) -> Iterator[Entry]:
    """One entry for each digest, size and check of sorted runs: the best, which is the first, with the rows of all."""
    held: Entry | None = None
    for entry in heapq.merge(*runs):
        if held is not None and entry[:3] == held[:3]:
            held = (*held[:6], held[6] + entry[6])
            continue
        if held is not None:
            yield held
        held = entry
    if held is not None:
        yield held


def _entries(lists: Iterable[list]) -> Iterator[Entry]:
    for digest, size, check, n_chars, doc_id, rows in zip(*lists, strict=True):
        yield digest, size, check, -n_chars, doc_id is None, doc_id or 0, rows


def _run(shard: int, run: int, entries: Iterable[Entry]) -> pa.Table:
    lists: list[list] = [[] for _ in LISTS]
    for digest, size, check, chars, no_id, doc_id, rows in entries:
        for values, value in zip(lists, (digest, size, check, -chars, None if no_id else doc_id, rows), strict=True):
            values.append(value)
    types = [pa.string(), *[pa.int64()] * 5]
    columns = [pa.array([x], pa.list_(t)) for x, t in zip(lists, types, strict=True)]
    return pa.Table.from_arrays([pa.array([shard], pa.int32()), pa.array([run], pa.int32()), *columns], ["shard", "run", *LISTS])


def _first_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one partition to a run for each shard; a shard may go on in the next batch."""
    at, held = (0, 0), []
    for batch in batches:
        shards, runs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        entries = _entries([*(c.to_pylist() for c in batch.columns[2:]), [1] * batch.num_rows])
        for shard, run, entry in zip(shards, runs, entries, strict=True):
            if held and at != (shard, run):
                yield from _run(*at, held).to_batches()
                held = []
            at = (shard, run)
            if held and held[-1][:3] == entry[:3]:
                held[-1] = (*held[-1][:6], held[-1][6] + 1)
            else:
                held.append(entry)
    if held:
        yield from _run(*at, held).to_batches()


def shard_of(digest: str, bits: int) -> int:
    """The first bits of a digest."""
    return int(digest[:8], 16) >> (32 - bits)


def _merge(bits: int) -> Callable[[pa.Table], pa.Table]:
    """A function for applyInArrow: the runs of one shard that meet to one, cut into shards of so many bits."""

    def run(runs: pa.Table) -> pa.Table:
        rows = runs.to_pylist()
        entries = merged(_entries([r[c] for c in LISTS]) for r in rows)
        shards = groupby(entries, lambda entry: shard_of(entry[0], bits))
        return pa.concat_tables([_run(shard, rows[0]["run"], part) for shard, part in shards])

    return run


def exact_groups(rows: DataFrame) -> DataFrame:
    """One row for each distinct text of ``digests``, a saved table: digest, size, check, keep_id, keep_chars, group_size.

    Entries only merge where SHA-256, the length and a second hash agree, at every level.
    """
    numbered = rows.select(F.spark_partition_id().alias("run"))
    n, last = numbered.agg(F.count(F.lit(1)), F.coalesce(F.max("run"), F.lit(0))).first()
    rounds = -(-int(last).bit_length() // FAN_BITS)
    most = min(SHARD_BITS, power_of_two(n / SHARD_ROWS).bit_length() - 1)
    # a shard of the first runs has as many bits fewer as the rounds add
    bits = max(0, most - rounds * FAN_BITS)
    shard = F.shiftright(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"), 32 - bits).cast("int")
    order = ["shard", "digest", "size", "check", F.col("n_chars").desc(), F.col("doc_id").asc_nulls_last()]
    dealt = rows.select(shard.alias("shard"), F.spark_partition_id().alias("run"), *LISTS[:-1]).sortWithinPartitions(*order)
    runs = dealt.mapInArrow(_first_runs, RUN)
    for _ in range(rounds):
        bits = min(most, bits + FAN_BITS)
        runs = runs.withColumn("run", F.shiftright("run", FAN_BITS)).groupBy("shard", "run").applyInArrow(_merge(bits), RUN)
    found = runs.select(F.inline(F.arrays_zip(*LISTS))).toDF(*LISTS)
    return found.withColumnsRenamed({"doc_id": "keep_id", "n_chars": "keep_chars", "rows": "group_size"})


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are so without ASCII white space; a null text is an empty one. Of
    equal texts, the row with most code points in its whole text stays, then the smallest doc_id.
    Rows repeated with one doc_id all stay if that document does. Null ids count as one id that is
    larger than any other. An empty table gives no rows; other columns of the input are ignored.
    """
    rows = saved(digests(docs, id_col, text_col))
    return rows.join(exact_groups(rows), ["digest", "size", "check"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each distinct text, with all its columns: the one that ``exact_dedup`` keeps.

    A null text is an empty one, and a null id is larger than any other. Of rows that tie in id and number of code points, the one of
    the least hash of all columns but maps stays, so reruns agree. An empty table gives no rows.
    """
    found = saved(exact_groups(saved(digests(docs, id_col, text_col))))

    def keys(doc_id: Column, n_chars: Column) -> list[Column]:
        return [n_chars.alias("chars"), F.coalesce(doc_id, F.lit(0)).alias("id"), doc_id.isNull().alias("no_id")]

    kept = found.select("digest", "size", "check", *keys(F.col("keep_id"), F.col("keep_chars")))
    whole, doc_id = text_of(F.col("row")[text_col]), F.col("row")[id_col].cast("long")
    rows = packed(docs).withColumn("bare", normalised(whole)).select(
        "row",
        F.sha2("bare", 256).alias("digest"),
        F.octet_length("bare").cast("long").alias("size"),
        F.xxhash64("bare").alias("check"),
        *keys(doc_id, F.length(whole).cast("long")),
    )
    plain = [F.col("row")[c] for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    whole_row = F.min_by("row", F.xxhash64(*plain)).alias("row")
    return rows.join(small(kept), kept.columns, "left_semi").groupBy(*kept.columns).agg(whole_row).select("row.*")


ORACLE_SQL = r"""
WITH d AS (
    SELECT doc_id, length(coalesce(text, '')) AS n,
           regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare
    FROM documents
), g AS (
    SELECT doc_id, sha256(bare) AS text_sha256,
           first_value(doc_id) OVER (PARTITION BY bare ORDER BY n DESC, doc_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
           count(*) OVER (PARTITION BY bare) AS group_size
    FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
