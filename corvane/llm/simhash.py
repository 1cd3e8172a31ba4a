"""SimHash near-dedup with fuzzy keys from the Golay code.

A fingerprint of 64 bits is cut into three segments of 22, 21 and 21 bits, each a word of the Golay
code with leading zeros. If two fingerprints differ in at most 4 bits, then by the pigeonhole
principle either two segments differ in at most one bit each, or one is equal and the other two
differ in two bits each. For the first case, a fingerprint is indexed by the codewords that two
segments decode to, for each pair of segments, and looked up under all their near codewords. For the
second, it is indexed and looked up under an equal segment with the near codewords of the next one.
So every such pair meets under some key, and meetings are verified.

``near_duplicates`` links fingerprints by their distance alone. ``similar`` finds texts whose shingles
have a given Jaccard similarity: with a similarity of 0.8 their own fingerprints differ in some ten
bits, beyond any guarantee. So the fuzzy keys make those pairs meet whose segments allow it, MinHash
bands, whose recall depends on the similarity alone, all others, and the texts decide.

Equal fingerprints are one node, and nothing here forms all pairs of a bucket: see
``graph.bucket_components``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm import golay, minhash
from corvane.llm.common import batches_of, only, packed, saved, small, text_of
from corvane.llm.graph import bucket_components
from corvane.llm.minhash import keys_and_sketches, tuned_bands

SEED = 42
DISTANCE = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
FINGERPRINT = "doc_id long, fp long"
#: Similarity of texts, over shingles of so many words; part of the pairs of that similarity that meet, wherever they differ.
SIMILARITY = 0.8
WIDTH = 5
RECALL = 0.999
ROWS_OF_A_BAND = 5
#: Part of such pairs whose sketches may differ in too many bits to be compared.
LOST = 1e-5
#: Bits by which fingerprints of such texts may differ that share a fuzzy key: ten or so are usual.
REACH = 10


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 of every run of ``width`` words, A-Z in lower case; of all words if there are fewer; none without words."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - width] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(line[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)]
    return np.array(hashes, dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit b is set if it is set in more than half of the hashes; 0 without hashes."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    # sums of uint8 rows, in blocks that cannot overflow, are much faster than wide ones
    blocks = np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8)
    ones = blocks.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def _fingerprints(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(shingle_hashes(t.as_py(), width)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return run


def _keys(index: bool, exact: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keys under which fingerprints, the column fp, are indexed, or looked up, before all columns of their rows.

    Above bit 40 a key has its family. exact: with the keys that a guarantee for ``DISTANCE`` needs besides
    those of pairs of segments.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            bits = batch.column("fp").to_numpy().astype(np.int64).view(np.uint64)
            parts = [(bits >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
            near = [golay.near(p) for p in parts]
            for family, (i, j) in enumerate(PAIRS):
                if index:
                    one, other = golay.decoded(parts[i])[:, None], golay.decoded(parts[j])[:, None]
                else:
                    one, other = near[i], near[j]
                keys = (one[:, :, None] << 12 | other[:, None, :]).reshape(n, -1)
                used = ((one[:, :, None] >= 0) & (other[:, None, :] >= 0)).reshape(n, -1)
                yield _rows(keys | family << 40, used, batch)
            for i in range(3) if exact else ():
                other = near[(i + 1) % 3]
                yield _rows(parts[i][:, None] << 12 | other | (3 + i) << 40, other >= 0, batch)

    return run


def _rows(keys: np.ndarray, used: np.ndarray, batch: pa.RecordBatch) -> pa.RecordBatch:
    at = np.nonzero(used)
    rows = batch.take(pa.array(at[0]))
    return pa.RecordBatch.from_arrays([pa.array(keys[at]), *rows.columns], ["key", *batch.schema.names])


def _differ(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def meetings(prints: DataFrame, reach: int, exact: bool) -> DataFrame:
    """key and the columns of ``prints`` for fingerprints (the column fp) that meet another one under a key.

    Under a key of one fingerprint, those beyond ``reach`` bits of it are left out.
    """
    columns = prints.columns
    schema = "key long, " + ", ".join(f"{c} {kind}" for c, kind in prints.dtypes)
    index = prints.mapInArrow(_keys(True, exact), schema)
    lookups = prints.mapInArrow(_keys(False, exact), schema).alias("l")
    least = F.struct(F.min("fp").alias("fp")) if columns == ["fp"] else F.min(F.struct(*columns))
    leaders = index.groupBy("key").agg(least.alias("leader"), (F.count(F.lit(1)) > 1).alias("several")).alias("i")
    other = [F.col(f"l.{c}") != F.col(f"leader.{c}") for c in columns]
    near = _differ(F.col("l.fp"), F.col("leader.fp")) <= reach
    meets = (F.col("l.key") == F.col("i.key")) & reduce(or_, other) & (F.col("several") | near)
    met = saved(lookups.join(leaders, meets).select("l.*", "leader"))
    return met.select("key", *columns).unionByName(met.select("key", "leader.*").distinct())


def likely_meetings(prints: DataFrame) -> DataFrame:
    """key and code of ``prints`` (code, fp, sketch) that meet a likely copy under a key.

    Chance meetings grow with the square of the number of texts, so signs are compared within the join and no
    pair leaves it: each member is a row if it has one such partner.
    """
    schema = "key long, code long, fp long, sketch long"
    index = prints.mapInArrow(_keys(True, False), schema)
    lookups = prints.mapInArrow(_keys(False, False), schema)
    most = minhash.differing(SIMILARITY, LOST)

    def having(some: DataFrame, other: DataFrame) -> DataFrame:
        a, b = some.alias("a"), other.alias("b")
        likely = (_differ(F.col("a.fp"), F.col("b.fp")) <= REACH) & minhash.close(F.col("a.sketch"), F.col("b.sketch"), most)
        meets = (F.col("a.key") == F.col("b.key")) & (F.col("a.code") != F.col("b.code")) & likely
        return a.join(b, meets, "left_semi").select("key", "code")

    return having(lookups, index).unionByName(having(index, lookups))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hexadecimal digits), component_id.

    component_id is the smallest doc_id that is reachable by links of at most ``DISTANCE`` differing
    bits. Texts without words, null ones too, have fingerprint 0 and are linked like any other. A
    null doc_id names a component only if all its ids are null. Repeated rows are repeated, and an
    empty table gives no rows.
    """
    named = only(docs, doc_id=F.col(id_col).cast("long"), text=text_of(text_col))
    rows = saved(named.mapInArrow(_fingerprints(width), FINGERPRINT))
    nodes = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    members = meetings(nodes.select("fp"), DISTANCE, True).select("key", F.col("fp").alias("node"), F.col("fp").alias("sign"))
    groups = bucket_components(members, lambda a, b: _differ(a, b) <= DISTANCE)
    groups = saved(groups).withColumnRenamed("node", "fp")
    names = groups.join(nodes, "fp").groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_fp = nodes.join(groups.join(names, "component").select("fp", "component_id"), "fp", "left")
    of_fp = of_fp.select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(of_fp, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fingerprint of a text, its number of distinct shingles, their sketch and band keys; texts without words share all keys."""
    bands, rows = tuned_bands(SIMILARITY, RECALL, ROWS_OF_A_BAND)
    for whole in batches:
        for a, b in batches_of(whole.column(2)):
            batch = whole.slice(a, b - a)
            hashes = [shingle_hashes(t, WIDTH) for t in batch.column(2).to_pylist()]
            sets = [np.unique(x) for x in hashes]
            filled = [x if len(x) else np.zeros(1, dtype=np.uint64) for x in sets]
            starts = np.cumsum([0, *map(len, filled[:-1])])
            keys, sketches = keys_and_sketches(np.concatenate(filled), starts, bands, rows)
            columns = [pa.array(map(fingerprint, hashes), pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(sketches)]
            columns.append(pa.array(list(keys), pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["doc_id", "node", "fp", "size", "sketch", "bands"])


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.unique(shingle_hashes(t, WIDTH)).view(np.int64) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "body"])


def _likely(a: Column, b: Column) -> Column:
    """Whether sets of these sizes and sketches can have a similarity of ``SIMILARITY``, but for ``LOST`` of the pairs."""
    as_large = F.least(a["size"], b["size"]) >= SIMILARITY * F.greatest(a["size"], b["size"])
    return as_large & minhash.close(a["sketch"], b["sketch"], minhash.differing(SIMILARITY, LOST))


def alike(x: Column, y: Column) -> Column:
    """Whether two sets have a Jaccard similarity of ``SIMILARITY`` or more; unequal sizes settle most pairs."""
    low, high = F.least(F.size(x), F.size(y)), F.greatest(F.size(x), F.size(y))
    shared = F.size(F.array_intersect(x, y))
    return F.when(low < SIMILARITY * high, F.lit(False)).otherwise(shared >= SIMILARITY * (low + high - shared))


def node_of(text: Column) -> Column:
    """What stands for a text among others: 128 bits of it."""
    return F.unhex(F.md5(text))


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Groups of texts whose five-word shingles have a Jaccard similarity of ``SIMILARITY`` or more.

    Gives one row for each distinct text: node (its digest), first_id (null only if all its ids are), n (its
    rows), group (the least node of its component); and the rows doc_id, node. Texts meet whose fingerprints share a
    fuzzy key and differ in at most ``REACH`` bits, and texts that share a MinHash band of their
    shingles, as a pair of that similarity does with a probability of ``RECALL`` or more wherever it differs.
    Of those that meet and are of fitting sizes and sketches, the shingles of both whole texts decide.
    """
    named = only(docs, doc_id=F.col(id_col).cast("long"), text=text_of(text_col))
    named = named.select("doc_id", node_of(F.col("text")).alias("node"), "text")
    rows = saved(named.mapInArrow(_bands, "doc_id long, node binary, fp long, size long, sketch long, bands array<long>"))
    own = [F.first(c).alias(c) for c in ("fp", "size", "sketch", "bands")]
    nodes = saved(rows.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"), *own))
    signed = nodes.select(F.xxhash64("node").alias("code"), "node", F.struct("size", "sketch").alias("sign"))
    by_band = minhash.meetings(nodes.select("node", F.struct("size", "sketch").alias("sign"), "bands"), by_window=True)
    met = saved(likely_meetings(nodes.select(F.xxhash64("node").alias("code"), "fp", "sketch")).distinct())
    by_print = met.join(signed, "code").select("key", "node", "sign")

    def texts(ids: DataFrame) -> DataFrame:
        wanted = small(saved(ids.join(nodes, "node").select("node", F.col("first_id").alias("id"))))
        same = (named["node"] == wanted["node"]) & named["doc_id"].eqNullSafe(wanted["id"])
        sets = named.join(wanted, same, "left_semi").select("node", "text").mapInArrow(_shingle_sets, "node binary, body array<long>")
        return saved(sets.dropDuplicates(["node"]))

    groups = saved(bucket_components(by_band.unionByName(by_print), _likely, texts, alike, by_window=True))
    of_node = nodes.join(groups, "node", "left").select("node", "first_id", "n", F.coalesce("component", "node").alias("group"))
    return of_node, rows.select("doc_id", "node")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, component_id (the smallest doc_id of its group of ``similar`` texts).

    Texts without words are alike. A null id names a group only if all its ids are null.
    """
    of_node, rows = similar(docs, id_col, text_col)
    of_node = saved(of_node)
    names = of_node.groupBy("group").agg(F.min("first_id").alias("component_id"))
    return rows.join(of_node.join(names, "group").select("node", "component_id"), "node").select("doc_id", "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: of each group of ``similar`` texts the smallest doc_id.

    A null id stays only if all are null. Rows that repeat both the id and the text that stay are one
    document and all stay. Only groups of several rows are joined to the texts.
    """
    of_node, _ = similar(docs, id_col, text_col)
    of_node = saved(of_node)
    head = F.min(F.struct(F.col("first_id").isNull(), "first_id", "node"))
    heads = of_node.groupBy("group").agg(head["node"].alias("head"), F.sum("n").alias("rows"))
    touched = of_node.join(heads.filter("rows > 1"), "group")
    touched = small(saved(touched.select("node", (F.col("node") == F.col("head")).alias("stays"), F.col("first_id"))))
    rows = packed(docs).withColumn("own", node_of(text_of(F.col("row")[text_col])))
    joined = rows.join(touched, rows["own"] == touched["node"], "left")
    stays = F.col("node").isNull() | (F.col("stays") & F.col("row")[id_col].cast("long").eqNullSafe(F.col("first_id")))
    return joined.filter(stays).select("row.*")
