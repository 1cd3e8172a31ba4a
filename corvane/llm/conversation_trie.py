"""The prefix trie of conversations, from sorted matrices of turn ids.

A turn becomes an id of 128 bits where it is read, and a conversation the row of its turns' ids. The rows are
parted into ranges in lexicographic order, those of equal conversations by conv_id, so that a
conversation of any frequency spans as many ranges as it needs. Each range makes padded matrices of its ids,
some turns wide at a time and for those rows alone that still share all turns with another, and sorts
them; the columns' changes from row to row, accumulated by OR from the left, mark where
nodes start, and sums between these marks aggregate every depth.

Only nodes that the first or the last row of a range goes through can have members in another range.
These are given as fragments: as few rows as a range's two outer conversations have turns. Fragments of a node,
found by the digest of its turns, are joined; what their ranges counted below them is added up, and so is
what joined nodes count themselves, along the outer rows of the range where they start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import only, partitions, saved, small, text_of, written

#: Conversations of which every first one lends its first turns to the others, and turns lent: below LENT.
SHARING, LENT = 5, 9
#: Columns of a matrix that is sorted at once.
WIDTH = 16
#: Turns of a range, about.
SHARD_TURNS = 1 << 20
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: of a node that may go on in another range: side tells whether the first row, the last row or both go through it
FRAGMENT = "part int, side string, digest binary, parent binary, bytes long, longer boolean, ends string"
EMPTY = hashlib.sha256(b"").hexdigest()


def conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, ids (array of 32 hexadecimal digits a turn) and bytes (array) of every conversation, in the order of its turns.

    A null turn is first; turns that tie are ordered by their ids. Null role and text are empty.
    Rows without conv_id are one conversation. A conversation is one row of 36 bytes or so a turn, whatever its texts.
    """
    role, text = text_of(role_col), text_of(text_col)
    id_ = F.substring(F.sha2(F.concat_ws(":", F.octet_length(role).cast("string"), F.concat(role, text)), 256), 1, 32)
    named = only(turns, conv_id=F.col(conv_col).cast("long"), turn=F.col(turn_col), id=id_, bytes=F.octet_length(text).cast("long"))
    rows = F.sort_array(F.collect_list(F.struct("turn", "id", "bytes")))
    # conversations that lend to each other meet in one exchange, which the join below needs as well
    lender = (F.col("conv_id") - F.col("conv_id") % SHARING).alias("lender")
    found = named.select("*", lender).repartition("lender").groupBy("lender", "conv_id").agg(rows.alias("turns"))
    return found.select("lender", "conv_id", F.col("turns.id").alias("ids"), F.col("turns.bytes").alias("bytes"))


def with_lent_turns(found: DataFrame) -> DataFrame:
    """conv_id, ids and bytes of ``conversations``, each beginning with the first turns of its lender instead of its own.

    Conversation c has the first h turns of c - c % 5, all if there are fewer and none if there is no
    such conversation, then its own after its first h, with h the CRC-32 of c in decimal digits modulo 9. Signs as in
    SQL: c % 5 has that of c. A conversation without id stays as it is.
    """
    first = found.filter("conv_id = lender").select(
        "lender", F.slice("ids", 1, LENT - 1).alias("lent"), F.slice("bytes", 1, LENT - 1).alias("lent_bytes")
    )
    h = (F.crc32(F.col("conv_id").cast("string")) % LENT).cast("int")
    rows = found.withColumn("h", F.coalesce(h, F.lit(0))).join(first, "lender", "left")

    def rebuilt(lent: str, own: str) -> Column:
        begins = F.coalesce(F.slice(lent, F.lit(1), F.col("h")), F.slice(own, 1, 0))
        return F.concat(begins, F.slice(own, F.col("h") + 1, F.size(own)))

    return rows.select("conv_id", rebuilt("lent", "ids").alias("ids"), rebuilt("lent_bytes", "bytes").alias("bytes"))


class Rows(NamedTuple):
    """Conversations: ids (null as the largest number of 64 bits), turns of each, first turn of each, and of all turns a code in the order of their ids, and bytes."""

    conv: np.ndarray
    turns: np.ndarray
    first: np.ndarray
    code: np.ndarray
    bytes: np.ndarray


NO_ID = np.iinfo(np.int64).max


def _rows(batches: Iterator[pa.RecordBatch]) -> tuple[Rows, list[bytes]]:
    table = pa.Table.from_batches(list(batches)).combine_chunks()
    conv = table.column(0).fill_null(NO_ID).to_numpy()
    paths = table.column(1).to_pylist()
    turns = np.array([len(p) // 16 for p in paths], dtype=np.int64)
    halves = np.frombuffer(b"".join(paths), dtype=">u8").astype(np.uint64).reshape(-1, 2)
    order = np.lexsort((halves[:, 1], halves[:, 0]))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (halves[order[1:]] != halves[order[:-1]]).any(axis=1)
    code = np.empty(len(order), dtype=np.int64)
    code[order] = np.cumsum(fresh) - 1
    sizes = table.column(2).combine_chunks().flatten().to_numpy()
    return Rows(conv, turns, np.cumsum(turns) - turns, code, sizes), paths


def sorted_rows(rows: Rows, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The rows in lexicographic order, equal ones by conv_id; and the turns that each shares with the row before (-1: the first row).

    Matrices are ``width`` turns wide and padded with -1. The second one has the rows alone that share all turns of the first with a neighbour, and so on.
    """
    n = len(rows.conv)
    order, shared = np.argsort(rows.conv, kind="stable"), np.zeros(n, dtype=np.int64)
    # rows of one group share all turns so far and stand together at these places
    places, group, depth = np.arange(n), np.zeros(n, dtype=np.int64), 0
    while len(places):
        here = order[places]
        columns = depth + np.arange(width)
        inside = columns < rows.turns[here][:, None]
        matrix = np.full(inside.shape, -1, dtype=np.int64)
        matrix[inside] = rows.code[(rows.first[here][:, None] + columns)[inside]]
        by = np.lexsort((*matrix.T[::-1], group))
        order[places] = here[by]
        matrix, inside = matrix[by], inside[by]
        change = np.logical_or.accumulate(matrix[1:] != matrix[:-1], axis=1)
        same = group[1:] == group[:-1]
        equal = np.count_nonzero(~change & inside[1:] & inside[:-1], axis=1)
        shared[places[1:][same]] += equal[same]
        whole = same & (equal == width)
        stays = np.zeros(len(places), dtype=bool)
        stays[1:] |= whole
        stays[:-1] |= whole
        numbers = np.concatenate([[0], np.cumsum(~whole)])
        places, group, depth = places[stays], numbers[stays], depth + width
    shared[:1] = -1
    return order, shared


class Level(NamedTuple):
    """Of the nodes of one depth, in order: the first row and the one after the last, the least conversation, the most turns of one, those that end here, and the parent's place."""

    start: np.ndarray
    end: np.ndarray
    least: np.ndarray
    longest: np.ndarray
    ended: np.ndarray
    parent: np.ndarray


def levels(conv: np.ndarray, turns: np.ndarray, shared: np.ndarray) -> list[Level]:
    """The nodes of sorted rows by depth, the root first. A row's node starts there if it shares fewer turns than the depth with the row before."""
    out, rows, before = [], np.arange(len(conv)), None
    for depth in range(int(turns.max()) + 1):
        rows = rows[turns[rows] >= depth]
        marks = np.nonzero(shared[rows] < depth)[0]
        start = rows[marks]
        parent = np.zeros(len(start), dtype=np.int64) if before is None else np.searchsorted(before, start, side="right") - 1
        reduced = (f.reduceat(x, marks) for f, x in ((np.minimum, conv[rows]), (np.maximum, turns[rows]), (np.add, (turns[rows] == depth).astype(np.int64))))
        out.append(Level(start, rows[np.append(marks[1:], len(rows)) - 1] + 1, *reduced, parent))
        before = start
    return out


def _decimal(conv: np.ndarray) -> str:
    return ",".join("" if c == NO_ID else str(c) for c in conv.tolist())


def _digests(path: bytes) -> list[bytes]:
    """Of the first turns of a row, from none on."""
    out, sha = [], hashlib.sha256()
    for at in range(0, len(path) + 16, 16):
        out.append(sha.copy().digest()[:16])
        sha.update(path[at : at + 16])
    return out


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's conversations to its nodes; of those that its first or last row goes through, to fragments."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    rows, paths = _rows(batches)
    order, shared = sorted_rows(rows)
    conv, n = rows.conv[order], len(order)
    outer = _digests(paths[order[0]]), _digests(paths[order[-1]])
    of = lambda depth, start: outer[int(start > 0)][depth]  # noqa: E731  of a node that the first or the last row goes through
    part = TaskContext.get().partitionId()
    found = levels(conv, rows.turns[order], shared)
    none = np.empty(0, dtype=np.int64)
    below, leaves, saved_tokens = None, none, none
    for depth in reversed(range(len(found))):
        here = found[depth]
        k, members = len(here.start), here.end - here.start
        opened = (here.start == 0) | (here.end == n)
        size = rows.bytes[rows.first[order[here.start]] + depth - 1] if depth else np.zeros(k, dtype=np.int64)
        children, sums = np.zeros(k, dtype=np.int64), np.zeros((2, k), dtype=np.int64)
        if below is not None:
            closed = (below.start > 0) & (below.end < n)
            children = np.bincount(below.parent[closed], minlength=k)
            np.add.at(sums[0], below.parent, leaves)
            np.add.at(sums[1], below.parent, saved_tokens)
        # what a node that goes on elsewhere counts itself is not known here
        leaves = sums[0] + (~opened & (here.longest == depth))
        saved_tokens = sums[1] + np.where(opened, 0, (members - 1) * size)
        ends = [EMPTY] * k
        for i in np.nonzero((here.ended > 0) & ~opened)[0].tolist():
            ends[i] = hashlib.sha256(_decimal(conv[here.start[i] : here.start[i] + here.ended[i]]).encode()).hexdigest()
        parents: list = [None] * k
        parent_conv: list = [None] * k
        if depth:
            above = found[depth - 1]
            parent_conv = above.least[here.parent].tolist()
            for i in np.nonzero((above.start[here.parent] == 0) | (above.end[here.parent] == n))[0].tolist():
                parents[i], parent_conv[i] = of(depth - 1, above.start[here.parent[i]]), None
        places, sides, digests, texts = [None] * k, [None] * k, [None] * k, [None] * k
        for i in np.nonzero(opened)[0].tolist():
            start, last = int(here.start[i]), here.end[i] == n
            places[i], sides[i] = part, "both" if start == 0 and last else "first" if start == 0 else "last"
            digests[i], ends[i] = of(depth, start), None
            if here.ended[i]:
                texts[i] = _decimal(conv[start : start + here.ended[i]])
        columns = [here.least, np.full(k, depth), parent_conv, members, children, leaves, saved_tokens]
        longs = [pa.array(c, pa.int64()) for c in columns]
        others = [pa.array(places, pa.int32()), pa.array(sides, pa.string()), pa.array(digests, pa.binary()), pa.array(parents, pa.binary())]
        last = [pa.array(size, pa.int64()), pa.array(here.longest > depth), pa.array(texts, pa.string())]
        arrays = [*longs, pa.array(ends, pa.string()), *others, *last]
        yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in f"{NODE}, {FRAGMENT}".split(", ")])
        below = here


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (digest, ends), those of a digest in a row, to the SHA-256 of all its ends, joined by commas: one text at a time."""
    at, sha = None, hashlib.sha256()
    for batch in batches:
        for digest, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if digest != at:
                if at is not None:
                    yield pa.RecordBatch.from_pydict({"digest": pa.array([at], pa.binary()), "sha": [sha.hexdigest()]})
                at, sha = digest, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ends.encode())
    if at is not None:
        yield pa.RecordBatch.from_pydict({"digest": pa.array([at], pa.binary()), "sha": [sha.hexdigest()]})


def joined(fragments: DataFrame) -> DataFrame:
    """The nodes that fragments make: the columns of a node, and digest. A range has as many fragments as its two outer rows have turns."""
    whole = fragments.groupBy("digest", "parent", "depth").agg(
        F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("closed_children"),
        F.max("longer").alias("longer"),
        F.max("bytes").alias("bytes"),
        F.min("part").alias("home"),
    )
    own = {"leaf": F.when(F.col("longer"), 0).otherwise(1).cast("long"), "tokens": (F.col("n_convs") - 1) * F.col("bytes")}
    whole = saved(whole.withColumns(own).drop("longer", "bytes"))
    # what a node counts itself is added where it starts, to all nodes above it in that range
    at_home = fragments.join(small(whole.select("digest", "home", "leaf", "tokens")), "digest")
    deeper = Window.partitionBy("part", "side").orderBy(F.col("depth").desc())
    branches = Window.partitionBy("part")

    def with_own(counted: str, own: str) -> Column:
        here = F.when(F.col("part") == F.col("home"), F.col(own)).otherwise(0)
        others = F.sum(F.when(F.col("side") != "both", here)).over(branches)
        return F.col(counted) + F.sum(here).over(deeper) + F.when(F.col("side") == "both", F.coalesce(others, F.lit(0))).otherwise(0)

    sums = at_home.select("digest", with_own("n_leaves", "leaf").alias("leaves"), with_own("saved_tokens", "tokens").alias("saved"))
    sums = sums.groupBy("digest").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    children = whole.filter("parent is not null").groupBy(F.col("parent").alias("digest")).agg(F.count(F.lit(1)).alias("open_children"))
    ends = fragments.filter("ends is not null").select("digest", "part", "ends")
    n = partitions(fragments.sparkSession)
    hashed = ends.repartition(n, "digest").sortWithinPartitions("digest", "part").select("digest", "ends").mapInArrow(_hashed, "digest binary, sha string")
    above = whole.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    found = whole.join(sums, "digest").join(children, "digest", "left").join(hashed, "digest", "left").join(above, "parent", "left")
    return found.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        (F.col("closed_children") + F.coalesce("open_children", F.lit(0))).alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.coalesce("sha", F.lit(EMPTY)).alias("ends_sha256"),
        "digest",
    )


def trie(found: DataFrame) -> DataFrame:
    """One row a node of the trie of conversations (conv_id, ids, bytes), as ``conversations`` gives them.

    conv_id (the least member), depth, parent_conv_id, n_convs, n_children, n_leaves (nodes without children in its
    subtree), saved_tokens (over its subtree, the members of each node but one times the bytes of its last turn) and ends_sha256 (of the
    ascending decimal ids of the conversations that end there, joined by commas; one without id is the last, written as nothing).
    A conversation without turns is a member of the root. No conversation, no node. Two rows of one conv_id are two members.
    """
    spark = found.sparkSession
    path = F.unhex(F.array_join("ids", ""))
    rows = written(found.select("conv_id", path.alias("path"), "bytes"), "conversations")
    turns = rows.agg(F.coalesce(F.sum(F.size("bytes")), F.lit(0))).first()[0]
    ranges = max(partitions(spark), -(-turns // SHARD_TURNS))
    dealt = rows.repartitionByRange(ranges, "path", F.col("conv_id").asc_nulls_last())
    nodes = written(dealt.mapInArrow(_nodes, f"{NODE}, {FRAGMENT}"), "nodes")
    columns = [c.split()[0] for c in NODE.split(", ")]
    outer = saved(joined(nodes.filter("part is not null")))
    # nodes below one that goes on in other ranges take its least member from there
    above = outer.select(F.col("digest").alias("parent"), F.col("conv_id").alias("above"))
    inner = nodes.filter("part is null").join(small(above), "parent", "left")
    inner = inner.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above")).select(*columns)
    id_of = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return inner.unionByName(outer.select(*columns)).select(*(id_of(c) if c.endswith("conv_id") else F.col(c) for c in columns))


# The CRC-32 is made bit by bit of the id's decimal digits.
ORACLE_SQL = """
WITH t AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS pos, id, bytes
    FROM (SELECT conv_id, turn, strlen(coalesce(text, '')) AS bytes,
                 left(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 32) AS id FROM conversations)
), c AS (
    SELECT conv_id, conv_id - conv_id % 5 AS lender,
           xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
               lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                   lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384::BIGINT) ELSE y // 2 END)), 4294967295::BIGINT) % 9 AS h
    FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
    SELECT c.conv_id, t.pos, t.id, t.bytes FROM c JOIN t ON t.conv_id = c.lender WHERE t.pos <= c.h
    UNION ALL
    SELECT c.conv_id, 1000000000 + t.pos, t.id, t.bytes FROM c JOIN t ON t.conv_id = c.conv_id WHERE t.pos > c.h
), l AS (
    SELECT c.conv_id, coalesce(list(r.id ORDER BY r.pos) FILTER (r.id IS NOT NULL), []) AS ids,
           coalesce(list(r.bytes ORDER BY r.pos) FILTER (r.id IS NOT NULL), []) AS bytes
    FROM c LEFT JOIN r ON r.conv_id = c.conv_id GROUP BY c.conv_id
), m AS (
    SELECT conv_id, ids, bytes, unnest(range(0, len(ids) + 1)) AS depth FROM l
), n AS (
    SELECT depth, ids[1:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs, max(len(ids)) = depth AS leaf,
           (count(*) - 1) * coalesce(any_value(bytes[depth]), 0) AS own,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(ids) = depth), '')) AS ends_sha256
    FROM m GROUP BY depth, ids[1:depth]
), s AS (
    SELECT above AS depth, path[1:above] AS path, sum(leaf::INT) AS n_leaves, sum(own) AS saved_tokens, sum((depth = above + 1)::INT) AS n_children
    FROM (SELECT *, unnest(range(0, depth + 1)) AS above FROM n) GROUP BY above, path[1:above]
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, s.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves,
       s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN s ON s.depth = n.depth AND s.path = n.path
LEFT JOIN n AS p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]
"""
