"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

Documents are tokenised where they are read and cut into pieces; from then on only lengths and
checksums move. The pieces are dealt into groups of some hundred windows' worth of tokens by a hash,
and a group is partitioned into near-equal windows: every piece starts as a partial partition of its
own, and partitions of the largest spreads are merged, the fullest window of one with the
emptiest of the other, until one is left. If its fullest window exceeds the capacity, the number of
windows rises by one and the group is partitioned anew. Windows are so nearly full that the exception for
sequences whose length is a power of two has nothing to save.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import batches_of, only, saved, text_of
from corvane.llm.tokens import encoder

CAPACITY = 2048
#: Windows that a group of pieces fills, about.
GROUP_WINDOWS = 128
#: Pieces that a group has at most, about: the differencing keeps a sum for each piece and window.
GROUP_PIECES = 1 << 15
#: Part of a group's partial partitions that a round of the differencing merges.
MERGED = 0.25
#: Longest piece: the shorter the pieces, the more equal the windows.
PIECE = 256
END_ID = 1

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_pieces(path: str, capacity: int, piece: int, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow: (doc_id, text) to the pieces of each text's ids, the end id included.

    A text is cut into pieces of the whole capacity as long as it fills them, and its rest into shorter ones.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for a, b in batches_of(batch.column(1)):
                ids, sizes = encode(batch.column(1).slice(a, b - a))
                out = np.full(len(ids) + len(sizes), end_id, dtype="<u4")
                out[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)] = ids
                totals = sizes + 1
                full = totals // capacity
                pieces = full - (full * capacity - totals) // piece
                doc = np.repeat(np.arange(len(totals)), pieces)
                nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = np.where(nth < full[doc], nth * capacity, full[doc] * capacity + (nth - full[doc]) * piece)
                length = np.minimum(np.where(nth < full[doc], capacity, piece), totals[doc] - start)
                at = (np.cumsum(totals) - totals)[doc] + start
                data = memoryview(out).cast("B")
                crcs = [zlib.crc32(data[4 * x : 4 * y]) for x, y in zip(at.tolist(), (at + length).tolist(), strict=True)]
                ids_of = batch.column(0).slice(a, b - a).take(pa.array(doc))
                columns = [ids_of, *(pa.array(x, pa.int64()) for x in (start, length, crcs, totals[doc]))]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window of each size, of k windows, by Karmarkar-Karp multiway differencing.

    A partial partition is k sums in descending order; each size begins as one. In a round the
    partial partitions are ordered by spread, those of the largest spreads are merged in pairs, the fullest
    window of one with the emptiest of the other, and every size follows the window it is in. A
    round takes ``MERGED`` of the partitions: one pair at a time gives windows no more equal and takes
    several times as long. Ties go by position, so the result depends on the input alone.
    """
    n = len(sizes)
    sums = np.zeros((n, k), dtype=np.int64)
    if n:
        sums[:, 0] = sizes
    partial, window = np.arange(n), np.zeros(n, dtype=np.int64)
    while len(sums) > 1:
        order = np.argsort(sums[:, -1] - sums[:, 0], kind="stable")
        pairs = max(1, int(len(order) * MERGED / 2))
        one, other, alone = order[: 2 * pairs : 2], order[1 : 2 * pairs : 2], order[2 * pairs :]
        both = sums[one] + sums[other][:, ::-1]
        rank = np.argsort(-both, axis=1, kind="stable")
        place = np.empty_like(rank)
        np.put_along_axis(place, rank, np.broadcast_to(np.arange(k), rank.shape), axis=1)
        to, turned = np.empty(len(order), dtype=np.int64), np.zeros(len(order), dtype=bool)
        to[one] = to[other] = np.arange(pairs)
        to[alone] = pairs + np.arange(len(alone))
        turned[other] = True
        window = np.where(turned[partial], k - 1 - window, window)
        partial = to[partial]
        moved = partial < pairs
        window[moved] = place[partial[moved], window[moved]]
        sums = np.concatenate([np.take_along_axis(both, rank, axis=1), sums[alone]])
    return window


def windows_of(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each size; as few windows as the sum needs, and one more until none exceeds the capacity.

    Sizes that fill a window have one of their own and are not differenced.
    """
    window = np.empty(len(sizes), dtype=np.int64)
    full = sizes >= capacity
    window[full] = np.arange(np.count_nonzero(full))
    rest = sizes[~full]
    k = max(1, -(-int(rest.sum()) // capacity))
    while True:
        found = differencing(rest, k)
        if np.bincount(found, weights=rest, minlength=k).max(initial=0) <= capacity:
            window[~full] = np.count_nonzero(full) + found
            return window
        k += 1


def _pack(capacity: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["id", "start", "ids_crc32"], kind="stable").reset_index(drop=True)
        window = windows_of(pieces["length"].to_numpy(), capacity)
        pieces["sequence_id"] = (int(key[0]) << 24) + window
        pieces["offset"] = pieces.groupby("sequence_id")["length"].cumsum() - pieces["length"]
        return pieces[["id", "has_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return run


def pieces_of(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    piece: int = PIECE,
    end_id: int = END_ID,
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece."""
    named = only(docs, doc_id=F.col(id_col).cast("long"), text=text_of(text_col))
    return named.mapInArrow(cut_pieces(tokenizer_path, capacity, min(piece, capacity), end_id), PIECES)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    piece: int = PIECE,
    end_id: int = END_ID,
) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. Documents of any length are cut into pieces, so none
    is too long. Repeated rows are packed as often as they occur, and a null id is kept. An empty
    table gives no rows. A group's total decides its number of windows, so a group that fills
    ``GROUP_WINDOWS`` windows wastes a window or so; a group has ``GROUP_PIECES`` pieces or so at most.
    """
    pieces = saved(pieces_of(docs, tokenizer_path, id_col, text_col, capacity, piece, end_id))
    n, total = pieces.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    groups = max(1, round(total / (capacity * GROUP_WINDOWS)), -(-n // GROUP_PIECES))
    # rows that repeat, those without an id among them, are dealt out by their place in the saved table as well
    keyed = pieces.withColumn("place", F.monotonically_increasing_id()).select(
        F.coalesce("doc_id", F.lit(0)).alias("id"),
        F.col("doc_id").isNotNull().alias("has_id"),
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "place"), F.lit(groups)).alias("part"),
    )
    schema = "id long, has_id boolean, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    packed = keyed.groupBy("part").applyInPandas(_pack(capacity), schema)
    return packed.select(
        F.when(F.col("has_id"), F.col("id")).alias("doc_id"),
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        "sequence_id",
        "offset",
    )
