"""Canonical length-limited Huffman codes of ids, packed and read back by numpy.

Code lengths come from package-merge, so they are the best under the limit. Codes are canonical: the
lengths alone give them. Coded ids are bits from the highest of each byte on. A reader needs no bit
before a checkpoint, so it reads from all checkpoints at once, one id of each in a step, by a table
that has an entry for every value of the next ``limit`` bits.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Longest code in bits: a table of a million entries, and room for some hundred thousand rare ids beside frequent ones.
LIMIT = 20
#: Ids between checkpoints.
CHECKPOINT = 256


class Code(NamedTuple):
    """By id: bits of its code (0 if it has none) and the code; by the next bits: id and bits. ``limit`` is the longest code allowed."""

    lengths: np.ndarray
    codes: np.ndarray
    ids: np.ndarray
    bits: np.ndarray
    limit: int


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """For each id the bits of its code; 0 for ids that do not occur. Ties go to the smaller id first.

    Packages of two are made from the sorted leaves and the packages before, ``limit`` times; an id's
    code is as long as the number of times that it is in what the last round takes.
    """
    lengths = np.zeros(len(counts), dtype=np.uint8)
    used = np.nonzero(counts)[0]
    n = len(used)
    if n > 1 << limit:
        raise ValueError(f"{n} ids cannot have codes of {limit} bits at most")
    if n < 2:
        lengths[used] = 1
        return lengths
    rank = used[np.argsort(counts[used], kind="stable")]
    weights = counts[rank].astype(np.uint64)
    packages, leaves = weights[:0], []
    for _ in range(limit):
        both = np.concatenate([weights, packages])
        order = np.argsort(both, kind="stable")
        leaves.append(order < n)
        both = both[order]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(axis=1)
    taken = 2 * n - 2
    for is_leaf in reversed(leaves):
        k = int(np.count_nonzero(is_leaf[:taken]))
        lengths[rank[:k]] += 1
        taken = 2 * (taken - k)
    return lengths


def canonical(lengths: np.ndarray, limit: int = LIMIT) -> Code:
    """The code of these lengths: codes rise with length, then id."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[np.count_nonzero(lengths == 0) :]
    room = np.left_shift(1, limit - lengths[order].astype(np.int64))
    codes = np.zeros(len(lengths), dtype=np.uint64)
    codes[order] = (np.cumsum(room) - room) >> (limit - lengths[order].astype(np.int64))
    ids, bits = np.zeros(1 << limit, dtype=np.uint32), np.zeros(1 << limit, dtype=np.uint8)
    filled = int(room.sum())
    ids[:filled], bits[:filled] = np.repeat(order, room), np.repeat(lengths[order], room)
    return Code(lengths, codes, ids, bits, limit)


def encoded(ids: np.ndarray, code: Code) -> tuple[bytes, np.ndarray]:
    """The coded ids, filled to whole words of 32 bits, and the first bit of every ``CHECKPOINT``-th id."""
    bits = code.lengths[ids].astype(np.int64)
    if len(ids) and bits.min() == 0:
        raise ValueError("an id has no code")
    ends = np.cumsum(bits)
    at = ends - bits
    words = -(-int(ends[-1] if len(ids) else 0) // 32)
    # a code lies in at most two words: its bits from the highest of 64 on
    value = code.codes[ids] << (64 - (at & 31) - bits).astype(np.uint64)
    # sums of disjoint bits stay below 2**32, so doubles hold them exactly
    high = np.bincount(at >> 5, weights=value >> np.uint64(32), minlength=words + 1)
    low = np.bincount((at >> 5) + 1, weights=value & np.uint64(0xFFFFFFFF), minlength=words + 1)
    return (high + low[: len(high)])[:words].astype(">u4").tobytes(), at[::CHECKPOINT]


def decoded(data: bytes, starts: np.ndarray, counts: np.ndarray, code: Code) -> np.ndarray:
    """The ids of runs of ``counts`` ids that begin at the bits ``starts``, one run after another.

    Bytes that no encoder wrote raise ValueError.
    """
    raw = np.frombuffer(data + b"\0\0\0\0", dtype=np.uint8).astype(np.uint32)
    window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    order = np.argsort(-counts, kind="stable")
    at, left = starts[order].astype(np.int64), counts[order]
    place = (np.cumsum(counts) - counts)[order]
    out = np.empty(int(counts.sum()), dtype=np.uint32)
    mask, spare = np.uint32((1 << code.limit) - 1), 32 - code.limit
    open_runs = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), side="left")
    for step, n in enumerate(open_runs.tolist()):
        here = at[:n]
        following = window[here >> 3] >> (spare - (here & 7)).astype(np.uint32) & mask
        out[place[:n] + step] = code.ids[following]
        taken = code.bits[following]
        if not taken.all():
            raise ValueError("not a coded id")
        here += taken
    return out
