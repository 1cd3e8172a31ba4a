"""MinHash bands of sets of shingle hashes: keys under which similar sets meet."""

from __future__ import annotations

from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import saved, small

#: Bits of a sketch of a set: one of the least element under each of the first permutations.
SKETCH = 64


def tuned_bands(similarity: float, recall: float, most: int) -> tuple[int, int]:
    """Bands, and rows of a band, so that a pair of this similarity shares a band with this probability.

    Wider bands make fewer chance meetings but need more of them for the same recall.
    """
    return int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**most))), most


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def keys_and_sketches(hashes: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each set of shingle hashes, one after another from ``starts`` on and none empty, a 64-bit key of each band, and a sketch."""
    factors, shifts = _permutations(bands * rows)
    keys, sketches = np.zeros((len(starts), bands), dtype=np.uint64), np.zeros(len(starts), dtype=np.uint64)
    for i, (a, b) in enumerate(zip(factors, shifts, strict=True) if len(starts) else ()):
        least = np.minimum.reduceat(hashes * a + b, starts)
        band = i // rows
        keys[:, band] = (keys[:, band] ^ least) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band + 1)
        keys[:, band] ^= keys[:, band] >> np.uint64(29)
        if i < SKETCH:
            bit = ((least ^ least >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63)
            sketches |= bit << np.uint64(i)
    return keys.view(np.int64), sketches.view(np.int64)


def band_keys(hashes: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The keys of ``keys_and_sketches``."""
    return keys_and_sketches(hashes, starts, bands, rows)[0]


def differing(similarity: float, lost: float) -> int:
    """Bits in which the sketches of sets of this similarity differ at most, but for so small a part of the pairs.

    Each bit differs with half the probability that the least elements do.
    """
    p, within = (1 - similarity) / 2, 0.0
    for most in range(SKETCH + 1):
        within += comb(SKETCH, most) * p**most * (1 - p) ** (SKETCH - most)
        if 1 - within <= lost:
            break
    return most


def close(a: Column, b: Column, most: int) -> Column:
    """Whether sketches differ in so many bits at most."""
    return F.bit_count(a.bitwiseXOR(b)) <= most


def meetings(nodes: DataFrame, by_window: bool = False) -> DataFrame:
    """key, node, sign for keys that several of the distinct nodes (node, sign, bands) have.

    Keys are counted by partial sums, and only 64 bits of a node meet those that several have; a frequent key is
    split like any large side of a join. ``by_window`` moves fewer bytes, and a key's nodes are in one task.
    """
    code = F.xxhash64("node").alias("code")
    keyed = nodes.select(code, F.explode("bands").alias("key"))
    if by_window:
        whole = Window.partitionBy("key")
        ends = keyed.withColumns({"least": F.min("code").over(whole), "last": F.max("code").over(whole)})
        met = ends.filter("least <> last").select("key", "code")
    else:
        ends = keyed.groupBy("key").agg(F.min("code").alias("least"), F.max("code").alias("last"))
        several = saved(ends.filter("least <> last").select("key"))
        met = keyed.join(small(several), "key").distinct()
    return met.join(nodes.select(code, "node", "sign"), "code").select("key", "node", "sign")
