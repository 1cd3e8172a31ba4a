"""Links between similar sets of different components, by their rarest elements.

Two sets of a similarity of t or more share one of their first elements in any fixed order of all
elements: of the larger one as many as its size without t times it, plus one, and of the smaller one, which is
indexed, fewer still. In the order of frequency these first elements are rare, so sets that are
alike in common elements alone, as texts made from a template are, never meet. Frequencies are
counted under hashes, so their table is as long for any input; elements that share a place in it only change the order.

Sets that meet are held against each other's bitmaps, whose bits are the parities of the elements hashed to them: they
differ in as many bits at most as the sets differ in elements. A pair leaves the join under the least of its keys alone. So no link is lost, and few other pairs leave the join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import saved, small, written
from corvane.llm.graph import components, linked

#: Places of the table of frequencies.
PLACES = 1 << 18
#: Rounds in which one member stands for a key's main component.
ROUNDS = 1
#: Words of 64 bits of a bitmap.
BITMAP = 8
WORDS = [f"word{i}" for i in range(BITMAP)]
NAMES = ["key", "node", "own", "size", "indexed", "lesser", "lesser_indexed", *WORDS]


def _place(elements: np.ndarray, places: int) -> np.ndarray:
    return (elements.view(np.uint64) >> np.uint64(11)).astype(np.int64) % places


def _counted(places: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The elements of a task's sets to place and number, for the places that occur."""
    counts = np.zeros(places, dtype=np.int64)
    for batch in batches:
        counts += np.bincount(_place(batch.column(0).flatten().to_numpy(), places), minlength=places)
    used = np.nonzero(counts)[0]
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["place", "n"])


def bitmaps(flat: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """For each of n sets, whose elements ``flat`` are those of the set ``of``, its bitmap: ``BITMAP`` words."""
    bits = 64 * BITMAP
    odd = np.bincount(of * bits + (flat.view(np.uint64) >> np.uint64(40)).astype(np.int64) % bits, minlength=n * bits) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n, bits), axis=1, bitorder="little").view(np.int64)


def prefixes(size: int, similarity: float) -> tuple[int, int]:
    """First elements of a set of this size by which it looks for smaller sets, and by which it is found by larger ones."""
    enough = lambda x: ceil(x - 1e-9)
    return size - enough(similarity * size) + 1, size - enough(2 * similarity / (1 + similarity) * size) + 1


def _keys(counts: np.ndarray, similarity: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, own, body) to a row for each of the first elements of the body that may be shared: the columns ``NAMES``."""
    for batch in batches:
        sets = batch.column(2)
        sizes = np.diff(sets.offsets.to_numpy())
        flat = sets.flatten().to_numpy()
        of = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((flat, counts[_place(flat, len(counts))], of))
        rank = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        both = {n: prefixes(n, similarity) for n in np.unique(sizes).tolist()}
        looks, found = (np.array([both[n][i] for n in sizes.tolist()], dtype=np.int64) for i in (0, 1))
        # an element that no other set has need not be looked for
        at = np.nonzero((rank < looks[of]) & (counts[_place(flat[order], len(counts))] > 1))[0]
        at = at[np.lexsort((flat[order][at], of[at]))]
        keys, mine, indexed = flat[order][at], of[at], rank[at] < found[of[at]]
        rows = batch.select([0, 1]).take(pa.array(mine))
        columns = [pa.array(keys), *rows.columns, pa.array(sizes[mine].astype(np.int64)), pa.array(indexed), *before(keys, mine, indexed)]
        bits = bitmaps(flat, of, len(sizes))[mine]
        yield pa.RecordBatch.from_arrays([*columns, *(pa.array(b) for b in bits.T.copy())], NAMES)


def before(keys: np.ndarray, of: np.ndarray, indexed: np.ndarray) -> list[pa.ListArray]:
    """For each of the keys, sorted by the set they are ``of``, the lesser keys of its set: all of them, and those indexed."""
    first = np.searchsorted(of, of)
    out = []
    for taken in (np.ones(len(keys), dtype=bool), indexed):
        until = np.cumsum(taken) - taken
        n = until - until[first] if len(keys) else until
        ends = np.concatenate([[0], np.cumsum(n)])
        places = np.repeat(until - n, n) + np.arange(int(ends[-1])) - np.repeat(ends[:-1], n)
        out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[taken][places])))
    return out


def links_across(
    nodes: DataFrame,
    texts: Callable[[DataFrame], DataFrame],
    alike: Callable[[Column, Column], Column],
    similarity: float,
    places: int = PLACES,
) -> DataFrame:
    """Links a, b between nodes (node, own) of different components own whose bodies, sets without nulls, are so similar: enough to join all components that have one.

    First, nodes outside of a key's main component are compared with one member of it, in a few rounds,
    which join most of a large group. Then those still outside are compared with the rest. Empty sets have no link.
    """
    bodies = nodes.join(texts(nodes.select("node")), "node").select("node", "own", "body")
    bodies = written(bodies.filter(F.size("body") > 0), "sets")
    table = np.zeros(places, dtype=np.int64)
    for place, n in bodies.select("body").mapInArrow(partial(_counted, places), "place long, n long").groupBy("place").agg(F.sum("n")).collect():
        table[place] = n
    kinds = dict(bodies.dtypes)
    schema = f"key long, node {kinds['node']}, own {kinds['own']}, size long, indexed boolean, lesser array<long>, lesser_indexed array<long>, " + ", ".join(f"{w} long" for w in WORDS)
    keyed = written(bodies.mapInArrow(partial(_keys, table, similarity), schema), "keys")

    def sets(ids: DataFrame) -> DataFrame:
        return bodies.select("node", "body").join(ids, "node")

    found = None
    for i in range(ROUNDS):
        # under each key, members outside of the main component and one member of it
        main = saved(_main(keyed, i))
        pairs = keyed.join(small(main), "key").filter("own <> main")
        pairs = pairs.select(F.col("node").alias("a"), F.col("lead").alias("b"), "own", "main").distinct()
        links = saved(linked(saved(pairs), sets, alike))
        if links.isEmpty():
            break
        found = links.select("a", "b") if found is None else found.unionByName(links.select("a", "b"))
        merged = components(links.select(F.col("own").alias("a"), F.col("main").alias("b")))
        merged = small(saved(merged.withColumnRenamed("node", "own")))
        own = F.coalesce("component", "own").alias("own")
        keyed = keyed.join(merged, "own", "left").select(*(own if c == "own" else c for c in NAMES))
    rest = keyed.join(small(saved(_main(keyed, ROUNDS).drop("lead"))), "key")
    apart = rest.filter("own <> main").select(F.col("key").alias("at"), *(F.col(c).alias(f"other_{c}") for c in NAMES[1:]))
    smaller, larger = F.col("size") <= F.col("other_size"), F.col("size") >= F.col("other_size")
    meets = (F.col("at") == F.col("key")) & (F.col("other_own") != F.col("own"))
    # of two nodes that are both apart, one comes second
    meets = meets & ((F.col("own") == F.col("main")) | (F.col("other_own") < F.col("own")))
    meets = meets & (smaller & F.col("indexed") | larger & F.col("other_indexed"))
    meets = meets & (F.least("size", "other_size") >= similarity * F.greatest("size", "other_size"))
    # of sizes x and y, alike sets differ in (1 - t) / (1 + t) * (x + y) elements at most
    differing = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"other_{w}"))) for w in WORDS), F.lit(0))
    meets = meets & (differing <= (1 - similarity) / (1 + similarity) * (F.col("size") + F.col("other_size")) + 1e-6)
    # under the least of the keys under which they meet
    sooner = smaller & F.arrays_overlap("lesser_indexed", "other_lesser") | larger & F.arrays_overlap("lesser", "other_lesser_indexed")
    pairs = apart.join(rest, meets & ~sooner).select(F.least("other_node", "node").alias("a"), F.greatest("other_node", "node").alias("b"))
    last = linked(saved(pairs.distinct()), sets, alike)
    return last if found is None else last.unionByName(found)


def _main(keyed: DataFrame, i: int) -> DataFrame:
    """Of keys with several components: key, main (the component of most members) and lead (one of these, by the i-th hash)."""
    lead = F.min_by("node", F.xxhash64("node", F.lit(i))).alias("lead")
    each = keyed.groupBy("key", "own").agg(F.count(F.lit(1)).alias("n"), lead)
    main = F.max_by(F.struct("own", "lead"), F.struct("n", "own")).alias("main")
    both = each.groupBy("key").agg(main, (F.count(F.lit(1)) > 1).alias("several")).filter("several")
    return both.select("key", F.col("main.own").alias("main"), F.col("main.lead").alias("lead"))
