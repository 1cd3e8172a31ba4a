"""Links of similar sets across components against all pairs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from corvane.llm import set_join
from corvane.llm.common import saved
from corvane.llm.simhash import alike


def test_prefixes_are_long_enough():
    """Sets of these sizes that share fewer first elements than the prefixes say cannot be alike."""
    for t in (0.5, 0.8, 0.9):
        for x in range(1, 60):
            for y in range(x, 60):
                least = next((n for n in range(x + 1) if n >= t * (x + y - n) - 1e-9), None)
                if least is None:
                    continue
                # with ``least`` common elements, all at the ends, one is among the first ones of both
                assert x - least < set_join.prefixes(x, t)[1]
                assert y - least < set_join.prefixes(y, t)[0]


@pytest.mark.parametrize("places", [set_join.PLACES, 3])
def test_links_across(spark, places):
    rng, sets = random.Random(4), []
    for _ in range(12):
        base = rng.sample(range(-(10**9), 10**9), rng.randint(4, 60))
        for _ in range(rng.randint(1, 9)):
            changed = [x if rng.random() > 0.08 else rng.randint(0, 10**9) for x in base]
            sets.append(sorted(set(changed[: len(changed) - rng.randint(0, len(changed) // 6)])))
    sets.append([])
    own = [rng.randint(0, 3) for _ in sets]
    nodes = saved(spark.createDataFrame([(i, o) for i, o in enumerate(own)], "node long, own long"))
    bodies = spark.createDataFrame(list(enumerate(sets)), "node long, body array<long>")
    got = set_join.links_across(nodes, lambda ids: bodies.join(ids, "node"), alike, 0.8, places)
    want = set()
    for (i, x), (j, y) in itertools.combinations(enumerate(map(set, sets)), 2):
        if own[i] != own[j] and x and len(x & y) >= 0.8 * len(x | y):
            want.add((i, j))
    links = {(min(r), max(r)) for r in map(tuple, got.collect())}
    # all of them are links, and they join the components that all links join
    assert links <= want and len(want) > 10 and joined(own, links) == joined(own, want)
    assert set_join.links_across(nodes.filter(F.lit(False)), lambda ids: bodies.join(ids, "node"), alike, 0.8).collect() == []


def joined(own, links):
    """The component of each node, by its least node, if nodes of one ``own`` and of a link are in one."""
    part = [own.index(o) for o in own]
    for _ in own:
        for i, j in links:
            one, other = sorted((part[i], part[j]))
            part = [one if p == other else p for p in part]
    return part
