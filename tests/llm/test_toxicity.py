"""Scores computed again from the fitted trees, the calibration and the lexicon, one by one."""

import bisect
import math
import time

import duckdb
import pytest

from corvane.llm import toxicity
from test_edges import features_plainly

SMALL, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def leaf(node, x):
    """The prediction of a regression tree, from its root on."""
    while node.getClass().getSimpleName() == "InternalNode":
        split = node.split()
        node = node.leftChild() if x[split.featureIndex()] <= split.threshold() else node.rightChild()
    return node.prediction()


def step(bounds, values, p):
    """Isotonic regression at p: linear between bounds, level beyond them."""
    at = bisect.bisect_left(bounds, p)
    if at == len(bounds):
        return values[-1]
    if at == 0 or bounds[at] == p:
        return values[at]
    (a, b), (x, y) = bounds[at - 1 : at + 1], values[at - 1 : at + 1]
    return x + (y - x) * (p - a) / (b - a)


def test_scores(spark):
    read = lambda d, name: spark.read.parquet(f"{d}/{name}.parquet")
    model = toxicity.fit(read(LARGE, "documents"), read(LARGE, "labels"))
    assert model.trees is not None and model.lexicon
    trees, weights = [t._java_obj.rootNode() for t in model.trees.trees], list(model.trees.treeWeights)
    bounds, values = list(model.calibration.boundaries), list(model.calibration.predictions)
    want = {}
    for doc_id, text in duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall():
        x = features_plainly(text or "", model.lexicon)
        margin = sum(w * leaf(t, x) for t, w in zip(trees, weights, strict=True))
        p = 1 / (1 + math.exp(-2 * margin))
        own = min(1.0, max(0.0, step(bounds, values, p)))
        value = (1 - toxicity.TIE) * own + toxicity.TIE * p
        want[doc_id] = max(toxicity.REJECT, value) if own >= toxicity.REJECT else min(toxicity.REJECT - toxicity.TIE, value)
    got = {r.doc_id: r.score for r in toxicity.score(read(SMALL, "documents"), model).collect()}
    assert got == {i: pytest.approx(v, abs=1e-9) for i, v in want.items()}
    assert len({round(v, 6) for v in want.values()}) > 10


@pytest.mark.parametrize("text", ["a1a" * 300_000, "a1" * 400_000 + " b", "$" * 500_000])
def test_long_words(text):
    began = time.perf_counter()
    toxicity.features_of(text, {"aia": 1.0})
    assert time.perf_counter() - began < 10
    assert toxicity.obfuscated("x a1b2c y d3e") == ["a1b2c", "d3e"]
