"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The features are densities of lexicon words, their nearness to words of the second person, capitals,
punctuation and obfuscated spellings. The lexicon is learned too: words that labelled
toxic texts hold far more often than others. It is fitted on half of the training
rows, the trees and the calibration on a quarter each, so that none is fitted on what another has
already seen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import only, packed, saved, text_of

#: Labelled rows that a fit takes at most; beyond that, a sample by the hash of the id.
MAX_LABELLED = 24_000
#: Entries of the learned lexicon at most, toxic texts that each must occur in, and its least
#: log-odds, as such and in standard deviations.
MAX_LEXICON = 1_000
MIN_TEXTS = 3
MIN_LOG_ODDS = 3.0
MIN_DEVIATIONS = 2.2
REJECT = 0.7
#: What the trees' own probability adds at most within a step of the calibration.
TIE = 1e-4
#: Words to either side in which a word of the second person counts as near.
NEAR = 4

# Pronouns of the second person in the languages of the corpus.
SECOND_PERSON = frozenset(
    "du dein deine dich dir ihr euch sie te ti tienes tu tú tus usted ustedes vos votre vous "
    "ton ta tes toi you your yours yourself youre u ur".split()
)
# Signs that stand for letters.
SIGNS = str.maketrans("0134578@$!|", "oieastbasil")

_EDGES = ".,;:!?\"'()[]{}<>|*-_«»„“”‘’…"
_SIGNS = re.compile(r"[\d@$!|*]+")
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PUNCTUATION = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())

FEATURES = (
    "lexicon_density", "lexicon_weight", "lexicon_hits", "lexicon_kinds", "second_person_near", "second_person",
    "capitals", "shouted", "loud", "punctuation", "obfuscated", "obfuscated_hits", "length",
)


def words_of(text: str) -> list[str]:
    """White-space separated words in lower case, without the marks around them."""
    return [w.strip(_EDGES) for w in text.lower().split()]


def obfuscated(text: str) -> list[str]:
    """Words in which digits or signs stand between letters, as in id1ot."""
    found, done = {}, 0
    for m in _SIGNS.finditer(text):
        a, b = m.span()
        # the rest of a word that is known needs no second look, so a word of any length is looked through once
        if done <= a and 0 < a and b < len(text) and text[a - 1].isalpha() and text[b].isalpha():
            start = max(text.rfind(c, 0, a) for c in " \n\t") + 1
            end = text.find(" ", b)
            word = found.setdefault(start, text[start : end if end >= 0 else len(text)].split()[0])
            done = start + len(word)
    return [w.lower().strip(_EDGES) for w in found.values()]


def features_of(text: str, lexicon: dict[str, float]) -> list[float]:
    """The features named in FEATURES; all are 0 for an empty text."""
    words = words_of(text)
    raw = text.encode("utf-8", "replace")
    n, chars = max(1, len(words)), max(1, len(raw))
    hits = [i for i, w in enumerate(words) if w in lexicon]
    mixed = obfuscated(text)
    you = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    near = 0
    if hits and you:
        at = np.searchsorted(you, hits)
        before, after = np.array([-NEAR - 1, *you])[at], np.array([*you, n + NEAR + 1])[at]
        near = int((np.minimum(np.array(hits) - before, after - np.array(hits)) <= NEAR).sum())
    return [
        len(hits) / n,
        sum(lexicon[words[i]] for i in hits) / n,
        float(np.log1p(len(hits))),
        float(len({words[i] for i in hits})),
        near / n,
        len(you) / n,
        1 - len(raw.translate(None, _CAPITALS)) / chars if raw else 0.0,
        sum(w.isupper() and len(w) > 2 for w in text.split()) / n,
        (raw.count(b"!") + raw.count(b"?")) / n,
        1 - len(raw.translate(None, _PUNCTUATION)) / chars if raw else 0.0,
        len(mixed) / n,
        sum(w.translate(SIGNS) in lexicon for w in mixed) / n,
        float(np.log1p(len(words))),
    ]


def features(text: Column, lexicon: dict[str, float]) -> Column:
    """The features of a text as array<double>, in batches."""

    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([features_of(t, lexicon) for t in texts], dtype=object)

    return of(text)


@dataclass
class Model:
    """Without trees, every text gets the prior: the training rows were of one class or none."""

    prior: float
    lexicon: dict[str, float]
    trees: GBTClassificationModel | None = None
    calibration: IsotonicRegressionModel | None = None


def held_out(doc_id: Column) -> Column:
    """True for ids whose labels are for evaluation alone; a null id is not one of them."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """text, toxic and part (0 to 3) of labelled rows that are not held out, ``most`` of them at most.

    Equal texts count once, as toxic if any of their rows is. The chosen labels are a small table of
    proven size, so the documents are filtered where they are read.
    """
    named = only(labels, id="doc_id", toxic=F.col("toxic").cast("double")).dropna()
    marked = named.filter(~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    chosen = marked.orderBy(F.xxhash64("id", F.lit(11)), "id").limit(most)
    found = only(docs, id="doc_id", text=text_of("text")).join(F.broadcast(chosen), "id")
    once = found.groupBy(F.xxhash64("text").alias("key"), F.length("text").alias("n"))
    once = once.agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    return once.select("text", "toxic", F.pmod(F.xxhash64("key", F.lit(13)), F.lit(4)).alias("part"))


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, toxic = [], []
        for text, label in zip(batch.column(0), batch.column(1), strict=True):
            own = sorted({w for w in words_of(text.as_py()) if 2 < len(w) <= 40})
            words += own
            toxic += [label.as_py()] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(toxic, pa.float64())], ["word", "toxic"])


def learned_lexicon(rows: DataFrame, n_toxic: float, n_clean: float) -> dict[str, float]:
    """Words and their smoothed log-odds of toxic against other texts: the strongest, by evidence."""
    counts = rows.select("text", "toxic").mapInArrow(_distinct_words, "word string, toxic double")
    counts = counts.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    odds = F.log((F.col("t") + 0.5) / (n_toxic + 1)) - F.log((F.col("c") + 0.5) / (n_clean + 1))
    deviation = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    least = max(MIN_TEXTS, 0.002 * n_toxic)
    sure = (F.col("odds") >= MIN_LOG_ODDS) & (F.col("odds") >= MIN_DEVIATIONS * deviation)
    strong = counts.withColumn("odds", odds).filter((F.col("t") >= least) & sure)
    top = strong.orderBy((F.col("t") * F.col("odds")).desc(), "word").limit(MAX_LEXICON).collect()
    return {r.word: r.odds for r in top}


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Model:
    """Fits on ``labels`` (doc_id, toxic) of rows that are not held out; null labels do not count."""
    rows = saved(training_rows(docs, labels, most))
    counts = {r.part: r for r in rows.groupBy("part").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    half = [counts[p] for p in (0, 1) if p in counts]
    toxic, total = sum(r.t for r in counts.values()), sum(r.n for r in counts.values())
    prior = toxic / total if total else 0.0
    if len(counts) < 4 or any(not 0 < r.t < r.n for r in counts.values()):
        return Model(prior, {})
    t = sum(r.t for r in half)
    lexicon = learned_lexicon(rows.filter("part < 2"), t, sum(r.n for r in half) - t)
    ready = rows.filter("part > 1").select(
        "part", F.col("toxic").alias("label"), array_to_vector(features(F.col("text"), lexicon)).alias("features")
    )
    ready = saved(ready)
    trees = GBTClassifier(maxIter=20, maxDepth=3, stepSize=0.3, seed=17).fit(ready.filter("part = 2"))
    raw = trees.transform(ready.filter("part = 3")).select("label", vector_to_array("probability")[1].alias("p"))
    calibration = IsotonicRegression(featuresCol="p", labelCol="label").fit(raw)
    return Model(prior, lexicon, trees, calibration)


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """row (all columns of ``docs``) and toxicity: the calibrated value.

    Isotonic calibration gives a step function. Within a step, the trees' own probability orders the
    texts by ``TIE`` at most, and never moves one over ``REJECT``.
    """
    rows = packed(docs)
    if model.trees is None:
        return rows.withColumn("toxicity", F.lit(float(model.prior)))
    ready = rows.withColumn("features", array_to_vector(features(text_of(F.col("row")[text_col]), model.lexicon)))
    raw = model.trees.transform(ready).withColumn("p", vector_to_array("probability")[1]).drop("prediction")
    step = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction")))
    value = (1 - TIE) * step + TIE * F.col("p")
    side = F.when(step >= REJECT, F.greatest(F.lit(REJECT), value)).otherwise(F.least(F.lit(REJECT - TIE), value))
    return model.calibration.transform(raw).select("row", side.alias("toxicity"))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted.

    Null and empty texts are scored as empty. Repeated rows get equal scores. Without training rows
    of both classes the score is the share of toxic rows among them, 0 if there are none.
    """
    named = only(docs, doc_id=F.col(id_col), text=text_of(text_col))
    return scored(named, model).select(
        "row.doc_id",
        held_out(F.col("row.doc_id")).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= REJECT).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below ``REJECT``, with all their columns.

    Null and empty texts are scored as empty, and texts that tie are all kept or all rejected; repeated rows and null ids are kept as they are,
    and an empty table stays empty.
    """
    return scored(docs, model, text_col).filter(F.col("toxicity") < REJECT).select("row.*")
