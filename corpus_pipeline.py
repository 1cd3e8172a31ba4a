"""A corpus from the raw documents to packed sequences, in five stages.

Each stage works on all that its predecessor kept, written as Parquet and read again. All but the
last return the columns of the documents, and any further columns of their input.

In every stage a null text counts as an empty one, a null id is an id like any other, rows that repeat are
rows of their own as long as no stage removes them, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import exact_dedup, mixing, packing, simhash, toxicity
from corvane.llm.common import removed, shared_path
from corvane.llm.queries import tokenizer_path


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits on the labelled documents among ``docs`` and rejects scores from ``toxicity.REJECT`` on.

    Without labels of both kinds nothing can be learned, and all documents have one score, the share of toxic ones.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.accepted(docs, toxicity.fit(docs, labels))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each distinct text without white space: of most characters, then the smallest id; ties by the whole row."""
    return exact_dedup.deduplicated(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that share 0.8 or more of their five-word shingles: the smallest id.

    Texts without words are one group. Rows that repeat the id and the text that stay all stay.
    """
    return simhash.representatives(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources' documents by their target weights; a document is repeated if it is taken twice.

    A null source is one of its own and comes last. Texts without words are taken with whole epochs only.
    """
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all token sequences; an empty text is its end id alone."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("simhash", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL cannot express the fitted trees, so the stages are tested one by one instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all sequences that the documents of ``sf_dir`` make."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            removed(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
