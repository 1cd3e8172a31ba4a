"""The registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import conversation_trie, exact_dedup, html_text, line_dedup, mixing, order_minhash, packing, paragraph_dedup, periodic_runs, simhash, token_files, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprints_of_edits(_table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    """The public vocabulary with word ends, in lower case."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.repeats(_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.fit(docs, labels))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, _table(spark, sf_dir, "pages"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.without_boilerplate(_table(spark, sf_dir, "pages"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_periodic_tails(_table(spark, sf_dir, "documents"))
    return periodic_runs.digests(periodic_runs.periodic_runs(docs))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = conversation_trie.conversations(_table(spark, sf_dir, "conversations"))
    return conversation_trie.trie(conversation_trie.with_lent_turns(found))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.checksums(token_files.round_trip(_table(spark, sf_dir, "documents"), tokenizer_path()))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_order_minhash, op2_paragraph_dedup, op3_mixing, op4_toxicity, op5_packing, op6_html_text, op7_simhash, op8_warc, op9_exact_dedup, op10_line_dedup, op11_periodic_runs, op12_conversation_trie, op13_token_files)}


def oracle_sql() -> dict[str, str]:
    return {"op8_warc": warc.ORACLE_SQL, "op9_exact_dedup": exact_dedup.ORACLE_SQL, "op10_line_dedup": line_dedup.ORACLE_SQL, "op12_conversation_trie": conversation_trie.ORACLE_SQL}
