"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rulespark.llm import divergence, licenses, search, sharding, warc
from rulespark.llm.bpe import encode_texts
from rulespark.llm.common import table
from rulespark.llm.decontaminate import benchmark_leaks
from rulespark.llm.language_id import identify_language
from rulespark.llm.neardup import near_duplicates
from rulespark.llm.quality_classifier import classify_quality
from rulespark.llm.quality_rules import judge_quality
from rulespark.llm.substring import repeated_paragraphs
from rulespark.llm.toxicity import score_toxicity


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated paragraphs of all documents: the lines and passages that are cut from all but one text, with their clusters."""
    return repeated_paragraphs(table(spark, sf_dir, "documents")).drop("version")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document: five-word shingles, similarity of 0.75 or more; empty texts link with nothing."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every document, learned from the labelled rows that are not held out; empty texts score the intercept."""
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license phrases and notices of every document, by SQL functions alone; a null text has none."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def vocabulary_path() -> str:
    """The public vocabulary file that the contract names; installed on every machine, never copied."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of every document; a null text is empty."""
    return encode_texts(table(spark, sf_dir, "documents"), vocabulary_path())


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document, learned from confirmed and unlabelled rows that are not held out; empty texts score the intercept."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the rows that are not held out; `und` without a letter."""
    return identify_language(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of every document by the law `bytes`; equal texts stay together, null texts are a group of their own."""
    return sharding.shard_records(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base rules and the log ratio verdict of every document; a null text fails the base rules."""
    return judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every overlap of a document with a benchmark item: 12 words or more, three quarters of them equal; null texts have none."""
    return benchmark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of each benchmark item, over all documents."""
    return search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives and read back."""
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language differ, over all documents."""
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_license_scans": op4_license_scans,
    "op5_bpe_encoding": op5_bpe_encoding,
    "op6_toxicity": op6_toxicity,
    "op7_language_id": op7_language_id,
    "op8_sharding": op8_sharding,
    "op9_quality_rules": op9_quality_rules,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_ranked_search": op11_ranked_search,
    "op12_warc": op12_warc,
    "op13_source_divergence": op13_source_divergence,
}

SQL: dict[str, str] = {
    "op4_license_scans": licenses.SQL,
    "op8_sharding": sharding.SQL,
    "op11_ranked_search": search.SQL,
    "op12_warc": warc.SQL,
    "op13_source_divergence": divergence.SQL,
}
