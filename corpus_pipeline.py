"""A corpus pipeline over ``documents``: each stage is one operator of ``rulespark.llm``.

A stage takes (spark, docs, sf_dir) and returns what it keeps with the columns
of ``documents``; the last one returns the digests of the encoded texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespark.llm.bpe import encode_texts
from rulespark.llm.common import BROADCAST_ROWS, drop_shared, scratch_tables, shared_checkpoint, table
from rulespark.llm.decontaminate import without_leaks
from rulespark.llm.language_id import identify_language
from rulespark.llm.neardup import near_duplicates
from rulespark.llm.queries import vocabulary_path
from rulespark.llm.substring import without_repeats


def _judged(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """The rows of ``docs`` that are (``left_semi``) or are not (``left_anti``) among ``rows`` by id and text; a null id is an id."""
    keys = shared_checkpoint(rows.select(F.col("doc_id").alias("__id"), F.col("version").alias("__version")).distinct())
    few = keys.select(F.lit(1)).limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__version"))
    return docs.join(F.broadcast(keys) if few else keys, same, how)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter and texts far from every language go."""
    return _judged(docs, identify_language(docs).where("rejected"), "left_anti")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays; of rows that repeat an id and its text, one."""
    docs = _judged(docs, near_duplicates(docs).where("NOT kept"), "left_anti")
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"))
    repeated = shared_checkpoint(keys.groupBy("doc_id", "version").count().where("count > 1"))
    if repeated.isEmpty():
        return docs
    once = _judged(docs, repeated, "left_semi").withColumn("__version", F.xxhash64("text")).dropDuplicates(["doc_id", "__version"])
    return _judged(docs, repeated, "left_anti").unionByName(once.select(*docs.columns))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Paragraphs that repeat across documents are cut from all but the first; every document stays."""
    cut = without_repeats(docs)
    return cut.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars")).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token counts and digests of what is left."""
    return encode_texts(docs, vocabulary_path())


STAGES = [
    ("language_id", language_id),
    ("minhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", decontamination),
    ("bpe_encoding", bpe_encoding),
]

#: Learned centroids, minima and merges can't be told in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written to the shared folder before the next; what a stage needed on the way is deleted."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with scratch_tables():
            kept = shared_checkpoint(stage(spark, docs, sf_dir), scratch=False)
        if k:
            drop_shared(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
