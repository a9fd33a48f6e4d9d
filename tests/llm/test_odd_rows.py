"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import pytest

from rulespark.llm import licenses, sharding
from rulespark.llm.bpe import decode_ids, encode_texts
from rulespark.llm.decontaminate import benchmark_leaks, without_leaks
from rulespark.llm.language_id import identify_language
from rulespark.llm.neardup import near_duplicates
from rulespark.llm.quality_classifier import classify_quality
from rulespark.llm.quality_rules import judge_quality
from rulespark.llm.queries import vocabulary_path
from rulespark.llm.substring import repeated_paragraphs, without_repeats
from rulespark.llm.toxicity import score_toxicity
from tests.llm.fixtures import as_set, clashing, frame, odd_rows, stored

LABELS = "doc_id long, quality int, toxic int"


def labels(spark, rows=((3, 1, 0), (3, 0, 1), (5, 1, 0), (7, 0, 1), (None, 1, 1), (8, None, None))):
    return spark.createDataFrame([tuple(r) for r in rows], LABELS)


def benchmark(spark, rows=((1, "one two three"), (2, None), (3, ""), (None, "alpha beta gamma delta epsilon zeta"))):
    return spark.createDataFrame([tuple(r) for r in rows], "item_id long, text string")


OPERATORS = {
    "op1": lambda s, d: repeated_paragraphs(d),
    "op2": lambda s, d: near_duplicates(d),
    "op3": lambda s, d: classify_quality(d, labels(s)),
    "op4": lambda s, d: licenses.scan_licenses(d),
    "op5": lambda s, d: encode_texts(d, vocabulary_path()),
    "op6": lambda s, d: score_toxicity(d, labels(s)),
    "op7": lambda s, d: identify_language(d),
    "op8": lambda s, d: sharding.shard_records(d),
    "op9": lambda s, d: judge_quality(d, labels(s)),
    "op10": lambda s, d: benchmark_leaks(d, benchmark(s)),
}
ONE_ROW_EACH = {"op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_clashing_names(spark, tmp_path, name):
    rows = odd_rows()
    plain = as_set(OPERATORS[name](spark, stored(spark, frame(spark, rows), tmp_path / "a")))
    other = as_set(OPERATORS[name](spark, stored(spark, clashing(spark, rows), tmp_path / "b")))
    assert plain == other
    if name in ONE_ROW_EACH:
        assert len(plain) == len(rows)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, tmp_path, name):
    assert OPERATORS[name](spark, stored(spark, frame(spark, []), tmp_path / "e")).collect() == []


def test_without_labels_or_benchmark(spark):
    docs = frame(spark, odd_rows())
    none = labels(spark, [])
    assert {round(r["score"], 6) for r in classify_quality(docs, none).collect()} == {0.5}
    assert {round(r["score"], 6) for r in score_toxicity(docs, none).collect()} == {0.01}
    assert {r["log_ratio"] for r in judge_quality(docs, none).collect()} == {0.0}
    assert benchmark_leaks(docs, benchmark(spark, [])).count() == 0


def test_rows_pass_through_unchanged(spark, tmp_path):
    rows = odd_rows()
    docs = stored(spark, clashing(spark, rows), tmp_path / "p")
    assert as_set(without_leaks(docs, benchmark(spark))) == as_set(docs)
    cut = without_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == len(rows)


def test_decoding_round_trip(spark, tmp_path):
    docs = stored(spark, frame(spark, odd_rows()), tmp_path / "d")
    out = decode_ids(encode_texts(docs, vocabulary_path(), with_ids=True), vocabulary_path())
    import hashlib

    for r in out.collect():
        assert hashlib.sha256(r["decoded"].encode()).hexdigest() == r["decoded_sha256"] and len(r["ids"]) == r["n_tokens"]
