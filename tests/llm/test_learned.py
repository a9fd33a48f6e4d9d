"""Learned operators: accuracy on held-out rows, and that held-out labels are never learned from."""

import random

import numpy as np
import pytest

from rulespark.llm.language_id import identify_language
from rulespark.llm.quality_classifier import classify_quality
from rulespark.llm.queries import QUERIES
from rulespark.llm.toxicity import nnpu, score_toxicity
from tests.llm.fixtures import as_set, frame, sentence

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


def share(df, condition, right):
    rows = df.where(condition).collect()
    assert len(rows) > 5
    return sum(right(r) for r in rows) / len(rows)


def test_quality_on_held_out_rows(spark, labels):
    out = QUERIES["op3_quality_classifier"](spark, DATA).join(labels, "doc_id")
    assert share(out, "held_out", lambda r: r["predicted"] == r["quality"]) >= 0.95
    assert out.where("(score >= 0.3) != (predicted = 1)").count() == 0


def test_toxicity_on_held_out_rows(spark, labels):
    out = QUERIES["op6_toxicity"](spark, DATA).join(labels, "doc_id")
    assert share(out, "held_out AND toxic = 0", lambda r: r["predicted"] == 0) >= 0.98
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    marked = out.join(docs, "doc_id").where("toxic = 1 AND text RLIKE '(?i)idiot|moron|stupid|trash|scum|clown|pathetic|loser|worthless|disgusting'")
    assert share(marked, "true", lambda r: r["predicted"] == 1) >= 0.9


def test_toxicity_learns_from_one_confirmed_text(spark):
    rng = random.Random(3)
    rows = [(k, sentence(rng, 30), "en", "s", 1) for k in range(60)] + [(99, "wicked vile words " + sentence(rng, 5), "en", "s", 1)]
    one = spark.createDataFrame([(99, 1, 1)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r["score"] for r in score_toxicity(frame(spark, rows), one).collect()}
    assert out[99] > max(v for k, v in out.items() if k != 99) and sum(v >= 0.5 for v in out.values()) <= 1


def test_toxicity_weights_equal_a_plain_gradient(spark):
    """nnpu moves along the numeric gradient of the corrected risk."""
    rng = np.random.default_rng(5)
    positive, prior, texts, size = np.arange(40) < 12, 0.2, 40, 6
    x = (rng.random((texts, size)) < 0.4) * rng.random(size)
    x[positive, 0] = 1.0
    rows, words = np.nonzero(x)

    def risk(w):
        margin = x @ w[:-1] + w[-1]
        of = lambda y, own: np.logaddexp(0, -y * margin[own]).mean()
        return prior * of(1, positive) + max(0, of(-1, ~positive) - prior * of(-1, positive)) + 1e-3 * (w[:-1] ** 2).sum() / 2 / texts

    w = nnpu(rows, words, x[rows, words], positive, size, prior, steps=1500, rate=0.02)
    start = np.append(np.zeros(size), np.log(prior / (1 - prior)))
    assert risk(w) < risk(start) and all(risk(w + d) >= risk(w) - 1e-3 for d in np.vstack([np.eye(size + 1), -np.eye(size + 1)]) * 0.05)


def test_texts_of_no_learned_language_are_rejected(spark):
    rng = random.Random(7)
    rows = [(k, sentence(rng, rng.randint(60, 300), "abcdefg" if k % 2 else "mnopqrs"), "aa" if k % 2 else "bb", "s", 1) for k in range(160)]
    rows += [(200 + k, sentence(rng, n, letters), None, "s", 1) for k, (n, letters) in enumerate((n, a) for n in (60, 120, 250) for a in ("tuvwxyz", "αβγδεζη", "漢字仮名交文"))]
    out = {r["doc_id"]: r for r in identify_language(frame(spark, rows)).collect()}
    assert all(out[k]["rejected"] for k in out if k >= 200)
    assert sum(out[k]["rejected"] for k in out if k < 200) <= 2


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    out = QUERIES["op7_language_id"](spark, DATA).join(docs, "doc_id")
    assert share(out, "held_out", lambda r: r["lang_pred"] == r["lang"]) >= 0.98
    assert out.where("rejected").count() <= 0.01 * out.count()


def test_language_of_texts_without_letters(spark):
    rng = random.Random(1)
    rows = [(k, sentence(rng, 20, "abcde" if k % 2 else "uvwxy"), "aa" if k % 2 else "bb", "s", 1) for k in range(80)]
    rows += [(100, None, None, "s", 0), (101, "123 !!", "aa", "s", 6), (102, "", "bb", "s", 0)]
    out = {r["doc_id"]: r for r in identify_language(frame(spark, rows)).collect()}
    assert [out[k]["lang_pred"] for k in (100, 101, 102)] == ["und"] * 3 and all(out[k]["rejected"] for k in (100, 101, 102))
    assert all(out[k]["lang_pred"] == ("aa" if k % 2 else "bb") and not out[k]["rejected"] for k in range(80))


def test_held_out_labels_change_nothing(spark, labels):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    assert as_set(classify_quality(docs, labels)) == as_set(classify_quality(docs, flipped))
    assert as_set(score_toxicity(docs, labels)) == as_set(score_toxicity(docs, flipped))
