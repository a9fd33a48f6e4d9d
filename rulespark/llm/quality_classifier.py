"""Quality classifier: hashed word n-gram logistic regression, learned with follow-the-regularised-leader updates.

A bounded sample of labelled texts is dealt into shards; each shard learns in
one task, and the mean of the shards' weights is the model.  Every text is
then scored in one scan: the mean weight of its n-grams, a sparse dot product
with the relative frequencies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespark.llm import texthash as th
from rulespark.llm.common import first_by_hash, id_remainder, join_narrow, labelled, map_arrow

#: Buckets of hashed n-grams; the model is that many 4-byte weights.
BUCKETS = 1 << 18

#: The most labelled texts that are learned from, and the shards they are dealt into.
SAMPLE_ROWS, SHARDS = 8_000, 4

#: Relative frequencies are multiplied by this, so that common n-grams come near 1.
SCALE = 20.0


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes % np.uint64(buckets)).astype(np.int32)


def _featurise(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in th.slices(batch.column(2)):
                hashes, text = th.token_ngrams(texts)
                cut = np.searchsorted(text, np.arange(len(texts) + 1))
                ids = _bucket(hashes, buckets)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(texts.first, len(texts)),
                        batch.column(1).slice(texts.first, len(texts)),
                        pa.array([ids[cut[i] : cut[i + 1]].tobytes() for i in range(len(texts))], pa.binary()),
                    ],
                    names=["id", "label", "ngrams"],
                )

    return run


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], buckets: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01) -> np.ndarray:
    """Per-coordinate follow-the-regularised-leader weights; the last one is the intercept."""
    z, n = np.zeros(buckets + 1), np.zeros(buckets + 1)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for ids, values, label in examples:
            w = weights(ids)
            p = 1 / (1 + np.exp(-np.clip(w @ values, -30, 30)))
            g = (p - label) * values
            root = np.sqrt(n[ids])
            n[ids] += g * g
            z[ids] += g - (np.sqrt(n[ids]) - root) / alpha * w
    return weights(slice(None))


def _learn(buckets: int):
    def run(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("turn").to_numpy(), kind="stable")
        labels, grams = group.column("label").to_numpy(), group.column("ngrams")
        examples = []
        for i in order:
            ids, times = np.unique(np.frombuffer(grams[int(i)].as_buffer(), np.int32), return_counts=True)
            values = times * (SCALE / max(1, times.sum()))
            examples.append((np.append(ids, buckets), np.append(values, 1.0), int(labels[i])))
        model = ftrl(examples, buckets).astype(np.float32)
        return pa.table({"weights": pa.array([model.tobytes()], pa.binary())})

    return run


def _score(model, buckets: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.value
        for batch in batches:
            for texts in th.slices(batch.column(2)):
                hashes, text = th.token_ngrams(texts)
                count = np.maximum(np.bincount(text, minlength=len(texts)), 1)
                total = th.sums_by_text(weights[_bucket(hashes, buckets)].astype(np.float64), text, len(texts))
                margin = total * SCALE / count + float(weights[buckets])
                score = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(texts.first, len(texts)),
                        batch.column(1).slice(texts.first, len(texts)),
                        pa.array(score),
                        pa.array((score >= threshold).astype(np.int32)),
                    ],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    return run


def classify_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = 0.3,
    folds: int = 5,
    sample_rows: int = SAMPLE_ROWS,
    buckets: int = BUCKETS,
) -> DataFrame:
    """One row per row of ``docs``: (doc_id, held_out, score, predicted).

    Rows whose crc32(id as text) is 0 modulo ``folds`` are held out.  The model
    learns from at most ``sample_rows`` other labelled rows, chosen by a hash
    of the id; the id, the label and other columns never enter a score.

    A null text counts as an empty one, and an empty text scores the intercept
    alone.  A null id counts as the empty text in the crc32 and is never
    learned from.  Repeated rows are scored alike.  Without labelled rows every
    score is 0.5.  Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    known = labelled(labels, label_col, "doc_id").where(id_remainder("id", folds) != 0)
    sample = first_by_hash(known, sample_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = (
        join_narrow(texts, sample, "id")
        .select("id", "label", "text")
        .transform(map_arrow, _featurise(buckets), "id long, label int, ngrams binary")
        .withColumn("turn", F.xxhash64("id", F.lit(5)))
        .withColumn("shard", F.pmod("turn", F.lit(SHARDS)))
    )
    learned = rows.groupBy("shard").applyInArrow(_learn(buckets), "weights binary").collect()
    model = np.mean([np.frombuffer(r["weights"], np.float32) for r in learned] or [np.zeros(buckets + 1, np.float32)], axis=0)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (id_remainder(F.col(id_col), folds) == 0).alias("held_out"), F.col(text_col).alias("text")
    ).transform(map_arrow, _score(spark.sparkContext.broadcast(model.astype(np.float32)), buckets, threshold), "doc_id long, held_out boolean, score double, predicted int")
