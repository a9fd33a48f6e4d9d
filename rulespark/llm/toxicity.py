"""Toxicity: non-negative positive-unlabelled learning.

Confirmed toxic texts and unlabelled texts give hashed word features; Spark
counts in how many texts of either kind each feature stands.  No feature is cut
off: each is scaled by the evidence that it tells the two apart, which grows
smoothly with the counts.  A few linear classifiers, each over all the
positives of the sample and a share of the unlabelled texts, minimise the
class-prior-corrected risk ``p * R+ + max(0, Ru- - p * Rp-)``; their mean
scores every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespark.llm import texthash as th
from rulespark.llm.common import first_by_hash, id_remainder, join_narrow, labelled, map_arrow, shared_checkpoint

#: The most confirmed and the most unlabelled texts that are learned from.
POSITIVE_ROWS, UNLABELLED_ROWS = 6_000, 12_000

#: Classifiers, and the bits of a hashed word.
CLASSIFIERS, BITS = 4, 18

#: Deviations at which a feature has a quarter of its full scale, and texts from which its deviations count in full.
HALF_Z, FULL_TEXTS = 10.0, 5

#: Features that the class prior is estimated from.
PRIOR_WORDS = 8


def _buckets(texts: th.Texts) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed words of each text: (bucket, text)."""
    found, hashes = th.tokens(texts)
    at, text = th.distinct(hashes >> np.uint64(64 - BITS), found.owner)
    return at.astype(np.int64), text


def _word_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, text) to (id, label, words): the distinct hashed words of each text."""
    for batch in batches:
        for texts in th.slices(batch.column(2)):
            at, text = _buckets(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(texts.first, len(texts)),
                    batch.column(1).slice(texts.first, len(texts)),
                    th.list_array(at.astype(np.int32), np.bincount(text, minlength=len(texts)), pa.int32()),
                ],
                names=["id", "label", "words"],
            )


def evidence(p: np.ndarray, u: np.ndarray, n_p: int, n_u: int) -> np.ndarray:
    """By how many deviations a feature of ``p`` confirmed and ``u`` unlabelled texts stands in more of the confirmed; few texts count less."""
    share_p, share_u = (p + 0.5) / (n_p + 1), (u + 1) / (n_u + 1)
    z = (p / n_p - share_u) / np.sqrt(share_p * (1 - share_p) / n_p + share_u * (1 - np.minimum(share_u, 1)) / n_u + 1e-12)
    return np.maximum(z, 0) * np.minimum(1, p / FULL_TEXTS)


def nnpu(rows: np.ndarray, words: np.ndarray, values: np.ndarray, positive: np.ndarray, size: int, prior: float, steps: int = 400, rate: float = 0.1, decay: float = 1e-3) -> np.ndarray:
    """Weights (the last one the intercept) from sparse features: text ``rows[k]`` has ``values[k]`` of word ``words[k]``."""
    texts = len(positive)
    n_p, n_u = max(1, int(positive.sum())), max(1, int((~positive).sum()))
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    w[-1] = np.log(prior / (1 - prior))
    for step in range(1, steps + 1):
        margin = np.bincount(rows, weights=w[words] * values, minlength=texts) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        as_negative = np.logaddexp(0, margin)
        negative_risk = as_negative[~positive].sum() / n_u - prior * as_negative[positive].sum() / n_p
        # derivatives of the logistic loss: towards 1 it is p - 1, towards 0 it is p
        slope = np.where(positive, prior * (p - 1) / n_p, 0.0)
        of_negative = np.where(positive, -prior * p / n_p, p / n_u)
        if negative_risk > 0:
            slope = slope + of_negative
        gradient = np.append(np.bincount(words, weights=slope[rows] * values, minlength=size)[:size] + decay * w[:-1] / texts, slope.sum())
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient * gradient
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def _learn(scale_of, prior: float):
    """(id, label, words) of a shard to its weights: those of scaled features, then the intercept."""

    def run(group: pa.Table) -> pa.Table:
        scale = scale_of.value
        group = group.take(pa.array(np.argsort(group.column("id").to_numpy(), kind="stable"))).combine_chunks()
        lists = group.column("words").chunk(0) if group.column("words").num_chunks else pa.array([], pa.list_(pa.int32()))
        rows, words = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
        told = scale[words] > 0
        known, at = np.unique(words[told], return_inverse=True)
        w = nnpu(rows[told], at, scale[words[told]], group.column("label").to_numpy() == 1, len(known), prior)
        out = np.zeros(len(scale) + 1)
        out[known], out[-1] = w[:-1] * scale[known], w[-1]
        return pa.table({"weights": pa.array([out.tobytes()], pa.binary())})

    return run


def _score(model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.value
        for batch in batches:
            for texts in th.slices(batch.column(2)):
                at, text = _buckets(texts)
                margins = np.stack([th.sums_by_text(w[at], text, len(texts)) + w[-1] for w in weights])
                score = (1 / (1 + np.exp(-np.clip(margins, -30, 30)))).mean(axis=0)
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


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    threshold: float = 0.5,
    folds: int = 5,
    prior: float | None = None,
    positive_rows: int = POSITIVE_ROWS,
    unlabelled_rows: int = UNLABELLED_ROWS,
) -> DataFrame:
    """One row per row of ``docs``: (doc_id, held_out, score, predicted).

    Rows whose crc32(id as text) is 0 modulo ``folds`` are held out and never
    learned from.  ``prior`` is the share of toxic texts; without it, the largest
    ratio of unlabelled to confirmed share among the most telling words.  At most ``positive_rows`` confirmed and
    ``unlabelled_rows`` unlabelled texts are learned from, chosen by a hash of
    the id; labels of 0 are not used as such.

    A null text counts as an empty one, which scores the intercept.  A null id
    counts as the empty text in the crc32 and is never learned from.  Without
    confirmed rows every score is 0.01; one confirmed text is learned from like
    many, though its words have little evidence.  Other columns are
    ignored; repeated rows score alike; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    known = labelled(labels, label_col).where(id_remainder("id", folds) != 0)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    positive = first_by_hash(known.where("label = 1"), positive_rows)
    others = texts.select("id").where(F.col("id").isNotNull() & (id_remainder("id", folds) != 0)).distinct()
    unlabelled = first_by_hash(others.join(positive.select("id"), "id", "left_anti"), unlabelled_rows).select("id", F.lit(0).alias("label"))
    sample = shared_checkpoint(positive.select("id", "label").unionByName(unlabelled))
    rows = join_narrow(texts, sample, "id").select("id", "label", "text").transform(map_arrow, _word_features, "id long, label int, words array<int>")
    # A text counts once however many copies the sample has, and a confirmed text is not unlabelled.
    rows = rows.withColumn("sign", F.xxhash64("words")).groupBy("sign").agg(F.max_by(F.struct("label", "id", "words"), F.struct("label", "id")).alias("row"))
    rows = shared_checkpoint(rows.select("row.id", "row.label", "row.words"))

    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_p, n_u = max(1, sizes.get(1, 0)), max(1, sizes.get(0, 0))
    # At most 2**BITS rows, whatever the texts.
    counts = (
        rows.select("label", F.explode("words").alias("word"))
        .groupBy("word")
        .agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("u"))
        .where("p > 0")
        .orderBy("word")
        .toArrow()
    )
    word, p, u = (counts.column(c).to_numpy() for c in ("word", "p", "u"))
    told = evidence(p, u, n_p, n_u)
    if prior is None:
        # A word of toxic texts only stands in the share p * s of the unlabelled texts if it stands in the share s of the toxic ones.
        # The optimum for such a word is the prior over its true share, so the largest ratio leaves no telling word in doubt.
        first = np.argsort(-told, kind="stable")[:PRIOR_WORDS]
        prior = max(((u[i] / n_u) / (p[i] / n_p) for i in first if told[i] > 0), default=0.01)
    prior = min(max(float(prior), 0.001), 0.5)
    scale = np.zeros(1 << BITS)
    scale[word] = (told / (told + HALF_Z)) ** 2
    learned = (
        rows.withColumn("shard", F.explode(F.when(F.col("label") == 1, F.sequence(F.lit(0), F.lit(CLASSIFIERS - 1))).otherwise(F.array(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(CLASSIFIERS)).cast("int")))))
        .groupBy("shard")
        .applyInArrow(_learn(spark.sparkContext.broadcast(scale), prior), "weights binary")
        .collect()
    )
    blank = np.append(np.zeros(1 << BITS), np.log(prior / (1 - prior)))
    weights = np.array([np.frombuffer(r["weights"]) for r in learned] if sizes.get(1) else [blank])
    model = spark.sparkContext.broadcast(weights)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (id_remainder(F.col(id_col), folds) == 0).alias("held_out"), F.col(text_col).alias("text")
    ).transform(map_arrow, _score(model, threshold), "doc_id long, held_out boolean, score double, predicted int")
