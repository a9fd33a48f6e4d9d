"""Language identification by nearest centroid.

A text is a normalised TF-IDF vector of hashed letter n-grams.  The document
frequencies cover every training text; the centroids, several per language,
come from spherical k-means over a bounded sample of each language.  A text
takes the language of the centroid with the largest cosine.  It is rejected if
that cosine is far below those of the training texts of this language and about
this length: the bounds are low quantiles over all training texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulespark.llm import texthash as th
from rulespark.llm.common import HASHES, hash_rank, id_remainder, join_narrow, map_arrow

#: Buckets of hashed n-grams, so the length of a vector.
BUCKETS = 4096

#: Texts of each language that its centroids are learned from, and centroids per language.
SAMPLE_PER_LANGUAGE, CENTROIDS = 1_000, 4

#: A text is rejected below this share of the quantile of the cosines of training texts.
REJECT_QUANTILE, REJECT_SHARE = 0.005, 0.8

#: Training texts of a language and length that a quantile needs; below the shortest such length the bound is LEAST_COSINE.
QUANTILE_TEXTS, LEAST_COSINE = 20, 0.05

#: Vectors held at a time.
ROWS_AT_ONCE = 128

UNDETERMINED = "und"

#: ASCII letters lower-cased, bytes of other characters as they are, anything else a space.
_LETTERS = np.full(256, 32, dtype=np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def term_counts(texts: th.Texts, buckets: int = BUCKETS) -> np.ndarray:
    """Counts of hashed two- and three-byte letter n-grams: texts x buckets."""
    n, data = len(texts), _LETTERS[texts.data].astype(np.uint32)
    counts = np.zeros((n, buckets), dtype=np.float32)
    if len(data) < 2:
        return counts
    owner = np.repeat(np.arange(n), np.diff(texts.offsets))
    two = data[:-1] * np.uint32(0x01000193) + data[1:]
    grams = [(two * np.uint32(0x9E3779B1), owner[:-1], owner[1:], (data[:-1] != 32) | (data[1:] != 32))]
    if len(data) > 2:
        three = (two[:-1] * np.uint32(0x01000193) + data[2:]) * np.uint32(0x85EBCA77)
        grams.append((three, owner[:-2], owner[2:], data[1:-1] != 32))
    for hashes, start, end, good in grams:
        good &= start == end
        slot = ((hashes[good] >> np.uint32(7)) % np.uint32(buckets)).astype(np.int64) + start[good] * buckets
        counts += np.bincount(slot, minlength=n * buckets).reshape(n, buckets).astype(np.float32)
    return counts


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF vectors; a text without n-grams is the null vector."""
    out = np.log1p(counts) * idf
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, length, out=np.zeros_like(out), where=length > 0)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to (bucket, texts): in how many texts of the task each bucket occurs; bucket -1 counts the texts."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    rows = 0
    for batch in batches:
        for texts in th.slices(batch.column(0), most=ROWS_AT_ONCE):
            total += (term_counts(texts) > 0).sum(axis=0)
            rows += len(texts)
    if rows:
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], rows), pa.int64())], names=["bucket", "texts"])


def spherical_kmeans(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids; the first is the point nearest the mean, each next one the point worst served."""
    mean = points.mean(axis=0)
    chosen = [int(np.argmax(points @ mean))]
    best = points @ points[chosen[0]]
    while len(chosen) < min(k, len(points)):
        chosen.append(int(np.argmin(best)))
        best = np.maximum(best, points @ points[chosen[-1]])
    centres = points[chosen]
    for _ in range(rounds):
        nearest = np.argmax(points @ centres.T, axis=1)
        for j in range(len(centres)):
            if (own := points[nearest == j]).size:
                centres[j] = own.sum(axis=0)
        centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    return centres


def _cluster(idf_of):
    def run(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("id").to_numpy(), kind="stable")
        column = group.column("text").combine_chunks().take(pa.array(order))
        idf = idf_of.value
        points = np.concatenate([vectors(term_counts(t), idf) for t in th.slices(column, most=ROWS_AT_ONCE)])
        points = points[np.linalg.norm(points, axis=1) > 0]
        lang = group.column("lang")[0].as_py()
        centres = spherical_kmeans(points, CENTROIDS) if len(points) else np.zeros((0, BUCKETS))
        return pa.table({"lang": pa.array([lang] * len(centres), pa.string()), "centre": pa.array([c.astype(np.float32).tobytes() for c in centres], pa.binary())})

    return run


def _lengths(counts: np.ndarray) -> np.ndarray:
    """The length class of each text: the binary logarithm of its n-grams."""
    return np.floor(np.log2(np.maximum(counts.sum(axis=1), 1))).astype(np.int32)


def _own_cosines(model):
    """(lang, text) to (lang, length, cosine): the best cosine with a centroid of the text's own language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, names, centres = model.value
        for batch in batches:
            at = 0
            for texts in th.slices(batch.column(1), most=ROWS_AT_ONCE):
                lang, counts = batch.column(0).slice(at, len(texts)), term_counts(texts)
                cosine = vectors(counts, idf) @ centres.T
                own = np.array(lang.to_pylist(), dtype=object)[:, None] == np.array(names, dtype=object)[None, :]
                yield pa.RecordBatch.from_arrays([lang, pa.array(_lengths(counts)), pa.array(np.where(own, cosine, 0).max(axis=1, initial=0).astype(np.float64))], names=["lang", "length", "cosine"])
                at += len(texts)

    return run


def _bounds(rows: list, names: list[str], share: float, least: float) -> np.ndarray:
    """A bound for each centroid and length class: that of the next shorter class that has one, else ``least``."""
    own = {(r["lang"], r["length"]): max(r["cosine"] * share, least) for r in rows if r["texts"] >= QUANTILE_TEXTS}
    out = np.full((len(names), 64), least)
    for k, lang in enumerate(names):
        for length in range(64):
            out[k, length] = own.get((lang, length), out[k, length - 1] if length else least)
    return out


def _predict(model, bounds_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (idf, names, centres), bounds = model.value, bounds_of.value
        for batch in batches:
            at = 0
            texts_of = batch.column(4)
            for texts in th.slices(texts_of, most=ROWS_AT_ONCE):
                n = len(texts)
                lettered = np.array(batch.column(3).slice(at, n).to_pylist(), dtype=bool)
                if len(names):
                    counts = term_counts(texts)
                    cosine = vectors(counts, idf) @ centres.T
                    best = np.argmax(cosine, axis=1)
                    score = np.clip(cosine[np.arange(n), best], 0.0, 1.0).astype(np.float64)
                    lang = [names[b] if ok else UNDETERMINED for b, ok in zip(best, lettered)]
                    least = bounds[best, _lengths(counts)]
                else:
                    score, lang, least = np.zeros(n), [UNDETERMINED] * n, LEAST_COSINE
                score = np.where(lettered, score, 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(lang, pa.string()), pa.array(score), pa.array(~lettered | (score < least)), batch.column(2).slice(at, n)],
                    names=["doc_id", "held_out", "lang_pred", "score", "rejected", "version"],
                )
                at += n

    return run


def identify_language(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    folds: int = 3,
    held_out_fold: int = 1,
    reject_quantile: float = REJECT_QUANTILE,
    reject_share: float = REJECT_SHARE,
    training: DataFrame | None = None,
) -> DataFrame:
    """One row per row of ``docs``: (doc_id, held_out, lang_pred, score, rejected, version).

    Learned from texts with a non-null language of ``training`` (``docs`` itself
    if not given) whose crc32(id as text) is not ``held_out_fold`` modulo
    ``folds``.  ``score`` is the largest cosine with a centroid, between 0 and 1.

    ``lang_pred`` is ``und`` if the text is null or has no letter, or if nothing
    could be learned; such texts are ``rejected``, and so are those with a cosine
    below ``reject_share`` of the ``reject_quantile`` that training texts of the
    language and about the length have (below LEAST_COSINE where they are fewer
    than QUANTILE_TEXTS).  ``version`` is xxhash64 of the text.  Of equal cosines the language first in the alphabet
    wins.  A null id counts as the empty text in the crc32; repeated rows are
    scored alike.  Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    known = (
        (docs if training is None else training)
        .select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
        .where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (id_remainder("id", folds) != held_out_fold))
    )
    counted = known.select("text").transform(map_arrow, _frequencies, "bucket int, texts long").groupBy("bucket").agg(F.sum("texts").alias("texts")).collect()
    df = np.zeros(BUCKETS)
    total = 0
    for row in counted:
        if row["bucket"] < 0:
            total = row["texts"]
        else:
            df[row["bucket"]] = row["texts"]
    idf = np.log((total + 1) / (df + 1)).astype(np.float32) + np.float32(1)
    idf_of = spark.sparkContext.broadcast(idf)
    # Of a language with many texts only those with a low hash are ranked, about four times as many as are taken.
    ids = known.where("id IS NOT NULL").select("id", "lang")
    sizes = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    rank = hash_rank("id", 29)
    low = join_narrow(ids, sizes, "lang").where(rank.cast("double") * F.col("size") <= float(HASHES) * 4 * SAMPLE_PER_LANGUAGE)
    turn = Window.partitionBy("lang").orderBy(rank, "id")
    sample = low.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= SAMPLE_PER_LANGUAGE).select("id").distinct()
    learned = join_narrow(known, sample, "id").groupBy("lang").applyInArrow(_cluster(idf_of), "lang string, centre binary").orderBy("lang", "centre").collect()
    names = [r["lang"] for r in learned]
    centres = np.array([np.frombuffer(r["centre"], np.float32) for r in learned]).reshape(len(learned), BUCKETS)
    model = spark.sparkContext.broadcast((idf, names, centres))
    cosines = known.select("lang", "text").transform(map_arrow, _own_cosines(model), "lang string, length int, cosine double").where("cosine > 0")
    quantile = F.percentile_approx("cosine", F.lit(reject_quantile), F.lit(1000)).alias("cosine")
    bounds = _bounds(cosines.groupBy("lang", "length").agg(F.count(F.lit(1)).alias("texts"), quantile).collect(), names, reject_share, LEAST_COSINE)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (id_remainder(F.col(id_col), folds) == held_out_fold).alias("held_out"),
        F.xxhash64(text_col).alias("version"),
        F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("lettered"),
        F.col(text_col).alias("text"),
    ).transform(map_arrow, _predict(model, spark.sparkContext.broadcast(bounds)), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean, version long")
