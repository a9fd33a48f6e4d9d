"""Quality rules: a log-likelihood ratio between a trusted target and the raw corpus.

Both are multinomials over hashed one- and two-token n-grams, counted over all
texts in one scan.  A text's ratio is the mean over its n-grams; texts below a
fixed threshold fail, and so do texts that fail the base rules (too few words,
too many repeated windows of words).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespark.llm import texthash as th
from rulespark.llm.common import join_narrow, labelled, map_arrow

#: Buckets of hashed n-grams.
BUCKETS = 1 << 16

#: A text is kept if its mean log ratio is this or more.
THRESHOLD = -0.25

LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5

SYMBOLS = th.byte_table(b"#*$%&|<>")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(trusted, text) to (bucket, raw, trusted): n-grams of the task, by bucket."""
    raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        trusted = np.array(batch.column(0).to_pylist(), dtype=bool)
        for texts in th.slices(batch.column(1)):
            hashes, text = th.token_ngrams(texts)
            bucket = (hashes % np.uint64(BUCKETS)).astype(np.int64)
            raw += np.bincount(bucket, minlength=BUCKETS)
            good += np.bincount(bucket[trusted[texts.first + text]], minlength=BUCKETS)
    at = np.flatnonzero(raw)
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(raw[at], pa.int64()), pa.array(good[at], pa.int64())], names=["bucket", "raw", "trusted"])


def base_rules(texts: th.Texts) -> dict[str, np.ndarray]:
    """The base counts of each text."""
    n = len(texts)
    found = th.words(texts)
    hashes = th.span_hashes(texts.data, found)
    lead = (texts.data & 0xC0) != 0x80
    inside = lead & ~th.IS_SPACE[texts.data]
    running = np.concatenate([[0], np.cumsum(inside)])
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[texts.data])])
    n_words = found.counts

    rows = th.lines(texts)
    worded = np.concatenate([[0], np.cumsum(~th.IS_SPACE[texts.data])])
    with_word = worded[rows.end] > worded[rows.start] if len(rows.start) else np.zeros(0, bool)
    line_hash, owner = th.span_hashes(texts.data, rows)[with_word], rows.owner[with_word]
    first_lines = np.bincount(th.distinct(line_hash, owner)[1], minlength=n)
    n_dup_lines = np.bincount(owner, minlength=n) - first_lines

    window, text, place = th.windows(hashes, found, WINDOW, short=False)
    n_repeat = np.zeros(n, np.int64)
    if len(window):
        order = np.lexsort((window, text))
        same = (window[order][1:] == window[order][:-1]) & (text[order][1:] == text[order][:-1])
        twice = np.zeros(len(window), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cover = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(cover, place[twice], 1)
        np.add.at(cover, place[twice] + WINDOW, -1)
        n_repeat = np.bincount(found.owner[np.cumsum(cover[:-1]) > 0], minlength=n)
    return {
        "n_words": n_words,
        "word_chars": running[texts.offsets[1:]] - running[texts.offsets[:-1]],
        "n_symbols": symbols[texts.offsets[1:]] - symbols[texts.offsets[:-1]],
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": n_repeat,
    }


def _judge(model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = model.value
        for batch in batches:
            for texts in th.slices(batch.column(1)):
                base = base_rules(texts)
                hashes, text = th.token_ngrams(texts)
                bucket = (hashes % np.uint64(BUCKETS)).astype(np.int64)
                count = np.maximum(np.bincount(text, minlength=len(texts)), 1)
                mean = th.sums_by_text(ratio[bucket], text, len(texts)) / count
                failed = (base["n_words"] < LEAST_WORDS) | (100 * base["n_repeat_words"] > MOST_REPEATED * base["n_words"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(texts.first, len(texts))]
                    + [pa.array(base[k], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                    + [pa.array(failed), pa.array(~failed & (mean >= threshold)), pa.array(mean, pa.float64())],
                    names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ratio"],
                )

    return run


def judge_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: the base counts, base_failed, kept and log_ratio.

    The trusted target is the text of every document labelled 1, the raw
    corpus all texts; both count whole texts, without a sample.  ``kept`` is
    false where the base rules fail, else whether the mean log ratio is at
    least ``threshold``.

    A null text counts as an empty one: no words, base_failed.  Rows with a
    null id are judged, and are never trusted.  Repeated rows count and are
    judged each.  Without labelled rows every ratio is 0.  Other columns are
    ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    trusted = labelled(labels, label_col).where("label = 1").select("id", F.lit(True).alias("trusted"))
    counted = (
        join_narrow(texts, trusted, "id", "left")
        .select(F.coalesce("trusted", F.lit(False)).alias("trusted"), "text")
        .transform(map_arrow, _counts, "bucket int, raw long, trusted long")
        .groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))
        .collect()
    )
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row in counted:
        raw[row["bucket"]], good[row["bucket"]] = row["raw"], row["trusted"]
    # One added count a bucket on either side, in proportion to the raw shares for the target.
    raw_share = (raw + 1) / (raw.sum() + BUCKETS)
    ratio = np.log((good + raw_share * BUCKETS) / (good.sum() + BUCKETS)) - np.log(raw_share)
    model = spark.sparkContext.broadcast(ratio)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).transform(
        map_arrow,
        _judge(model, threshold),
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, log_ratio double",
    )
