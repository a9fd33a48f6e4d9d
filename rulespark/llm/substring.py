"""Substring dedup: paragraphs that repeat across documents, found by MinHash banding.

A paragraph is a line with enough words.  Hash minima of its word windows are
cut into short bands, for a high recall; paragraphs that collide are compared
on their full window sets, and what is linked forms components.  Of each
component that spans several documents, the first paragraph stays and the
others are removed.

A passage set into the middle of a line is a paragraph of its own: ``passages``
bands every window of so many words, and its rows are added.  One scan of the
texts lists both; it is written once, and later steps read texts only where
something collided.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulespark.llm import texthash as th
from rulespark.llm.common import BROADCAST_ROWS, join_narrow, map_arrow, shared_checkpoint
from rulespark.llm.neardup import linked_components
from rulespark.llm.passages import LEAST_DISTINCT, PASSAGE_WORDS, repeated_passages, window_runs

#: Words that a line needs to count as a paragraph.
LEAST_WORDS = 25

#: At a similarity of 0.75, 12 bands of 3 minima miss a pair with probability 0.0014, at 0.8 with 0.0002.
BANDS, ROWS = 12, 3

#: A row for each paragraph (with bands) and for each run of windows (with an anchor).
LISTED = "doc_id long, version long, start_word int, n int, node long, anchor long, bands array<long>"


def _fingerprints(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each paragraph's window set: the name of its class."""
    with np.errstate(over="ignore"):
        return np.add.reduceat(th.mix(hashes + np.uint64(1)), first) if len(first) else np.zeros(0, np.uint64)


def paragraphs(texts: th.Texts, found: th.Spans, shingles: np.ndarray, place: np.ndarray, width: int, least_words: int) -> tuple[np.ndarray, ...]:
    """(text, first word, words) of each paragraph, the distinct window hashes of all, and where each begins among them."""
    rows = th.lines(texts)
    first, after = np.searchsorted(found.start, rows.start), np.searchsorted(found.start, rows.end)
    long = np.flatnonzero(after - first >= max(least_words, width))
    owner, first, size = rows.owner[long], first[long], (after - first)[long]
    if not len(long) or not len(place):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    line = np.searchsorted(first, place, "right") - 1
    own = np.flatnonzero((line >= 0) & (place + width <= (first + size)[line]))
    hashes, line = th.distinct(shingles[own], line[own])
    counts = np.bincount(line, minlength=len(long))
    varied = counts >= LEAST_DISTINCT * (size - width + 1)
    hashes = hashes[varied[line]]
    counts = counts[varied]
    return owner[varied], first[varied] - found.first[owner[varied]], size[varied], hashes, np.cumsum(counts) - counts


def _hashed(texts: th.Texts, width: int) -> tuple[th.Spans, np.ndarray, np.ndarray, np.ndarray]:
    """The words of some texts, their hashes, and the hashes and first words of all runs of ``width``; A-Z lower-cased."""
    found = th.words(texts)
    hashes = th.span_hashes(th.LOWER[texts.data], found)
    shingles, _, place = th.windows(hashes, found, width, short=False)
    return found, hashes, shingles, place


def _list(width: int, least_words: int, bands: int, rows: int, passage_words: int):
    """(doc_id, version, text) to LISTED."""
    a, b = th.constants(bands * rows, 31), th.constants(bands * rows, 37, odd=False)

    def keys_of(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        n = len(first)
        keys, room = np.zeros((n, bands), np.uint64), np.empty_like(hashes)
        with np.errstate(over="ignore"):
            for j in range(bands if n else 0):
                key = np.full(n, j + 1, dtype=np.uint64)
                for k in range(j * rows, (j + 1) * rows):
                    np.multiply(hashes, a[k], out=room)
                    room += b[k]
                    key = th.mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(room, first))
                keys[:, j] = key
        return keys

    def rows_of(batch: pa.RecordBatch, texts: th.Texts, owner, start, n, node, anchor, keys) -> pa.RecordBatch:
        at = pa.array(texts.first + owner, pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(at),
                batch.column(1).take(at),
                pa.array(start, pa.int32()),
                pa.array(n, pa.int32()),
                pa.array(node.view(np.int64)),
                pa.nulls(len(owner), pa.int64()) if anchor is None else pa.array(anchor.view(np.int64)),
                pa.nulls(len(owner), pa.list_(pa.int64())) if keys is None else th.list_array(keys.view(np.int64).ravel(), np.full(len(owner), bands), pa.int64()),
            ],
            names=["doc_id", "version", "start_word", "n", "node", "anchor", "bands"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in th.slices(batch.column(2)):
                found, words, shingles, place = _hashed(texts, width)
                owner, start, size, hashes, first = paragraphs(texts, found, shingles, place, width, least_words)
                yield rows_of(batch, texts, owner, start, size, _fingerprints(hashes, first), None, keys_of(hashes, first))
                owner, start, size, block, anchor = window_runs(found, words, shingles, place, width, passage_words)
                yield rows_of(batch, texts, owner, start, size, block, anchor, None)

    return run


def _sets(width: int, least_words: int):
    """(text) to (id, shingles) of every paragraph."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in th.slices(batch.column(0)):
                found, _, shingles, place = _hashed(texts, width)
                _, _, _, hashes, first = paragraphs(texts, found, shingles, place, width, least_words)
                cut = np.append(first, len(hashes))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_fingerprints(hashes, first).view(np.int64)), pa.array([hashes[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary())],
                    names=["id", "shingles"],
                )

    return run


def repeated_paragraphs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 75,
    least_words: int = LEAST_WORDS,
    bands: int = BANDS,
    rows: int = ROWS,
    passage_words: int = PASSAGE_WORDS,
) -> DataFrame:
    """The paragraphs and passages that repeat across documents, one row each.

    (doc_id, version, kind, start_word, n_words, component, first_doc_id,
    first_word, removed): words are runs other than white space, counted from
    0; ``version`` is a hash of the text.

    Paragraphs are linked if their ``width``-word window sets share ``percent``
    per cent of the union; of a component that stands in two documents or
    more, the paragraph of the smallest (doc_id, start_word) stays.  Passages
    (see ``passages``) are ``passage_words`` equal words or more, found up to
    their exact ends, and what stands first stays likewise.  What mostly
    repeats itself (fewer than LEAST_DISTINCT of its windows distinct, such as
    one word over and over) is neither.

    Null and empty texts and lines under ``least_words`` words have no
    paragraph.  Rows with a null id count as one document that comes last and
    has no passages.  Rows that repeat an id count as one document.  Other
    columns are ignored, whatever their names; an empty table gives an empty
    result.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text"))
    listed = shared_checkpoint(source.transform(map_arrow, _list(width, least_words, bands, rows, passage_words), LISTED))
    lines = listed.where("anchor IS NULL")

    # One row for each distinct paragraph, so a line that stands in a third of all texts is one row here.
    alone = shared_checkpoint(
        lines.groupBy("node").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "start_word", "version")).alias("first"),
            F.max(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id")).alias("other"),
            F.first("bands").alias("bands"),
        )
    )

    def sets_of(wanted: DataFrame) -> DataFrame:
        """The sets of these paragraphs, each from the first text that holds it."""
        holders = alone.join(wanted, alone["node"] == wanted["id"], "left_semi").select(F.col("first.version").alias("version"), F.col("first.doc_id").alias("_id")).distinct()
        texts = join_narrow(source, holders, "version").where(F.col("doc_id").eqNullSafe(F.col("_id"))).select("text")
        found = texts.transform(map_arrow, _sets(width, least_words), "id long, shingles binary")
        return join_narrow(found, wanted, "id", "left_semi").dropDuplicates(["id"])

    linked = linked_components(alone.select("node", F.explode("bands").alias("bucket")), sets_of, percent)

    parts = shared_checkpoint(alone.join(linked, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "first", "other"))
    groups = (
        parts.groupBy("component")
        .agg(F.min("first").alias("first"), F.max("other").alias("other"))
        .where(~F.col("first.doc_id").eqNullSafe(F.col("other.doc_id")))
        .select("component", F.col("first.doc_id").alias("first_doc_id"), F.col("first.start_word").alias("first_word"))
    )
    wanted = shared_checkpoint(parts.select("node", "component").join(groups, "component"))
    removed = ~(F.col("doc_id").eqNullSafe(F.col("first_doc_id")) & (F.col("start_word") == F.col("first_word")))
    columns = ["doc_id", "version", "kind", "start_word", "n_words", "component", "first_doc_id", "first_word", "removed"]
    lines = lines.select("doc_id", "version", "start_word", F.col("n").alias("n_words"), "node")
    whole = join_narrow(lines, wanted, "node").withColumns({"kind": F.lit("paragraph"), "removed": removed}).select(*columns)
    runs = listed.where("anchor IS NOT NULL").drop("bands")
    glued = repeated_passages(runs, source, passage_words).withColumnRenamed("node", "component").withColumn("kind", F.lit("passage"))
    return whole.unionByName(glued.select(*columns))


#: A span as one number: its first word times this, plus its words.
SPAN_BASE = 1 << 31


def without_spans(text: str, spans: list[int]) -> str:
    """``text`` without spans of words; the white space after a span goes with it."""
    own = next(th.slices(pa.array([text])), None)
    if own is None:
        return text
    starts = th.words(own).start
    kept = np.ones(len(own.data), dtype=bool)
    for span in spans:
        first, count = divmod(int(span), SPAN_BASE)
        if first < len(starts):
            end = starts[first + count] if first + count < len(starts) else len(own.data)
            kept[starts[first] : end] = False
    return own.data[kept].tobytes().decode()


@F.pandas_udf(T.StringType())
def _cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else without_spans(t, s) for t, s in zip(texts, spans)], dtype=object)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the removed paragraphs and passages cut from their texts; all rows and columns stay.

    Texts without a removal are unchanged, and so are null texts and the rows
    of a null id.
    """
    removed = (
        repeated_paragraphs(docs, id_col, text_col, **options)
        .where("removed AND doc_id IS NOT NULL")
        .select(F.col("doc_id").alias("__id"), F.col("version").alias("__version"), (F.col("start_word").cast("long") * SPAN_BASE + F.col("n_words")).alias("__span"))
    )
    removed = shared_checkpoint(removed)
    few = removed.select(F.lit(1)).limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    cut = removed.groupBy("__id", "__version").agg(F.collect_set("__span").alias("__cut"))
    same = (F.col(id_col).cast("long") == F.col("__id")) & (F.xxhash64(text_col) == F.col("__version"))
    joined = docs.join(F.broadcast(cut) if few else cut, same, "left")
    # Only texts with something to cut go through Python.
    left = _cut(F.when(F.col("__cut").isNotNull(), F.col(text_col)), F.coalesce("__cut", F.array().cast("array<bigint>")))
    return joined.withColumn("__left", left).withColumn(text_col, F.when(F.col("__cut").isNull(), F.col(text_col)).otherwise(F.col("__left"))).drop("__id", "__version", "__cut", "__left")
