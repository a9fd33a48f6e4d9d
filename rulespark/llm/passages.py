"""Passages that repeat across documents though other text is glued to their ends.

Lines (see ``substring``) are compared whole, so a passage that was set into the
middle of one would be missed.  Here every window of ``passage_words`` words is
a paragraph of its own, whatever its punctuation.  A window is banded by one
MinHash: the smallest hash of its runs of ANCHOR_WORDS words (its anchor).
Equal windows have equal anchors, so one band finds all of them, and as windows
in a row mostly share their anchor, they travel as one block.  Windows whose
anchor stands in several documents are verified by a hash of all their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulespark.llm import texthash as th
from rulespark.llm.common import BROADCAST_ROWS, drop_shared, join_narrow, map_arrow, shared_checkpoint

#: Words in a row, equal in two documents, that make a passage.
PASSAGE_WORDS = 50

#: Words of the runs that anchors are chosen from (a third of a passage, if that is less).
ANCHOR_WORDS = 16

#: Share of the shingles of a window that must be distinct: a word said fifty times is no passage.
LEAST_DISTINCT = 0.5


def _run_names(total: np.ndarray, down: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` words, from the running total of the words' hashes."""
    size = max(len(total) - width, 0)
    with np.errstate(over="ignore"):
        return th.mix((total[width:] - total[:size]) * down[:size] + np.uint64(width))


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` values in a row."""
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def window_names(hashes: np.ndarray, passage_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, anchor) of the window that begins at each word, from the hashes of at least ``passage_words`` words."""
    n = len(hashes)
    up, down = th.powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(th.mix(hashes) * up[:n], out=total[1:])
    width = min(ANCHOR_WORDS, -(-passage_words // 3))
    return _run_names(total, down, passage_words), _smallest(_run_names(total, down, width), passage_words - width + 1)


def self_repeating(shingles: np.ndarray, place: np.ndarray, size: int, per_window: int) -> np.ndarray:
    """How many of the ``per_window`` shingles from each of ``size`` places on are repeats within that window."""
    order = np.argsort(shingles, kind="stable")
    again = np.flatnonzero(shingles[order[1:]] == shingles[order[:-1]])
    now, before = place[order[again + 1]], place[order[again]]
    near = now - before < per_window
    now, before = now[near], before[near]
    # The repeat at ``now`` counts in the windows that hold ``before`` too.
    change = np.bincount(np.maximum(now - per_window + 1, 0), minlength=size + 1)[: size + 1] - np.bincount(before + 1, minlength=size + 1)[: size + 1]
    return np.cumsum(change)[:size]


def window_runs(found: th.Spans, hashes: np.ndarray, shingles: np.ndarray, place: np.ndarray, width: int, passage_words: int) -> tuple[np.ndarray, ...]:
    """(text, first word, windows, block, anchor): a row for windows in a row that share an anchor.

    ``block`` is a hash of the hashes of the windows, so that equal rows are
    known by it.  Windows that mostly repeat themselves are left out.
    """
    n = len(hashes)
    if n < passage_words:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    name, anchor = window_names(hashes, passage_words)
    owner, size, per_window = found.owner, n - passage_words + 1, max(passage_words - width + 1, 1)
    good = owner[:size] == owner[passage_words - 1 :]
    if len(place):
        good &= self_repeating(shingles, place, size, per_window) <= (1 - LEAST_DISTINCT) * per_window
    at = np.flatnonzero(good)
    if not len(at):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    start = np.flatnonzero(np.concatenate([[True], (np.diff(at) > 1) | (anchor[at[1:]] != anchor[at[:-1]]) | (owner[at[1:]] != owner[at[:-1]])]))
    length = np.diff(np.append(start, len(at)))
    within = np.arange(len(at)) - np.repeat(start, length)
    with np.errstate(over="ignore"):
        block = np.add.reduceat(th.mix(name[at] + (within + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), start)
    first = at[start]
    return owner[first], first - found.first[owner[first]], length, block, anchor[first]


def _unpack(passage_words: int):
    """(doc_id, text, runs) to (block, at, doc_id, start_word, last_id, window): a row for each window of the runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in th.slices(batch.column(1)):
                found = th.words(texts)
                name, _ = window_names(th.span_hashes(th.LOWER[texts.data], found), passage_words)
                lists = batch.column(2).slice(texts.first, len(texts))
                doc = batch.column(0).slice(texts.first, len(texts)).take(pa.array(np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy()), pa.int64()))
                rows = lists.flatten()
                owner = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy())
                start, size = (rows.field(c).to_numpy().astype(np.int64) for c in ("start_word", "n"))
                row = np.repeat(np.arange(len(rows)), size)
                at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                word = start[row] + at
                taken = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [rows.field("node").take(taken), pa.array(at, pa.int32()), doc.take(taken), pa.array(word, pa.int32()), rows.field("last_id").take(taken), pa.array(name[found.first[owner[row]] + word].view(np.int64))],
                    names=["block", "at", "doc_id", "start_word", "last_id", "window"],
                )

    return run


def _in_a_row(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, start, end, first_doc_id, shift): rows that touch or overlap and first stand in one place, put together."""
    order = Window.partitionBy(*keys).orderBy(start)
    goes_on = (F.col(start) - F.lag(end).over(order) <= 1) & (F.col("first_doc_id") == F.lag("first_doc_id").over(order)) & (F.col("shift") == F.lag("shift").over(order))
    run = df.withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(order))
    return run.groupBy(*keys, "_run").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.first("first_doc_id").alias("first_doc_id"), F.first("shift").alias("shift")).drop("_run")


def repeated_passages(runs: DataFrame, source: DataFrame, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """(doc_id, version, start_word, n_words, node, first_doc_id, first_word, removed): a row for each passage.

    ``runs`` has (doc_id, version, start_word, n, node, anchor) of every text,
    as ``window_runs`` gives them; ``source`` has (doc_id, version, text).  A
    window of ``passage_words`` words repeats if it stands in two documents or
    more; repeated windows in a row that first stand in a row too (by the
    smallest (doc_id, start_word)) make a passage, up to its exact ends.  What
    stands first stays, and so do windows that overlap their own first one; the
    others are removed.  Rows with a null id are left out: they can't be told
    from each other.
    """
    runs = runs.where("doc_id IS NOT NULL")
    several = (
        runs.groupBy("anchor")
        .agg(F.min("doc_id").alias("_one"), F.max("doc_id").alias("_other"), (F.min("node") != F.max("node")).alias("mixed"))
        .where("_one != _other")
        .select("anchor", "mixed")
    )
    several = shared_checkpoint(several)
    kept = shared_checkpoint(join_narrow(runs, several, "anchor").select("doc_id", "version", "start_word", "n", "node", "mixed"))
    # Equal blocks are looked into once, however many documents hold them; those without a rival repeat as they are.
    blocks = kept.groupBy("node").agg(
        F.min(F.struct("doc_id", "start_word", "version")).alias("_first"), F.max("doc_id").alias("last_id"), F.first("n").alias("n"), F.first("mixed").alias("mixed")
    )
    blocks = shared_checkpoint(blocks.select("node", "_first.*", "last_id", "n", "mixed"))
    whole = blocks.where("NOT mixed").select(F.col("node").alias("block"), F.lit(0).alias("start"), (F.col("n") - 1).alias("end"), F.col("doc_id").alias("first_doc_id"), F.col("start_word").alias("shift"))

    rivals = blocks.where("mixed")
    few = rivals.select(F.lit(1)).limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    wanted = rivals.groupBy(F.col("doc_id").alias("_id"), F.col("version").alias("_version")).agg(F.collect_list(F.struct("start_word", "n", "node", "last_id")).alias("runs"))
    same = (F.col("doc_id") == F.col("_id")) & (F.col("version") == F.col("_version"))
    # Repeated rows give a window twice, at one place.
    texts = source.join(F.broadcast(wanted) if few else wanted, same).select("doc_id", "text", "runs")
    windows = shared_checkpoint(texts.transform(map_arrow, _unpack(passage_words), "block long, at int, doc_id long, start_word int, last_id long, window long"))
    shared = (
        windows.groupBy("window")
        .agg(F.min(F.struct("doc_id", "start_word")).alias("_first"), F.max("last_id").alias("_last"))
        .where("_first.doc_id != _last")
        .select("window", F.col("_first.doc_id").alias("first_doc_id"), F.col("_first.start_word").alias("first_word"))
    )
    hit = windows.select("block", "at", "window").join(shared, "window")
    parts = _in_a_row(hit.select("block", "at", "first_doc_id", (F.col("first_word") - F.col("at")).alias("shift")), ["block"], "at", "at")
    parts = shared_checkpoint(parts.unionByName(whole))
    for done in (several, blocks, windows):
        drop_shared(done)
    placed = join_narrow(kept.select("doc_id", "version", "start_word", F.col("node").alias("block")), parts, "block")
    begin = F.col("start_word")
    placed = placed.select("doc_id", "version", (begin + F.col("start")).alias("from"), (begin + F.col("end")).alias("to"), "first_doc_id", (F.col("shift") - begin).alias("shift"))
    found = _in_a_row(placed, ["doc_id", "version"], "from", "to")
    first_word = F.col("start") + F.col("shift")
    removed = ~((F.col("doc_id") == F.col("first_doc_id")) & (F.col("shift") > -passage_words))
    n_words = F.col("end") - F.col("start") + passage_words
    return found.select("doc_id", "version", F.col("start").alias("start_word"), n_words.alias("n_words"), F.xxhash64("first_doc_id", first_word).alias("node"), "first_doc_id", first_word.alias("first_word"), removed.alias("removed"))
