"""Ranked lexical search: windowed bucket scoring.

Every task that scans documents is a segment of the index.  It numbers its
documents and lists, for each window of WINDOW of them, the postings of the
terms that occur in a query: (place in the window, occurrences).  A search
goes through the windows one by one.  In a window every term's postings are
turned into weighted contributions once; an item then adds the contributions
of its terms into an array of one number a place, marks the places in a bit
set, and what is marked and can still enter goes into the item's heap.  A task
ends with the best of each item, and two rounds of merging leave the best of
all.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from rulespark.llm.common import map_arrow, shared_checkpoint
from rulespark.llm.texthash import IS_LETTER_OR_DIGIT, slices, terms

#: Documents in a window: its array of scores takes 32 kB.  A window also ends at this many postings.
WINDOW, WINDOW_POSTINGS = 4096, 1 << 20

#: Bytes of distinct query terms that are searched for in one pass; further items wait for the next.
BLOCK_BYTES = 8 << 20

#: Groups of tasks whose best rows are merged first.
MERGERS = 256

_INDEX = "docs long, words long, ids array<long>, lengths array<long>, terms array<int>, counts array<int>, places binary, occurrences binary"


def _index(docs: DataFrame, vocabulary: pa.Array, id_col: str, text_col: str) -> DataFrame:
    """The windows of all documents with a term: counts of all of them, and the postings of ``vocabulary``."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = known.value
        width = max(1, len(wanted))
        docs, words, ids, lengths, place, term, times = 0, 0, [], [], [], [], []

        def window() -> pa.RecordBatch:
            t = np.concatenate(term) if term else np.zeros(0, np.int64)
            p = np.concatenate(place) if place else np.zeros(0, np.int64)
            order = np.argsort(t, kind="stable")
            kinds, counts = np.unique(t, return_counts=True)
            tf = np.concatenate(times) if times else np.zeros(0, np.int64)
            row = (docs, words, ids, lengths, kinds.tolist(), counts.tolist(), p[order].astype("<u2").tobytes(), tf[order].astype("<u4").tobytes())
            types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, types)], names=["docs", "words", "ids", "lengths", "terms", "counts", "places", "occurrences"])

        postings = 0
        for batch in batches:
            own = batch.column(0).to_pylist()
            for texts in slices(batch.column(1), most=WINDOW):
                found, counts = terms(texts, IS_LETTER_OR_DIGIT)
                docs += int((counts > 0).sum())
                words += int(counts.sum())
                code = pc.index_in(found, value_set=wanted)
                hit = np.flatnonzero(code.is_valid().to_numpy(zero_copy_only=False))
                if not len(hit):
                    continue
                owner = np.repeat(np.arange(len(counts)), counts)[hit]
                key, tf = np.unique(owner * width + code.take(pa.array(hit)).to_numpy(), return_counts=True)
                text, kind = key // width, key % width
                there = np.unique(text)
                if ids and (len(ids) + len(there) > WINDOW or postings + len(key) > WINDOW_POSTINGS):
                    yield window()
                    docs, words, ids, lengths, place, term, times, postings = 0, 0, [], [], [], [], [], 0
                place.append(len(ids) + np.searchsorted(there, text))
                term.append(kind)
                times.append(tf)
                postings += len(key)
                ids += [own[texts.first + k] for k in there]
                lengths += counts[there].tolist()
        if docs or ids:
            yield window()

    return map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), build, _INDEX)


def _search(index: DataFrame, items: list[list[int]], weights: np.ndarray, documents: int, words: int, most: int) -> DataFrame:
    """The best ``most`` rows of each item (by its number) in every task: (item, doc_id, score)."""
    shared = index.sparkSession.sparkContext.broadcast((items, weights))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = shared.value
        heaps: list[list[tuple[int, int, int | None]]] = [[] for _ in items]
        bucket = np.zeros(WINDOW, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                ids = row["ids"]
                lengths = np.array(row["lengths"], np.int64)
                norm = 20 * (100 - 50 + (50 * lengths * documents) // words) if words else lengths
                places = np.frombuffer(row["places"], "<u2").astype(np.int64)
                tf = np.frombuffer(row["occurrences"], "<u4").astype(np.int64)
                ends = np.cumsum(row["counts"])
                gain = np.repeat(weights[row["terms"]], row["counts"]) * ((1_000_000_000 * tf) // (1000 * tf + norm[places]))
                postings = {}
                for t, n, end in zip(row["terms"], row["counts"], ends.tolist()):
                    marks = np.zeros(WINDOW, np.uint8)
                    marks[place := places[end - n : end]] = 1
                    postings[t] = place, gain[end - n : end], np.packbits(marks)
                occupied = np.zeros(WINDOW // 8, np.uint8)
                for heap, wanted in zip(heaps, items):
                    bucket[:], occupied[:] = 0, 0
                    for t in wanted:
                        if t in postings:
                            place, more, marks = postings[t]
                            bucket[place] += more
                            occupied |= marks
                    least = heap[0][0] if len(heap) == most else 1
                    for k in np.flatnonzero(np.unpackbits(occupied).view(bool) & (bucket >= max(least, 1))).tolist():
                        # The worst is on top: the lowest score, then the largest id; a null id is smaller than any other.
                        entry = (int(bucket[k]), 1 << 64 if ids[k] is None else -ids[k], ids[k])
                        if len(heap) < most:
                            heapq.heappush(heap, entry)
                        elif entry[:2] > heap[0][:2]:
                            heapq.heapreplace(heap, entry)
        for number, heap in enumerate(heaps):
            if heap:
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(heap), pa.int32()), pa.array([e[2] for e in heap], pa.int64()), pa.array([e[0] for e in heap], pa.int64())], names=["item", "doc_id", "score"])

    return map_arrow(index.select("ids", "lengths", "terms", "counts", "places", "occurrences"), score, "item int, doc_id long, score long")


def _best(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def rank_documents(docs: DataFrame, queries: DataFrame, most: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``most`` best documents of each item of ``queries``: (item_col, rank, doc_id, score).

    Terms are runs of letters, digits and characters beyond ASCII, A-Z
    lower-cased, in whole texts.  With N documents that have a term, L terms in
    all, n terms in a document and df documents with a term, a document scores
    the sum over the item's distinct terms of w * (10^9 tf div (1000 tf + 20 m)),
    w = floor(1000 ln((2N + 2) / (2df + 1))), m = 50 + (50 n N) div L.  Only
    scores above 0 count; ties go to the smaller id, null ids first.

    Rows of ``queries`` with the same id (null is one) are one item with the
    terms of all.  Rows of ``docs`` are documents of their own even if they
    repeat; a null text has no terms.  Items without terms and empty tables
    give no rows; other columns are ignored, whatever their names.

    Items are searched in blocks of about ``block_bytes`` of distinct terms, each
    with a scan of the documents; only a block's terms, items and weights are
    on the driver.
    """
    spark = docs.sparkSession
    lowered = F.translate(F.col(query_col).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.explode(F.regexp_extract_all(lowered, F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)")))
    wanted = shared_checkpoint(queries.select(F.col(item_col).alias("item_id"), found.alias("term")).distinct())
    kind = wanted.schema["item_id"].dataType.simpleString()
    size = wanted.agg(F.sum(F.octet_length("term") + 8).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // block_bytes))
    results = []
    for block in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).groupBy("item_id").agg(F.collect_list("term").alias("terms")).collect()
        if not rows:
            continue
        words = sorted({t.encode() for r in rows for t in r["terms"]})
        number = {t: k for k, t in enumerate(words)}
        items = [sorted(number[t.encode()] for t in r["terms"]) for r in rows]
        index = shared_checkpoint(_index(docs, pa.array(words, pa.large_binary()), id_col, text_col))
        whole = index.agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).first()
        total, length = whole["docs"] or 0, whole["words"] or 0
        weights = np.zeros(len(words), np.int64)
        pairs = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("p"))
        for r in pairs.groupBy("p.terms").agg(F.sum("p.counts").alias("df")).collect():
            weights[r["terms"]] = math.floor(1000 * math.log((2 * total + 2) / (2 * r["df"] + 1)))
        best = _search(index, items, weights, total, length, most).withColumn("merger", F.pmod(F.spark_partition_id(), F.lit(MERGERS)))
        best = _best(_best(best, ["item", "merger"], most).drop("rank"), ["item"], most)
        names = spark.createDataFrame([(k, r["item_id"]) for k, r in enumerate(rows)], f"item int, item_id {kind}")
        best = best.join(F.broadcast(names), "item").select(F.col("item_id").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("doc_id").cast(LongType()), "score")
        results.append(best if blocks == 1 else shared_checkpoint(best))
    if not results:
        return spark.createDataFrame([], f"{item_col} {kind}, rank int, doc_id long, score long")
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


SQL = r"""
WITH tokens AS (
  SELECT row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents)),
lengths AS (SELECT row, count(*) AS n FROM tokens GROUP BY row),
whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM lengths),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
postings AS (
  SELECT row, doc_id, term, count(*)::BIGINT AS tf FROM tokens WHERE term IN (SELECT term FROM wanted) GROUP BY row, doc_id, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), whole),
gains AS (
  SELECT row, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // words)))) AS gain
  FROM postings JOIN weights USING (term) JOIN lengths USING (row), whole),
scores AS (
  SELECT item_id, row, doc_id, sum(gain)::BIGINT AS score FROM wanted JOIN gains USING (term) GROUP BY item_id, row, doc_id),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST)::INT AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
