"""Benchmark decontamination by spaced-seed hashing.

A mask looks at some words of a window and ignores the others, so a window in
which an ignored word was substituted still has the same hash.  The hashes of
the benchmark items, of a checked size, are looked up in every text; around
each hit the item is laid over the text and the best stretch is measured, with
substitutions counted.  A benchmark beyond the size bound is taken in blocks
of items, each of which is looked up in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespark.llm import texthash as th
from rulespark.llm.common import map_arrow

#: Which words of a window count, chosen greedily by the placements of substitutions that they leave unseen.
#: Together the first ones hit every stretch of 12 to 23 words of which a quarter or fewer are substituted, and so
#: every longer one, which has such a stretch within; the second ones do so for whole items of 5 to 11 words.
MASKS = ("111011", "110100011", "11001011", "110111", "11111")
SHORT_MASKS = ("1111", "11101", "10111", "11011", "110011")

#: Words of an overlap, and the share of them that must be equal, for a leak.
LEAST_OVERLAP, LEAST_SHARE = 12, 0.75

#: Items with fewer words can't be told from chance; they match nothing.
LEAST_ITEM_WORDS = 5

#: Bytes of benchmark text that are broadcast at a time.
BLOCK_BYTES = 32 << 20

LEAKS = "doc_id long, item_id long, doc_word int, item_word int, n_words int, n_equal int"


def _word_hashes(texts: th.Texts) -> tuple[th.Spans, np.ndarray]:
    """Runs of letters and digits, A-Z lower-cased."""
    found = th.spans(texts, th.TOKEN_CLASS[texts.data] == 1)
    return found, th.span_hashes(th.LOWER[texts.data], found)


def _masked(hashes: np.ndarray, owner: np.ndarray, mask: str, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each window under a mask: (hash, first word)."""
    width, size = len(mask), len(hashes)
    if size < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    factors = th.constants(width, 100 + seed)
    out = np.zeros(size - width + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k, c in enumerate(mask):
            if c == "1":
                out += hashes[k : size - width + 1 + k] * factors[k]
    place = np.flatnonzero(owner[: size - width + 1] == owner[width - 1 :])
    return th.mix(out[place]), place


class SeedIndex:
    """Masked window hashes of the benchmark items, sorted, with a bit table in front."""

    def __init__(self, ids: list[int | None], texts: list[str | None]):
        items = th.slices(pa.array(texts, pa.string()), limit=1 << 40)
        self.words: list[np.ndarray] = []
        self.ids: list[int | None] = []
        for part in items:
            found, hashes = _word_hashes(part)
            for i, n in enumerate(found.counts):
                if n >= LEAST_ITEM_WORDS:
                    self.ids.append(ids[part.first + i])
                    self.words.append(hashes[found.first[i] : found.first[i] + n])
        short = [len(w) < LEAST_OVERLAP for w in self.words]
        self.masks: list[str] = []
        self.tables = []
        for seed, mask in enumerate((*MASKS, *SHORT_MASKS)):
            # An item under LEAST_OVERLAP words has to match as a whole, and only such items are looked up by few words.
            own = [w if is_short == (seed >= len(MASKS)) else w[:0] for w, is_short in zip(self.words, short)]
            if not any(len(w) for w in own):
                continue
            self.masks.append(mask)
            parts = [_masked(w, np.zeros(len(w), np.int64), mask, len(self.tables)) for w in own]
            hashes = np.concatenate([h for h, _ in parts]) if parts else np.zeros(0, np.uint64)
            item = np.repeat(np.arange(len(parts)), [len(h) for h, _ in parts])
            place = np.concatenate([p for _, p in parts]) if parts else np.zeros(0, np.int64)
            order = np.argsort(hashes, kind="stable")
            bits = np.zeros(1 << 20, dtype=bool)
            bits[hashes >> np.uint64(44)] = True
            self.tables.append((hashes[order], item[order], place[order], bits))

    def hits(self, hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Distinct (text, item, word of the text minus word of the item)."""
        found = []
        for seed, mask in enumerate(self.masks):
            known, item, place, bits = self.tables[seed]
            own, at = _masked(hashes, owner, mask, seed)
            near = np.flatnonzero(bits[own >> np.uint64(44)])
            own, at = own[near], at[near]
            low, high = np.searchsorted(known, own, "left"), np.searchsorted(known, own, "right")
            times = high - low
            if not times.sum():
                continue
            source = np.repeat(np.arange(len(own)), times)
            entry = np.repeat(low - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
            found.append(np.stack([owner[at[source]], item[entry], at[source] - place[entry]], axis=1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)


def best_stretch(equal: np.ndarray, share: float) -> tuple[int, int, int]:
    """(start, words, equal words) of the stretch with the largest sum, an unequal word weighing share / (1 - share)."""
    score = np.where(equal, 1.0, -share / (1 - share))
    total = np.concatenate([[0.0], np.cumsum(score)])
    lowest = np.minimum.accumulate(total)
    end = int(np.argmax(total - lowest))
    start = int(np.argmin(total[: end + 1]))
    return start, end - start, int(equal[start:end].sum())


def longest_stretch(equal: np.ndarray, share: float) -> tuple[int, int, int]:
    """(start, words, equal words) of the longest stretch of which ``share`` or more are equal."""
    total = np.concatenate([[0.0], np.cumsum(equal - share)])
    # The first place whose running total is no larger than that of the end; sums are a little off.
    first = np.searchsorted(-np.minimum.accumulate(total), -total - 1e-9, "left")
    size = np.arange(len(total)) - first
    end = int(np.argmax(size))
    return int(first[end]), int(size[end]), int(equal[first[end] : end].sum())


def overlap(equal: np.ndarray, least_words: int, share: float) -> tuple[int, int, int] | None:
    """A stretch of ``least_words`` words or more of which ``share`` or more are equal: the best, if it is long enough, else the longest."""
    for stretch in (best_stretch, longest_stretch):
        start, size, same = stretch(equal, share)
        if size >= least_words:
            return start, size, same
    return None


def _look_up(index, carry: int, least_overlap: int, least_share: float):
    """(doc_id, text) to LEAKS; with ``carry`` columns after them, to these columns and whether there is a leak."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds: SeedIndex = index.value
        for batch in batches:
            for texts in th.slices(batch.column(1)):
                found, hashes = _word_hashes(texts)
                best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
                for text, item, shift in seeds.hits(hashes, found.owner):
                    words = seeds.words[item]
                    base, n = found.first[text], found.counts[text]
                    begin = base + shift if shift >= base else base
                    skip = int(begin - shift) if shift < base else 0
                    first = shift - base + skip
                    length = int(min(len(words) - skip, n - first))
                    if length <= 0:
                        continue
                    equal = words[skip : skip + length] == hashes[base + first : base + first + length]
                    if stretch := overlap(equal, min(least_overlap, len(words)), least_share):
                        start, size, same = stretch
                        key = (int(text), int(item))
                        best[key] = max(best.get(key, (0, 0, 0, 0)), (same, size, int(first + start), int(skip + start)))
                if carry:
                    flag = np.zeros(len(texts), dtype=bool)
                    flag[[k[0] for k in best]] = True
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(2 + k).slice(texts.first, len(texts)) for k in range(carry)] + [pa.array(flag)], names=[f"c{k}" for k in range(carry)] + ["leak"]
                    )
                    continue
                keys = sorted(best)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([texts.first + t for t, _ in keys], pa.int64())),
                        pa.array([seeds.ids[i] for _, i in keys], pa.int64()),
                        *(pa.array([best[k][c] for k in keys], pa.int32()) for c in (2, 3, 1, 0)),
                    ],
                    names=["doc_id", "item_id", "doc_word", "item_word", "n_words", "n_equal"],
                )

    return run


def _indexes(benchmark: DataFrame, item_col: str, text_col: str):
    """Broadcast seed indexes, each of a block of items of about BLOCK_BYTES at most."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES) or 1
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        rows = part.orderBy("item", "text").collect()
        yield spark.sparkContext.broadcast(SeedIndex([r["item"] for r in rows], [r["text"] for r in rows]))


def benchmark_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    least_overlap: int = LEAST_OVERLAP,
    least_share: float = LEAST_SHARE,
) -> DataFrame:
    """A row for each text and benchmark item that overlap: LEAKS.

    The overlap has ``least_overlap`` words or more (or all of a shorter item),
    of which ``least_share`` or more are equal at the same place; words are
    runs of letters and digits, A-Z lower-cased.  ``doc_word`` and
    ``item_word`` say where it starts.

    Null and empty texts overlap nothing, and neither do items under
    LEAST_ITEM_WORDS words.  Rows are taken one by one: a repeated row gives
    repeated results, a null id stays null.  Other columns are ignored; if
    either table is empty, so is the result.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for index in _indexes(benchmark, item_col, item_text_col):
        found = texts.transform(map_arrow, _look_up(index, 0, least_overlap, least_share), LEAKS)
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least_overlap: int = LEAST_OVERLAP, least_share: float = LEAST_SHARE) -> DataFrame:
    """The rows of ``docs``, all columns, whose text overlaps no benchmark item."""
    for index in _indexes(benchmark, item_col, item_text_col):
        names, fields = docs.columns, docs.schema.fields
        schema = ", ".join([f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(fields)] + ["leak boolean"])
        carried = docs.select(F.lit(None).cast("long").alias("d"), F.col(text_col).alias("t"), *(F.col(c).alias(f"c{k}") for k, c in enumerate(names)))
        found = carried.transform(map_arrow, _look_up(index, len(names), least_overlap, least_share), schema).where("NOT leak")
        docs = found.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(names)))
    return docs
