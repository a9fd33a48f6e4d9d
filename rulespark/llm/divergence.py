"""Source divergence audit by sort-based streaming.

Tasks that scan documents count each term within a block of documents and
emit partial runs (lang, term, source, first document of the block, documents,
occurrences).  Dealt out by (lang, term) and sorted by (lang, term, source,
document), the languages and terms in the order of their hash, they are read as runs: the end of a run of equal (lang, term, source) is
a count, the end of a run of equal (lang, term) tells whether the language
keeps the term.  Kept terms, a run of sources each, are read a second time;
each task sums the divergences of pairs of sources and holds the best terms
of each source, and emits these partial results once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulespark.llm.common import map_arrow, shared_checkpoint
from rulespark.llm.texthash import IS_LETTER, slices, terms

#: Documents of a language that a kept term occurs in, and ranks of part ``term``.
LEAST_DOCUMENTS, MOST_TERMS = 10, 10

#: Partial runs that a task holds before it emits them.
HELD_RUNS = 2_000_000

#: Groups whose counts a task knows at a time, and sources whose pairs it sums at a time.
BLOCK_GROUPS, BLOCK_SOURCES = 200_000, 256

#: Cells (terms x sources) that are compared at a time.
CELLS = 1 << 18


def share(count: np.ndarray, total: np.ndarray | int, kept: int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / (total + 2 kept)), by long division so that nothing overflows below 9 * 10^15 terms."""
    whole = np.asarray(total, np.int64) + 2 * kept
    rest = np.asarray(count, np.int64) + 2
    out = rest // whole
    rest = rest % whole
    for _ in range(3):  # by 1000 each
        rest = rest * 1000
        out, rest = out * 1000 + rest // whole, rest % whole
    return 1 + out


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _partial_runs(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(lang, term, source, document, documents, occurrences): counts within blocks of documents of a task."""
    text = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("document"),
        F.col(text_col).cast("string").alias("text"),
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], int] = {}
        first: list[int] = []
        held: list[pa.Table] = []
        rows = 0

        def merged(tables: list[pa.Table]) -> pa.Table:
            whole = pa.concat_tables(tables)
            coded = whole["term"].combine_chunks().dictionary_encode()
            size = len(coded.dictionary)
            key = whole["group"].to_numpy().astype(np.int64) * size + coded.indices.to_numpy()
            order = np.argsort(key, kind="stable")
            key = key[order]
            new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            sums = {name: pa.array(np.add.reduceat(whole[name].to_numpy()[order], new)) for name in ("documents", "occurrences")}
            key = key[new]
            return pa.table({"group": pa.array(key // size, pa.int32()), "term": coded.dictionary.take(pa.array(key % size))} | sums)

        def emitted(found: pa.Table) -> Iterator[pa.RecordBatch]:
            names = list(groups)
            lang, source = (pa.array([n[k] for n in names], pa.string()) for k in (0, 1))
            for part in found.to_batches(max_chunksize=50_000):
                group = part.column("group")
                yield pa.RecordBatch.from_arrays(
                    [lang.take(group), part.column("term").cast(pa.binary()).cast(pa.string()), source.take(group), pa.array(first, pa.int64()).take(group), part.column("documents"), part.column("occurrences")],
                    names=["lang", "term", "source", "document", "documents", "occurrences"],
                )

        for batch in batches:
            langs, sources, ids = (batch.column(k).to_pylist() for k in range(3))
            for texts in slices(batch.column(3)):
                found, counts = terms(texts, IS_LETTER)
                if not len(found):
                    continue
                coded = found.dictionary_encode()
                size = len(coded.dictionary)
                key, times = np.unique(np.repeat(np.arange(len(counts)), counts) * size + coded.indices.to_numpy(), return_counts=True)
                owner = []
                for k in range(texts.first, texts.first + len(texts)):
                    name = (langs[k], sources[k])
                    if name not in groups:
                        groups[name] = len(first)
                        first.append(ids[k])
                    owner.append(groups[name])
                pair, inverse, documents = np.unique(np.array(owner)[key // size] * size + key % size, return_inverse=True, return_counts=True)
                occurrences = np.bincount(inverse, weights=times, minlength=len(pair)).astype(np.int64)
                term = coded.dictionary.take(pa.array(pair % size))
                held.append(pa.table({"group": pa.array(pair // size, pa.int32()), "term": term, "documents": pa.array(documents, pa.int64()), "occurrences": pa.array(occurrences, pa.int64())}))
                rows += len(pair)
                if rows > HELD_RUNS:
                    table = merged(held)
                    if len(table) > HELD_RUNS // 2:
                        yield from emitted(table)
                        groups, first, held, rows = {}, [], [], 0
                    else:
                        held, rows = [table], len(table)
        if held:
            yield from emitted(merged(held))

    return map_arrow(text, count, "lang string, term string, source string, document long, documents long, occurrences long")


def _new(*columns: pa.Array) -> np.ndarray:
    """Where a row differs from the one before it in any of the columns."""
    size = len(columns[0])
    out = np.ones(size, dtype=bool)
    if size > 1:
        out[1:] = False
        for c in columns:
            out[1:] |= pc.not_equal(c.slice(1), c.slice(0, size - 1)).to_numpy(zero_copy_only=False)
    return out


def kept_terms(runs: DataFrame, least: int) -> DataFrame:
    """(lang, term, sources, counts) of each term that ``least`` documents of its language hold, from sorted partial runs."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What the last batch ended in, unfinished: the rows of its last (lang, term).
        open_rows: pa.Table | None = None

        def finished(rows: pa.Table) -> pa.RecordBatch | None:
            rows = rows.combine_chunks()
            lang, term, source = (rows.column(n).combine_chunks() for n in ("lang", "term", "source"))
            run = np.flatnonzero(_new(lang, term, source))
            word = np.flatnonzero(_new(lang, term))
            documents = np.add.reduceat(rows.column("documents").to_numpy(), word)
            counts = np.add.reduceat(rows.column("occurrences").to_numpy(), run)
            bounds = np.append(np.searchsorted(run, word), len(run))
            keep = np.flatnonzero(documents >= least)
            if not len(keep):
                return None
            sizes = bounds[keep + 1] - bounds[keep]
            offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
            at = np.repeat(bounds[keep] - offsets[:-1], sizes) + np.arange(offsets[-1])
            return pa.RecordBatch.from_arrays(
                [lang.take(pa.array(word[keep])), term.take(pa.array(word[keep])), pa.ListArray.from_arrays(pa.array(offsets), source.take(pa.array(run[at]))), pa.ListArray.from_arrays(pa.array(offsets), pa.array(counts[at], pa.int64()))],
                names=["lang", "term", "sources", "counts"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            if open_rows is not None:
                rows = pa.concat_tables([open_rows, rows]).combine_chunks()
            starts = np.flatnonzero(_new(rows.column("lang").combine_chunks(), rows.column("term").combine_chunks()))
            if starts[-1] and (out := finished(rows.slice(0, int(starts[-1])))) is not None:
                yield out
            open_rows = rows.slice(int(starts[-1]))
            if len(open_rows) > 4096:
                # One term with many partial runs: add up those of equal sources, which are neighbours.
                open_rows = open_rows.combine_chunks()
                own = np.flatnonzero(_new(open_rows.column("source").combine_chunks()))
                sums = {n: pa.array(np.add.reduceat(open_rows.column(n).to_numpy(), own)) for n in ("documents", "occurrences")}
                open_rows = pa.table({n: sums.get(n, open_rows.column(n).take(pa.array(own))) for n in open_rows.column_names})
        if open_rows is not None and (out := finished(open_rows)) is not None:
            yield out

    return map_arrow(runs, scan, "lang string, term string, sources array<string>, counts array<long>")


def _partials(kept: DataFrame, langs: dict[str, tuple[int, list[str], np.ndarray]]) -> DataFrame:
    """Per task (lang, source, part, item, value): summed pairs and the best terms of each source.

    ``langs``: the kept terms, the sources in byte order and their totals of each language.
    """
    shared = kept.sparkSession.sparkContext.broadcast(langs)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = shared.value
        sums: dict[tuple[str, int], np.ndarray] = {}
        best: dict[tuple[str, int], list[tuple[int, bytes]]] = {}
        names = {lang: {s: k for k, s in enumerate(sources)} for lang, (_, sources, _) in langs.items()}

        def terms_of(lang: str, low: int, p: np.ndarray, q: np.ndarray, present: np.ndarray, term: list[bytes]) -> None:
            value = np.where(present & (p > q[:, None]), divergence(p, q[:, None]), -1)
            for k in range(p.shape[1]):
                column = value[:, k]
                mine = best.setdefault((lang, low + k), [])
                least = mine[-1][0] if len(mine) == MOST_TERMS else 0
                found = np.flatnonzero(column >= least)
                if len(found) > 4 * MOST_TERMS:  # none below the tenth largest of these can stay; ties with it can
                    tenth = np.partition(column[found], -MOST_TERMS)[-MOST_TERMS]
                    found = found[column[found] >= tenth]
                if len(found):
                    mine += [(int(column[i]), term[i]) for i in found]
                    mine.sort(key=lambda x: (-x[0], x[1]))
                    del mine[MOST_TERMS:]

        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([batch])
            for lang, block in set(zip(batch.column("lang").to_pylist(), batch.column("block").to_pylist())):
                own = whole.filter(pc.and_(pc.equal(whole["lang"], lang), pc.equal(whole["block"], block))).combine_chunks().to_batches()[0]
                kept_count, sources, totals = langs[lang]
                place = names[lang]
                step = max(1, CELLS // len(sources))
                low, high = block * BLOCK_SOURCES, min(len(sources), (block + 1) * BLOCK_SOURCES)
                for at in range(0, own.num_rows, step):
                    part = own.slice(at, step)
                    listed = part.column("sources")
                    sizes = pc.list_value_length(listed).to_numpy()
                    counts = np.zeros((part.num_rows, len(sources)), np.int64)
                    counts[np.repeat(np.arange(part.num_rows), sizes), [place[s] for s in listed.flatten().to_pylist()]] = part.column("counts").flatten().to_numpy()
                    p = share(counts, totals[None, :], kept_count)
                    pairs = sums.setdefault((lang, block), np.zeros((high - low, len(sources)), np.int64))
                    for k in range(low, high):
                        pairs[k - low] += divergence(p, p[:, k : k + 1]).sum(axis=0)
                    q = share(counts.sum(axis=1), int(totals.sum()), kept_count)
                    terms_of(lang, low, p[:, low:high], q, counts[:, low:high] > 0, [t.encode() for t in part.column("term").to_pylist()])
        for (lang, block), pairs in sums.items():
            sources = langs[lang][1]
            for k in range(len(pairs)):
                own = block * BLOCK_SOURCES + k
                yield _rows(lang, sources[own], "pair", [s for i, s in enumerate(sources) if i != own], np.delete(pairs[k], own))
        for (lang, own), mine in best.items():
            if mine:
                yield _rows(lang, langs[lang][1][own], "term", [t.decode() for _, t in mine], np.array([v for v, _ in mine], np.int64))

    return map_arrow(kept, scan, "lang string, source string, part string, item string, value long")


def _rows(lang: str, source: str, part: str, items: list[str], values: np.ndarray) -> pa.RecordBatch:
    size = len(items)
    return pa.RecordBatch.from_arrays([*(pa.array([v] * size, pa.string()) for v in (lang, source, part)), pa.array(items, pa.string()), pa.array(values, pa.int64())], names=["lang", "source", "part", "item", "value"])


def audit_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCUMENTS, block_groups: int = BLOCK_GROUPS) -> DataFrame:
    """How far the sources of a language differ: (lang, source, part, item, value, rank).

    Terms are runs of letters and characters beyond ASCII, A-Z lower-cased, in
    whole texts; a language keeps the V terms that occur in at least ``least`` of
    its documents.  A source (and a language) with N occurrences of kept terms
    gives a kept term p = 1 + floor(10^9 (count + 2) / (N + 2V)).  Part ``pair``
    ranks the other sources of the language by the sum over its kept terms of
    floor((p - q)^2 / (p + q)); part ``term`` the ten kept terms of the source
    whose p exceeds that of the language by the same measure.  Ties go by the UTF-8 of
    the item.

    Null texts, languages and sources count as ''.  Every row is a document.
    Groups without terms and languages that keep none have pairs of value 0 or of
    smoothing alone.  A language's only source has no pairs.  An empty table
    gives no rows; other columns are ignored, whatever their names.

    Sources and totals of a language reach the tasks as broadcast arrays, languages
    in blocks of about ``block_groups`` groups.
    """
    spark = docs.sparkSession
    groups = shared_checkpoint(docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source")).distinct())
    runs = _partial_runs(docs, id_col, text_col, lang_col, source_col)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A hash of (lang, term) comes first: most comparisons then end at the first eight bytes, and the runs are the same.
    dealt = runs.repartition(parts, "lang", "term").sortWithinPartitions(F.xxhash64("lang", "term"), "lang", "term", "source", "document")
    kept = shared_checkpoint(kept_terms(dealt.select("lang", "term", "source", "documents", "occurrences"), least))
    totals = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("c")).groupBy("lang", F.col("c.sources").alias("source")).agg(F.sum("c.counts").alias("total"))
    totals = groups.join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"))
    totals = shared_checkpoint(totals.join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept")), "lang", "left").select("lang", "source", "total", F.coalesce("kept", F.lit(0)).alias("kept")))

    blocks = max(1, -(-totals.count() // block_groups))
    block = F.pmod(F.xxhash64("lang"), F.lit(blocks))
    found = []
    for b in range(blocks):
        langs: dict[str, tuple[int, list[str], list[int]]] = {}
        for r in sorted(totals.where(block == b).collect(), key=lambda r: (r["lang"], r["source"].encode())):
            own = langs.setdefault(r["lang"], (r["kept"], [], []))
            own[1].append(r["source"])
            own[2].append(r["total"])
        known = {lang: (kept_count, sources, np.array(sums, np.int64)) for lang, (kept_count, sources, sums) in langs.items()}
        split = [lang for lang, (_, sources, _) in known.items() if len(sources) > BLOCK_SOURCES]
        copies = F.lit(1)
        for lang in split:
            copies = F.when(F.col("lang") == lang, -(-len(known[lang][1]) // BLOCK_SOURCES)).otherwise(copies)
        rows = kept.where(block == b).withColumn("block", F.explode(F.sequence(F.lit(0), copies - 1)))
        part = _partials(rows, known)
        found.append(part if blocks == 1 else shared_checkpoint(part))
    partial = found[0]
    for more in found[1:]:
        partial = partial.unionByName(more)
    # Languages that keep no term have pairs, too.
    bare = totals.where("kept = 0")
    none = bare.join(bare.select("lang", F.col("source").alias("item")), "lang").where("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    whole = partial.unionByName(none).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item"))
    return whole.withColumn("rank", rank.cast("int")).where((F.col("part") == "pair") | (F.col("rank") <= MOST_TERMS))


SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
tokens AS (
  SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM texts),
vocabulary AS (SELECT lang, term FROM tokens GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
sizes AS (SELECT lang, count(*)::BIGINT AS v FROM vocabulary GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM texts),
counts AS (SELECT lang, source, term, count(*)::BIGINT AS c FROM tokens JOIN vocabulary USING (lang, term) GROUP BY lang, source, term),
totals AS (SELECT lang, source, coalesce(sum(c), 0)::BIGINT AS n FROM groups LEFT JOIN counts USING (lang, source) GROUP BY lang, source),
shares AS (
  SELECT lang, source, term, coalesce(c, 0) AS c, 1 + (1000000000 * (coalesce(c, 0) + 2)) // (n + 2 * v) AS p
  FROM totals JOIN vocabulary USING (lang) JOIN sizes USING (lang) LEFT JOIN counts USING (lang, source, term)),
whole AS (
  SELECT lang, term, 1 + (1000000000 * (c + 2)) // (n + 2 * v) AS q
  FROM (SELECT lang, term, sum(c)::BIGINT AS c FROM counts GROUP BY lang, term) JOIN (SELECT lang, sum(n)::BIGINT AS n FROM totals GROUP BY lang) USING (lang) JOIN sizes USING (lang)),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS other, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p))::BIGINT AS value
    FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY x.lang, x.source, y.source) s
  ON s.lang = a.lang AND s.source = a.source AND s.other = b.source),
telling AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM shares JOIN whole USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM telling))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
