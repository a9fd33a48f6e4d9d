"""MinHash near-duplicate detection whose links are all confirmed on full shingle sets.

1. Each text becomes its set of distinct word windows; texts with equal sets
   form one class, named by its smallest id.
2. Universal hash minima of a class are cut into bands; classes that agree in
   a band share a bucket.
3. Each member of a bucket is compared with the bucket's smallest class: first
   on the signature, then on the full sets.  Alternating large-star and
   small-star joins what is linked.
4. Buckets that still hold several components are compared pair by pair inside
   a task (large ones in blocks), again on full sets; only links of a spanning
   forest leave the task.  So no link that banding finds is lost, and a group
   of copies never becomes rows for all its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespark.llm import texthash as th
from rulespark.llm.common import drop_shared, join_narrow, map_arrow, shared_checkpoint
from rulespark.llm.graph import connected_components

#: At a similarity of 0.75, 32 bands of 4 minima miss a pair with probability 5e-6.
BANDS, ROWS = 32, 4

#: A signature of 128 bytes estimates 0.75 with a deviation of 0.04; five of them are allowed for.
SIGNATURE_MARGIN = 0.2

#: Members of a bucket compared at a time in one task.
BLOCK = 512

SIGNED = "id long, version long, n_shingles long, h1 long, h2 long, sketch binary, bands array<long>"


def signer(width: int, bands: int, rows: int):
    """Arrow batches of (id, version, text) to batches of SIGNED."""
    a = th.constants(bands * rows, 11)
    b = th.constants(bands * rows, 13, odd=False)

    def one(texts: th.Texts) -> dict:
        hashes, text = th.lowered_windows(texts, width)
        n = len(texts)
        counts = np.bincount(text, minlength=n)
        some = np.flatnonzero(counts)
        first = (np.cumsum(counts) - counts)[some]
        minima = np.zeros((bands * rows, n), dtype=np.uint64)
        h1, h2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        if len(some):
            with np.errstate(over="ignore"):
                h1[some] = np.add.reduceat(th.mix(hashes + np.uint64(1)), first)
                h2[some] = np.add.reduceat(th.mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), first)
                room = np.empty_like(hashes)
                for k in range(bands * rows):
                    np.multiply(hashes, a[k], out=room)
                    room += b[k]
                    minima[k, some] = np.minimum.reduceat(room, first)
        sketch = (minima >> np.uint64(56)).astype(np.uint8)
        keys = np.zeros((n, bands), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for j in range(bands):
                key = np.full(n, j + 1, dtype=np.uint64)
                for k in range(rows):
                    key = th.mix(key * np.uint64(0x9E3779B97F4A7C15) + minima[j * rows + k])
                keys[:, j] = key
        return {"n": counts, "h1": h1.view(np.int64), "h2": h2.view(np.int64), "sketch": sketch, "keys": keys.view(np.int64)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in th.slices(batch.column(2)):
                x = one(texts)
                n = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(texts.first, n),
                        batch.column(1).slice(texts.first, n),
                        pa.array(x["n"], pa.int64()),
                        pa.array(x["h1"], pa.int64()),
                        pa.array(x["h2"], pa.int64()),
                        pa.array([bytes(s) for s in np.ascontiguousarray(x["sketch"].T)], pa.binary()),
                        th.list_array(x["keys"].ravel(), np.full(n, bands), pa.int64()),
                    ],
                    names=["id", "version", "n_shingles", "h1", "h2", "sketch", "bands"],
                )

    return run


def set_maker(width: int):
    """Arrow batches of (id, text) to (id, shingles): sorted 64-bit window hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in th.slices(batch.column(1)):
                hashes, text = th.lowered_windows(texts, width)
                cut = np.searchsorted(text, np.arange(len(texts) + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(texts.first, len(texts)),
                        pa.array([hashes[cut[i] : cut[i + 1]].tobytes() for i in range(len(texts))], pa.binary()),
                    ],
                    names=["id", "shingles"],
                )

    return run


def _signature_filter(least: float):
    """Keep pairs whose 8-bit signatures agree as often as a similarity of ``least`` makes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            y = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            agree = ((x == y).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
            kept = pa.array(agree >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], names=["a", "b"])

    return run


def _confirm(percent: int):
    """Pairs with both shingle sets to the pairs whose similarity is ``percent`` per cent or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                small, large = min(len(x), len(y)), max(len(x), len(y))
                same = 0
                if small and 100 * small >= percent * large:
                    place = np.searchsorted(y, x)
                    same = int((y[np.minimum(place, len(y) - 1)] == x).sum())
                good.append(bool(small) and 100 * same >= percent * (len(x) + len(y) - same))
            kept = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], names=["a", "b"])

    return run


def link_block(ids: np.ndarray, parts: np.ndarray, sets: list[np.ndarray], left: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between members of different parts.

    Of pairs on the same side (``left``) or across, only those across are
    compared if the block is a pair of blocks, all if it is one block.
    """
    sizes = np.array([len(s) for s in sets])
    values = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    names, column, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], number[column[keep]]
    total = int(shared.sum())
    inter = np.zeros((len(sets), len(sets)), dtype=np.float32)
    step = 4096
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, total, step):
        a, b = np.searchsorted(column, [at, at + step])
        dense = np.zeros((len(sets), min(step, total - at)), dtype=np.float32)
        dense[owner[a:b], column[a:b] - at] = 1
        inter += dense @ dense.T
    union = sizes[:, None] + sizes[None, :] - inter
    linked = (100 * inter >= percent * union) & (union > 0) & (parts[:, None] != parts[None, :])
    if left.any() and not left.all():
        linked &= left[:, None] != left[None, :]
    root = {int(p): int(p) for p in np.unique(parts)}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(np.triu(linked, 1))):
        p, q = find(int(parts[i])), find(int(parts[j]))
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((int(ids[i]), int(ids[j])))
    return out


def _link_group(percent: int):
    def run(group: pa.Table) -> pa.Table:
        ids = group.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in group.column("shingles")]
        found = link_block(
            ids[order],
            group.column("part").to_numpy()[order],
            [sets[i] for i in order],
            (group.column("block").to_numpy() == group.column("i").to_numpy())[order],
            percent,
        )
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return run


def linked_components(
    banded: DataFrame,
    make_sets: Callable[[DataFrame], DataFrame],
    percent: int,
    prefilter: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Components of nodes that share a bucket and whose sets are similar enough: (node, component).

    ``banded`` has (node, bucket), a node once (or a few times) per bucket;
    ``make_sets`` takes the nodes that share a bucket (column ``id``) and
    returns (id, shingles); ``prefilter`` thins pairs (a, b) before sets are read.
    Nodes that are linked with nothing are left out.
    """
    heads = banded.groupBy("bucket").agg(F.min("node").alias("head"), F.max("node").alias("tail")).where("head != tail").select("bucket", "head")
    members = shared_checkpoint(banded.join(heads, "bucket").select("bucket", "node", "head"))

    pairs = members.where("node != head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    if prefilter is not None:
        pairs = prefilter(pairs)
    sets = shared_checkpoint(make_sets(members.select(F.col("node").alias("id")).distinct()))
    links = (
        pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
        .select("a", "b", "x", "y")
        .transform(map_arrow, _confirm(percent), "a long, b long")
        .select(F.col("a").alias("u"), F.col("b").alias("v"))
    )
    found = connected_components(links)

    placed = members.join(found, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("part"))
    mixed = (
        placed.groupBy("bucket")
        .agg(
            F.min("part").alias("low"),
            F.max("part").alias("high"),
            F.count(F.lit(1)).alias("members"),
            F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who"),
        )
        .where("low != high AND members > 2")
        .groupBy("members", "who")
        .agg(F.min("bucket").alias("bucket"))
    )
    # Block numbers come from a hash, so that a large bucket needs no sort; a bucket of one block stays whole.
    spread = (
        placed.join(mixed.select("bucket", "members"), "bucket")
        .withColumn("blocks", F.when(F.col("members") <= BLOCK, F.lit(1)).otherwise(F.ceil(F.col("members") / F.lit(BLOCK // 2))).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("bucket", F.col("node").alias("id"), "part", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    )
    more = shared_checkpoint(
        spread.join(sets, "id")
        .groupBy("bucket", "i", "j")
        .applyInArrow(_link_group(percent), "a long, b long")
        .select(F.col("a").alias("u"), F.col("b").alias("v"))
    )
    for done in (members, sets):
        drop_shared(done)
    if more.isEmpty():
        return found
    return connected_components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 75,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_shingles, component_id, kept, version).

    Texts are linked if their sets of ``width``-word windows (A-Z lower-cased,
    words split at white space) share ``percent`` per cent of the union or
    more; a text with fewer words counts as one window.  ``component_id`` is
    the smallest id that links reach, ``kept`` marks the row of that id;
    ``version`` is xxhash64 of the text, which tells two texts of an id apart.

    Null and empty texts and texts of white space have no window: linked with
    nothing, ``component_id`` their own id.  A null id names no component: the
    row takes the one of its equal texts and is kept only if there is none.
    Rows are judged by their texts: repeated rows get equal results, an id
    with two texts one for either; an id that is the smallest of both links
    them.  Other columns are ignored, whatever their names; an empty table
    gives an empty result.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text"))
    signed = shared_checkpoint(source.transform(map_arrow, signer(width, bands, rows), SIGNED))
    names = ("n_shingles", "h1", "h2")
    classes = (
        signed.where("n_shingles > 0")
        .groupBy(*names)
        .agg(F.min("id").alias("node"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
        .where("node IS NOT NULL")
    )
    classes = shared_checkpoint(classes)

    banded = classes.select("node", F.explode("bands").alias("bucket"))
    sketches = classes.select("node", "sketch")

    def by_signature(pairs: DataFrame) -> DataFrame:
        return (
            pairs.join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("x")), "a")
            .join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("y")), "b")
            .select("a", "b", "x", "y")
            .transform(map_arrow, _signature_filter(percent / 100 - SIGNATURE_MARGIN), "a long, b long")
        )

    def sets_of(wanted: DataFrame) -> DataFrame:
        return join_narrow(source.select("id", "text"), wanted, "id", "left_semi").transform(map_arrow, set_maker(width), "id long, shingles binary")

    found = linked_components(banded, sets_of, percent, by_signature)

    named = classes.select(*names, "node").join(found, "node", "left").select(*names, F.coalesce("component", "node").alias("component_id"))
    return (
        signed.select("id", "version", *names)
        .join(named, list(names), "left")
        .select(
            F.col("id").alias("doc_id"),
            "n_shingles",
            F.coalesce("component_id", "id").alias("component_id"),
            F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.col("component_id").isNull()).alias("kept"),
            "version",
        )
    )
