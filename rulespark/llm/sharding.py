"""Sharding by sampled splitters, with DataFrame operations only.

Records are ordered by a hash of their text, then by id, so equal texts lie
together.  A size-weighted sample of the order keys gives quantile boundaries
that cut the order into ranges; a key that fills more than a range (one text
with very many copies) is cut again by id, and an id that fills such a part by
the turn of its rows.  The totals of the ranges, a table of bounded size, place
each range in the whole order, and a running sum within each range places its
records.  Equal texts go together to the part of the total bytes in which their
middle lies, so each shard misses its share by half a group of equal texts at
either end at most; only a group that is larger than a shard's share is dealt
record by record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulespark.llm.common import shared_checkpoint

#: Records aimed at in a range, and the least and most ranges; samples drawn for each range.
RANGE_ROWS, LEAST_RANGES, MOST_RANGES, SAMPLES = 500_000, 96, 8_192, 40

#: Bounds looked through in one step of the two-step search.
STEP = 64

LAW = "bytes"


def _at_or_below(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are at most ``value``, in two steps of STEP comparisons or fewer."""
    if not bounds:
        return F.lit(0)
    parts = [bounds[i : i + STEP] for i in range(0, len(bounds), STEP)]
    heads = F.lit([p[0] for p in parts]).cast("array<bigint>")
    table = F.array(*(F.lit(p).cast("array<bigint>") for p in parts))
    part = F.size(F.filter(heads, lambda b: b <= value))
    inner = F.size(F.filter(F.element_at(table, F.greatest(part, F.lit(1))), lambda b: b <= value))
    return F.when(part == 0, 0).otherwise((part - 1) * STEP + inner)


def _quantiles(column: str, count: int) -> Column:
    return F.percentile_approx(column, [k / count for k in range(1, count)] or [0.5], 100_000)


def _bounds(rows: DataFrame, sample: DataFrame, totals: dict[tuple[int, ...], int], keys: list[str], column: str, target: int) -> DataFrame:
    """(keys, bounds): for each of the keys, where the sample cuts its bytes into parts of about ``target``.

    A value that is a quantile twice fills a part and gets one of its own.
    """
    spark = rows.sparkSession
    schema = ", ".join(f"{k} int" for k in keys)
    hot = spark.createDataFrame([*totals], schema)
    most = max((-(-b // target) for b in totals.values()), default=1)
    found = {tuple(r[k] for k in keys): sorted(r["q"] or []) for r in (sample.join(F.broadcast(hot), keys).groupBy(*keys).agg(_quantiles(column, most).alias("q")).collect() if totals else [])}
    listed = []
    for key, size in totals.items():
        q = found.get(key, [])
        stride = max(1, len(q) * target // max(1, size))
        listed.append((*key, sorted({*q[::stride], *(x for k, after in zip(q, q[1:]) if k == after for x in (k, k + 1))})))
    return spark.createDataFrame(listed, f"{schema}, bounds array<bigint>")


def _cut(rows: DataFrame, bounds: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the part of its key that a row falls into, 0 where the key has no bounds or the value is null."""
    part = 1 + F.size(F.filter("bounds", lambda b: b <= F.col(column)))
    return rows.join(F.broadcast(bounds), keys, "left").withColumn(name, F.when(F.col("bounds").isNull() | F.col(column).isNull(), 0).otherwise(part)).drop("bounds")


def shard_records(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per row of ``docs``: (doc_id, size, text_crc32, law, shard, slot, grown_shard).

    ``size`` is the UTF-8 length of the text plus 8.  In the order by (60 bits
    of the text's MD5, id, nulls first) a group of equal texts whose middle has b
    of the B bytes before it goes to shard floor(b * shards / B); a group of
    more than B / shards bytes is dealt by the middles of its records.  ``slot``
    counts the records of a shard from 0 in the same order.  The law is
    ``bytes``, so ``grown_shard`` is null.

    A null text has size 8 and the checksum of no bytes, and comes before all
    others.  Rows that are equal in id and text are interchangeable.  Other
    columns are ignored, whatever their names; an empty table gives an empty
    result.
    """
    records = shared_checkpoint(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text_col), F.lit(0)) + 8).cast("long").alias("size"),
            F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
            F.coalesce(F.conv(F.substring(F.md5(F.col(text_col).cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(-1)).alias("key"),
            F.monotonically_increasing_id().alias("turn"),
        )
    )
    whole = records.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    total, rows = whole["bytes"] or 0, whole["rows"]
    ranges = max(LEAST_RANGES, min(MOST_RANGES, -(-rows // range_rows)))
    target = max(1, total // ranges)

    # A record is drawn with a probability in proportion to its size.
    chance = F.pmod(F.xxhash64("key", "doc_id", "turn"), F.lit(1 << 30)).cast("double") / float(1 << 30)
    sample = records.where(chance * float(max(total, 1)) < F.col("size") * float(ranges * SAMPLES))
    drawn = sample.agg(_quantiles("key", ranges).alias("q")).first()["q"] or []
    # A key that is a boundary twice fills a range: it gets one of its own.
    bounds = sorted({*drawn, *(k + 1 for k, after in zip(drawn, drawn[1:]) if k == after)})
    ranged = records.withColumn("range", _at_or_below(F.col("key"), bounds))
    full = (
        ranged.groupBy("range")
        .agg(F.sum("size").alias("bytes"), F.min("key").alias("low"), F.max("key").alias("high"))
        .where((F.col("bytes") > 2 * target) & (F.col("low") == F.col("high")))
        .collect()
    )
    keyed = sample.withColumn("range", _at_or_below(F.col("key"), bounds))
    of_ranges = _bounds(records, keyed, {(r["range"],): r["bytes"] for r in full}, ["range"], "doc_id", target)
    ranged, keyed = _cut(ranged, of_ranges, ["range"], "doc_id", "part"), _cut(keyed, of_ranges, ["range"], "doc_id", "part")
    wide = []
    if full:
        parts = ranged.join(F.broadcast(of_ranges.select("range")), "range").groupBy("range", "part")
        parts = parts.agg(F.sum("size").alias("bytes"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("doc_id").alias("known"), F.count(F.lit(1)).alias("rows"))
        wide = parts.where((F.col("bytes") > 2 * target) & F.col("low").eqNullSafe(F.col("high")) & F.col("known").isin(F.lit(0), F.col("rows"))).collect()
    of_parts = _bounds(records, keyed, {(r["range"], r["part"]): r["bytes"] for r in wide}, ["range", "part"], "turn", target)
    ranged = _cut(ranged, of_parts, ["range", "part"], "turn", "sub")

    # At most a few ranges for each boundary: this table is small, and one window orders it.
    cells = ["range", "part", "sub"]
    order = Window.orderBy(*cells).rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(*cells).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    starts = starts.select(*cells, "bytes", F.coalesce(F.sum("bytes").over(order), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(order), F.lit(0)).alias("rows_before"))
    whole_range = Window.partitionBy("range")
    starts = starts.select(*cells, "bytes_before", "rows_before", F.min("bytes_before").over(whole_range).alias("range_before"), F.sum("bytes").over(whole_range).alias("range_bytes"))
    starts = starts.join(F.broadcast(of_ranges.select("range", F.lit(True).alias("one_key"))), "range", "left")

    inside = Window.partitionBy(*cells).orderBy("key", F.col("doc_id").asc_nulls_first(), "turn")
    group = Window.partitionBy(*cells, "key")
    before = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.withColumn("before", before).withColumn("number", F.row_number().over(inside))
    placed = placed.withColumn("group_before", F.min("before").over(group)).withColumn("group_bytes", F.sum("size").over(group)).join(F.broadcast(starts), cells)
    # The group of a range that is cut into parts is the range; any other lies within one range.
    start = F.when(F.col("one_key"), F.col("range_before")).otherwise(F.col("bytes_before") + F.col("group_before"))
    size = F.when(F.col("one_key"), F.col("range_bytes")).otherwise(F.col("group_bytes"))
    placed = placed.withColumn("group_start", start).withColumn("group_size", size)
    middle = F.expr(f"CASE WHEN group_size * {shards}L <= {total}L THEN 2 * group_start + group_size ELSE 2 * (bytes_before + before) + size END")
    placed = placed.withColumn("middle", middle).select(
        "doc_id",
        "size",
        "text_crc32",
        F.least(F.expr(f"(middle * {shards}L) div {max(2 * total, 1)}L"), F.lit(shards - 1)).cast("int").alias("shard"),
        (F.col("rows_before") + F.col("number") - 1).alias("place"),
    )
    placed = shared_checkpoint(placed)
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        "shard",
        (F.col("place") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


SQL = """
WITH recursive_table AS (
  SELECT list(c ORDER BY n) AS tab FROM (
    SELECT n, list_reduce(list_prepend(n::BIGINT, range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) AS c
    FROM range(0, 256) AS t(n))),
bytes AS (
  SELECT doc_id, text, strlen(coalesce(text, '')) + 8 AS size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS b,
    coalesce(('0x' || substr(md5(text), 1, 15))::BIGINT, -1) AS key
  FROM documents),
placed AS (
  SELECT doc_id, size, key,
    xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(tab[1 + (xor(c, x) & 255)], c >> 8))) AS text_crc32,
    coalesce(sum(size) OVER (ORDER BY key, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
    (sum(size) OVER ())::BIGINT AS total, (sum(size) OVER (PARTITION BY key))::BIGINT AS group_size
  FROM bytes, recursive_table),
grouped AS (SELECT *, min(before) OVER (PARTITION BY key) AS group_start FROM placed),
dealt AS (SELECT *, least(CASE WHEN group_size * 24 <= total THEN 2 * group_start + group_size ELSE 2 * before + size END * 24 // (2 * total), 23)::INT AS shard FROM grouped)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY key, doc_id NULLS FIRST) - 1 AS slot, NULL::INT AS grown_shard
FROM dealt
"""
