"""WARC archives as seekable Zstandard bundles.

A bundle is one file: records packed into independent Zstandard frames of
about FRAME_BYTES each, and at its end the seek table of the seekable format
(a skippable frame that any decompressor passes over), which tells the sizes
of all frames.  A reader that knows a record's frame and its offset within
the decompressed frame needs no other byte of the file.

Bundles are written by Spark's own committer, so a task that is lost and run
again leaves no second file: a bundle is one row of a text table with one row
a file, and the line separator that Spark writes after a row is the closing
magic number of the seek table.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespark.llm.common import BROADCAST_ROWS, map_arrow, shared_checkpoint, shared_folder

#: Bytes of records in a frame and in a bundle; a longer record has a frame, or a bundle, of its own.
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 16 << 20

#: Payloads below this many bytes are never replaced by a reference.
LEAST_PAYLOAD = 1000

#: Fixed values of the formats: little-endian magic numbers of skippable frame and seek table, and the revisit profile.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_END = struct.pack("<I", SEEKABLE)


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame that closes a bundle, for frames of (compressed, decompressed) bytes."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IB", len(frames), 0) + _END
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(content: bytes | memoryview) -> list[tuple[int, int, int]]:
    """(offset, compressed bytes, decompressed bytes) of each frame of a bundle, from its last bytes."""
    count, descriptor, magic = struct.unpack("<IBI", content[-9:])
    if magic != SEEKABLE or descriptor & 0x7C:
        raise ValueError("no seek table at the end of the bundle")
    each = 12 if descriptor & 0x80 else 8
    start = len(content) - 9 - count * each
    if struct.unpack("<I", content[start - 8 : start - 4])[0] != SKIPPABLE:
        raise ValueError("the seek table of the bundle is damaged")
    frames, offset = [], 0
    for k in range(count):
        packed, size = struct.unpack("<II", content[start + k * each : start + k * each + 8])
        frames.append((offset, packed, size))
        offset += packed
    return frames


def _line(text: str | None) -> str:
    """A header value: no line ends."""
    return (text or "").replace("\r", "%0D").replace("\n", "%0A")


def warc_record(record_id: str, page_id: int | None, uri: str | None, date: str, payload: bytes | None, size: int, digest: str, refers_to: str | None) -> bytes:
    """One record: an HTTP response with the payload, or if it refers to another record a revisit with the HTTP headers alone."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = f"WARC/1.1\r\nWARC-Type: {'revisit' if refers_to else 'response'}\r\nWARC-Record-ID: <{record_id}>\r\nWARC-Page-ID: {'' if page_id is None else page_id}\r\nWARC-Target-URI: {_line(uri)}\r\nWARC-Date: {date}\r\nWARC-Payload-Digest: sha1:{digest}\r\n"
    if refers_to:
        head += f"WARC-Profile: {REVISIT_PROFILE}\r\nWARC-Refers-To: <{refers_to}>\r\n"
    else:
        block += payload
    head += f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse_record(data: bytes | memoryview, offset: int) -> tuple[dict[str, str], int | None, memoryview, int]:
    """(headers, payload length that the HTTP headers tell, payload, end) of the record at ``offset`` of a decompressed frame."""
    view = memoryview(data)
    split = data.find(b"\r\n\r\n", offset)
    lines = bytes(view[offset:split]).decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no record starts here")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    start, size = split + 4, int(headers["Content-Length"])
    http = data.find(b"\r\n\r\n", start, start + size)
    told = None
    for line in bytes(view[start:http]).decode().split("\r\n"):
        if line.lower().startswith("content-length:"):
            told = int(line.split(":", 1)[1])
    return headers, told, view[http + 4 : start + size], start + size + 4


def _record_id(*parts: str | Column) -> Column:
    """A name-based id: the MD5 of the parts, in the form of a UUID."""
    text = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("-")) for p in parts]
    return F.concat(F.lit("urn:uuid:"), F.regexp_replace(F.md5(F.concat_ws("/", *text).cast("binary")), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"))


def join_unique(left: DataFrame, right: DataFrame, on: str, weight: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """Left join with a table that has each key once.

    Up to ``most`` rows it is broadcast after counting them.  Beyond
    that, the keys with more than one in 10,000 of the total ``weight`` (at most
    10,000 keys) are broadcast, rows without a key are not joined and the rest
    are shuffled, so no task gets a hot key.
    """
    if right.select(F.lit(1)).limit(most + 1).count() <= most:
        return left.join(F.broadcast(right.drop(weight)), on, "left")
    total = right.agg(F.sum(weight).alias("n")).first()["n"]
    hot = right.where(F.col(weight) * 10_000 > F.lit(total))
    marked = left.join(F.broadcast(hot.select(on, F.lit(True).alias("__hot"))), on, "left")
    often = marked.where("__hot").drop("__hot").join(F.broadcast(hot.drop(weight)), on, "left")
    seldom = marked.where(F.col("__hot").isNull() & F.col(on).isNotNull()).drop("__hot").join(right.where(F.col(weight) * 10_000 <= F.lit(total)).drop(weight), on, "left")
    return often.unionByName(seldom).unionByName(left.where(F.col(on).isNull()), allowMissingColumns=True)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", date: str = "2020-01-01T00:00:00Z", least: int = LEAST_PAYLOAD, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> None:
    """Write a record for each row of ``pages`` into bundles in ``folder``.

    Payloads are the UTF-8 of ``payload_col`` (null: empty).  Of rows with equal
    payloads of ``least`` bytes or more the one with the largest id is the
    response (null ids are the smallest; of rows that repeat the id one), the
    others are revisits that refer to it.  Shorter payloads are always
    responses.  A null uri is an empty one.  Other columns are ignored.

    ``pages`` is scanned twice, first for the digests alone; payloads are never
    shuffled unless over 1,000,000 of them have copies, or rows repeat the
    largest id of their payload: one payload of these is then sent on.
    """
    body = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(uri_col).cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload"))
    same = F.concat_ws("-", "digest", F.hex(F.xxhash64("payload")), F.col("bytes").cast("string"))
    rows = rows.withColumn("same", F.when(F.col("bytes") >= least, same))
    counted = rows.where("same IS NOT NULL").groupBy("same", "page_id").agg(F.count(F.lit(1)).alias("n"))
    groups = counted.groupBy("same").agg(F.max(F.struct("page_id", "n")).alias("top"), F.sum("n").alias("copies")).where("copies > 1")
    groups = shared_checkpoint(groups.select("same", F.col("top.page_id").alias("newest"), F.col("top.n").alias("newest_rows"), "copies"))

    known = join_unique(rows, groups, "same", "copies")
    owner = _record_id(F.lit("first"), "same", "newest")
    first = F.col("newest_rows").isNotNull() & F.col("page_id").eqNullSafe(F.col("newest"))
    fields = ["page_id", "url", "bytes", "digest"]
    alone = known.where(~first | (F.col("newest_rows") == 1)).select(
        F.when(first, owner).alias("record"), F.when(F.col("newest_rows").isNotNull() & ~first, owner).alias("refers_to"), F.when(F.col("newest_rows").isNull() | first, F.col("payload")).alias("payload"), *fields
    )
    if not groups.where("newest_rows > 1").isEmpty():
        repeated = known.where(first & (F.col("newest_rows") > 1)).withColumn("record", owner)
        lead = repeated.groupBy("record").agg(F.min(F.struct(F.col("url").isNotNull(), "url")).alias("lead"), F.first("payload").alias("payload"), *(F.first(c).alias(c) for c in ("page_id", "bytes", "digest")))
        lead = shared_checkpoint(lead.withColumn("url", F.col("lead.url")).withColumn("copies", F.lit(1)))
        times = repeated.groupBy("record", "url").agg(F.count(F.lit(1)).alias("n"))
        again = join_unique(times, lead.select("record", "page_id", "bytes", "digest", F.col("url").alias("taken"), "copies"), "record", "copies")
        again = again.withColumn("n", F.col("n") - F.when(F.col("url").eqNullSafe(F.col("taken")), 1).otherwise(0)).where("n > 0")
        # A row with very many copies is dealt out before it is written that often.
        some = F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(n - 1) div 10000"))).alias("chunk")
        again = again.select("record", "n", *fields, some).repartition("record", "chunk").select(F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(10_000).cast("long"), F.expr("n - 10000 * chunk")))).alias("copy"), "record", *fields)
        alone = alone.unionByName(lead.select("record", F.lit(None).cast("string").alias("refers_to"), "payload", *fields)).unionByName(
            again.select(F.lit(None).cast("string").alias("record"), F.col("record").alias("refers_to"), F.lit(None).cast("binary").alias("payload"), *fields)
        )
    own = _record_id(F.lit("row"), "page_id", F.monotonically_increasing_id())
    named = alone.select(F.coalesce("record", own).alias("record"), "page_id", "url", "payload", F.col("bytes").cast("long").alias("bytes"), "digest", "refers_to")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3, write_checksum=True)
        frames: list[bytes] = []
        sizes: list[tuple[int, int]] = []
        waiting: list[bytes] = []
        held = 0

        def frame() -> None:
            nonlocal held
            if waiting:
                data = b"".join(waiting)
                frames.append(packer.compress(data))
                sizes.append((len(frames[-1]), len(data)))
                waiting.clear()
                held = 0

        def bundle() -> pa.RecordBatch:
            # Spark ends the row with the last four bytes of the seek table.
            content = b"".join([*frames, seek_table(sizes)])[: -len(_END)]
            frames.clear()
            sizes.clear()
            return pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], names=["content"])

        total = 0
        for batch in batches:
            for k in range(batch.num_rows):
                name, page_id, uri, payload, size, digest, refers_to = (c[k].as_py() for c in batch.columns)
                data = warc_record(name, page_id, uri, date, payload, size, digest, refers_to)
                if held and held + len(data) > frame_bytes:
                    frame()
                if total and total + len(data) > bundle_bytes:
                    frame()
                    yield bundle()
                    total = 0
                waiting.append(data)
                held += len(data)
                total += len(data)
        frame()
        if frames:
            yield bundle()

    bundles = map_arrow(named, pack, "content binary").select(F.col("content").cast("string").alias("value"))
    bundles.write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", _END.decode("latin-1")).text(folder)


_RECORDS = "record string, page_id long, record_type string, uri string, refers_to string, told_digest string, told_bytes long, block_digest string, block_bytes long, path string, frame int, frame_offset long, record_offset long"


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the bundles in ``folder`` and where it is.

    (record, page_id, record_type, uri, refers_to, told_digest, told_bytes,
    block_digest, block_bytes, path, frame, frame_offset, record_offset): the
    told ones are what the headers say of the whole payload, the block ones are
    computed from the bytes that the record holds (none for a revisit).
    ``frame_offset`` is the place of the frame in the file, ``record_offset`` that of
    the record in the decompressed frame.  A damaged file is an error.
    """
    files = spark.read.format("binaryFile").load(folder).where("length > 0").select("path", "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                content = memoryview(content.as_buffer())
                for number, (offset, packed, size) in enumerate(read_seek_table(content)):
                    data = opener.decompress(content[offset : offset + packed], max_output_size=size)
                    rows, at = [], 0
                    while at < len(data):
                        headers, told, payload, end = parse_record(data, at)
                        page = headers["WARC-Page-ID"]
                        whole = (hashlib.sha1(payload).hexdigest(), len(payload)) if headers["WARC-Type"] == "response" else (None, None)
                        rows.append((headers["WARC-Record-ID"][1:-1], int(page) if page else None, headers["WARC-Type"], headers["WARC-Target-URI"], headers.get("WARC-Refers-To", "")[1:-1] or None, headers["WARC-Payload-Digest"].removeprefix("sha1:"), told, *whole, path, number, offset, at))
                        at = end
                    names = [c.split()[0] for c in _RECORDS.split(", ")]
                    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
                    kinds = [types[c.split()[1]] for c in _RECORDS.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)], names=names)

    return map_arrow(files, read, _RECORDS)


def fetch_records(spark: SparkSession, index: DataFrame, records: DataFrame) -> DataFrame:
    """(record, payload) of the ids in column ``record`` of ``records``, by their places in ``index`` (rows of ``read_archives``).

    Only the files that hold one of them are read, and of a file only the frames that do.
    An id that is not in the index gives no row; an id that is asked for twice gives one.
    """
    wanted = shared_checkpoint(index.join(records.select("record").distinct(), "record").select("record", "path", "frame_offset", "record_offset"))
    places = wanted.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("frame_offset", "record_offset", "record"))).alias("places"))
    paths = [r["path"] for r in places.select("path").limit(10_001).collect()]
    if not paths:
        return spark.createDataFrame([], "record string, payload binary")
    folder = [p.rpartition("/")[0] for p in paths[:1]] if len(paths) > 10_000 else paths
    files = spark.read.format("binaryFile").load(folder).select("path", "content").join(places, "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()
        for batch in batches:
            for places, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                content = memoryview(content.as_buffer())
                sizes = {offset: (packed, size) for offset, packed, size in read_seek_table(content)}
                last, data = None, b""
                for p in places:
                    if p["frame_offset"] != last:
                        last = p["frame_offset"]
                        packed, size = sizes[last]
                        data = opener.decompress(content[last : last + packed], max_output_size=size)
                    _, _, payload, _ = parse_record(data, p["record_offset"])
                    yield pa.RecordBatch.from_arrays([pa.array([p["record"]]), pa.array([bytes(payload)], pa.binary())], names=["record", "payload"])

    return map_arrow(files.select("places", "content"), read, "record string, payload binary")


def resolve_revisits(index: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record of ``index`` (rows of ``read_archives``).

    A response's bytes and digest are those of the payload that was read and
    must equal what its headers tell; a revisit's are those of the response
    that its reference leads to.  A record that contradicts this is an error.
    """
    referred = index.where("refers_to IS NOT NULL").groupBy("refers_to").agg(F.count(F.lit(1)).alias("copies"))
    targets = shared_checkpoint(
        index.where("record_type = 'response'")
        .select(F.col("record").alias("refers_to"), F.col("page_id").alias("target"), F.col("block_digest").alias("target_digest"), F.col("block_bytes").alias("target_bytes"))
        .join(referred, "refers_to")
    )
    resolved = join_unique(index, targets, "refers_to", "copies")
    digest, size = F.coalesce("block_digest", "target_digest"), F.coalesce("block_bytes", "target_bytes")
    fits = (digest == F.col("told_digest")) & (size == F.col("told_bytes"))
    sure = F.when(F.coalesce(fits, F.lit(False)), F.col("record_type")).otherwise(F.raise_error(F.concat(F.lit("damaged or lost record "), F.col("record"))))
    return resolved.select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), sure.alias("record_type"), F.col("target").alias("refers_to"))


def archive_pages(pages: DataFrame, folder: str | None = None, **options: object) -> DataFrame:
    """Write ``pages`` as archives (see ``write_archives``) and read them back (see ``resolve_revisits``).

    ``folder`` must not exist yet; by default it is a new one in the folder of
    ``spark.checkpoint.dir``.  An empty table gives an empty result.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark)}/archives/{uuid.uuid4().hex}"
    write_archives(pages, folder, **options)
    return resolve_revisits(shared_checkpoint(read_archives(spark, folder)))


SQL = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST) AS place, first_value(page_id) OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST) AS newest
  FROM payloads)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN payload_bytes >= 1000 AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND place > 1 THEN newest END AS refers_to
FROM numbered
"""
