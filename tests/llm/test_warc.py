"""Archives: round trips, seek tables, revisits, against hashlib and SQL."""

import hashlib
import random

import duckdb
import pytest
import zstandard
from pyspark.sql import functions as F

from rulespark.llm import warc
from tests.llm.fixtures import sentence

PAGES = "page_id long, url string, html string"


def pages():
    rng = random.Random(12)
    long = sentence(rng, 400)
    rows = [(k, f"http://a/{k}", sentence(rng, rng.randint(1, 500))) for k in range(120)]
    rows += [(500 + k, "http://copy", long) for k in range(60)] + [(700, "http://twice", long)] * 3
    rows += [(800, None, "é" * 499 + "x"), (801, None, "é" * 499 + "x"), (802, "u", "é" * 500), (803, "u\r\nX: y", "é" * 500)]
    return [*rows, (900, "u", None), (901, "u", ""), (None, "u", None), (None, "u", long), (None, "v", "q" * 2000), (None, "v", "q" * 2000), (902, "u", "WARC/1.1\r\n\r\n\r\n" * 200), (903, "u", sentence(rng, 90_000)), (904, "u", "\x00 a\r\n\r\n")]


def expected(rows):
    newest = {}
    for page, _, html in rows:
        body = (html or "").encode()
        newest[body] = max(newest.get(body, -1), -1 if page is None else page)
    taken, out = set(), []
    for page, _, html in rows:
        body = (html or "").encode()
        own = -1 if page is None else page
        again = len(body) >= 1000 and (own != newest[body] or body in taken)
        if len(body) >= 1000 and own == newest[body]:
            taken.add(body)
        to = None if newest[body] == -1 else newest[body]
        out.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", to if again else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("warc") / "archive")
    rows = pages()
    out = warc.archive_pages(spark.createDataFrame(rows, PAGES).repartition(3), folder, frame_bytes=4096, bundle_bytes=60_000)
    return folder, rows, sorted(map(tuple, out.collect()), key=str)


def test_equals_brute_force_and_sql(archive):
    _, rows, out = archive
    assert out == expected(rows)
    con = duckdb.connect()
    con.sql("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    assert sorted(con.sql(warc.SQL).fetchall(), key=str) == out


def test_files_are_plain_zstandard_with_a_seek_table(spark, archive):
    folder, rows, _ = archive
    files = spark.read.format("binaryFile").load(folder).select("content").collect()
    records = 0
    for f in files:
        content = bytes(f["content"])
        whole = b"".join(zstandard.ZstdDecompressor().decompress(content[at : at + packed]) for at, packed, _ in warc.read_seek_table(content))
        plain = zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True).read()
        assert plain == whole and whole.startswith(b"WARC/1.1\r\n")
        at = 0
        while at < len(whole):
            *_, at = warc.parse_record(whole, at)
            records += 1
    assert records == len(rows) and len(files) > 3


def test_records_are_fetched_by_their_places(spark, archive):
    folder, rows, _ = archive
    index = warc.read_archives(spark, folder)
    some = index.where("record_type = 'response' AND page_id % 7 = 0")
    got = {r["record"]: bytes(r["payload"]) for r in warc.fetch_records(spark, index, some.unionByName(some)).collect()}
    of = {r["record"]: r["page_id"] for r in some.collect()}
    texts = {page: (html or "").encode() for page, _, html in rows}
    assert got and {of[k]: v for k, v in got.items()} == {of[k]: texts[of[k]] for k in of} and got.keys() == of.keys()
    assert warc.fetch_records(spark, index, some.limit(0)).collect() == []


def test_damage_and_lost_responses_are_errors(spark, archive):
    with pytest.raises(ValueError):
        warc.read_seek_table(b"x" * 40)
    index = warc.read_archives(spark, archive[0])
    with pytest.raises(Exception, match="lost record"):
        warc.resolve_revisits(index.where("record_type = 'revisit'")).collect()
    with pytest.raises(Exception, match="damaged"):
        warc.resolve_revisits(index.withColumn("block_bytes", F.col("block_bytes") + 1)).collect()


def test_hot_keys_beyond_the_broadcast_bound(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id") % 50)).alias("key"), "id")
    right = left.where("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    near, far = (sorted(map(tuple, warc.join_unique(left, right, "key", "n", most=most).select("id", "key", "top").collect()), key=str) for most in (100, 0))
    assert near == far and len(far) == 3000


def test_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], PAGES)
    assert warc.archive_pages(empty).collect() == []
    rows = pages()
    odd = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], PAGES + ", payload string, turn int, same string")
    assert sorted(map(tuple, warc.archive_pages(odd).collect()), key=str) == expected(rows)
