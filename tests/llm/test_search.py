"""Ranked search against brute force and SQL."""

import math
import random
import re
from collections import Counter

import duckdb

from rulespark.llm.search import SQL, rank_documents
from tests.llm.fixtures import clashing, frame, odd_rows, sentence

ITEMS = [(1, "alpha beta, Beta gamma"), (2, None), (3, "..."), (None, "the the é ü"), (4, "nowhere"), (5, "the alpha"), (5, "漢字 9x")]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def expected(rows, items, most):
    lists = [(r[0], Counter(words(r[1]))) for r in rows]
    n = sum(1 for _, c in lists if c)
    whole = sum(sum(c.values()) for _, c in lists)
    df = Counter(t for _, c in lists for t in c)
    wanted = {}
    for key, text in items:
        wanted.setdefault(key, set()).update(words(text))
    out = []
    for key, found in wanted.items():
        scored = []
        for doc, c in lists:
            m = 50 + (50 * sum(c.values()) * n) // whole if c else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in found if c[t])
            if score > 0:
                scored.append((-score, doc is not None, doc or 0, doc))
        out += [(key, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(scored)[:most])]
    return sorted(out, key=str)


def corpus():
    rng = random.Random(11)
    usual = ["alpha", "beta", "gamma", "the", "The", "é", "漢字", "9x", "THE"]
    rows = odd_rows() + [(100 + k // 2, " ".join(rng.choice(usual) if rng.random() < 0.2 else sentence(rng, 1) for _ in range(rng.randint(1, 60))), "en", "s", 1) for k in range(700)]
    copy = "alpha beta gamma the " * 3
    return rows + [(5000 - k, copy, "en", "s", 1) for k in range(300)] + [(None, copy, "en", "s", 1)] * 3


def test_equals_brute_force_and_sql(spark):
    rows = corpus()
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for most, blocks in ((50, 1 << 20), (7, 20)):
        out = rank_documents(frame(spark, rows).repartition(5), items, most=most, block_bytes=blocks)
        assert sorted(map(tuple, out.collect()), key=str) == expected(rows, ITEMS, most)
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT); CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", ITEMS)
    assert sorted(con.sql(SQL).fetchall(), key=str) == expected(rows, ITEMS, 50)


def test_clashing_names_and_empty_tables(spark):
    rows = corpus()
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert sorted(map(tuple, rank_documents(clashing(spark, rows), items).collect()), key=str) == expected(rows, ITEMS, 50)
    assert rank_documents(frame(spark, []), items).collect() == []
    assert rank_documents(frame(spark, rows), items.limit(0)).collect() == []
    assert rank_documents(frame(spark, [(1, None, None, None, None)]), items).collect() == []


def test_windows_are_cut_at_their_size(spark):
    rows = [(k, "alpha beta" if k % 3 else "alpha", "en", "s", 1) for k in range(9000)]
    items = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    out = rank_documents(frame(spark, rows).coalesce(1), items, most=5)
    assert sorted(map(tuple, out.collect()), key=str) == expected(rows, [(1, "alpha beta")], 5)
