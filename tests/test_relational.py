"""Look-ups of parts in texts, and products of lists, against plain loops."""

import random

import pytest

from rulespark.operators import relational as ops


def pairs(texts, parts):
    return sorted((k, i) for k, t in texts for i, p in parts if t and p and p in t)


@pytest.mark.parametrize("short_list", [0, 500])
def test_parts_of_all_lengths_are_found(spark, monkeypatch, short_list):
    monkeypatch.setattr(ops, "SHORT_LIST", short_list)
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcde \n漢🙂") for _ in range(n))
    texts = [(k, text(rng.choice([0, 5, 127, 128, 129, 600, 2000]))) for k in range(60)]
    texts += [(100, texts[7][1]), (101, None), (102, "x" * 5000)]
    parts = [(0, ""), (1, None), (2, "漢"), (3, "x" * 300), (4, "y")]
    for i, n in enumerate([1, 2, 7, 8, 9, 23, 24, 25, 127, 128, 151, 152, 300] * 3):
        source = texts[rng.randrange(60)][1]
        at = rng.randrange(max(1, len(source) - n))
        parts.append((10 + i, source[at : at + n] + ("" if i % 4 else "zz")))
    parts.append((99, parts[8][1]))
    rows, listed = spark.createDataFrame(texts, "k long, t string"), spark.createDataFrame(parts, "i long, p string")
    found = sorted((r["k"], r["i"]) for r in ops.holding(rows, "t", listed, "p").collect())
    assert found == pairs(texts, parts) and len(found) > 60
    assert ops.holding(rows, "t", listed.where("i < 2"), "p").columns == ["k", "t", "i", "p"]
    assert ops.holding(rows, "t", listed.where("i < 2"), "p").count() == ops.holding(rows.limit(0), "t", listed, "p").count() == 0
    bare = [(k, "".join((t or "").split())) for k, t in texts], [(i, "".join((p or "").split())) for i, p in parts]
    again = ops.reappearing_texts(rows, "t", listed, "i", "p")
    assert again.columns == ["k", "t", "i"] and sorted((r["k"], r["i"]) for r in again.collect()) == pairs(*bare)


def test_look_up_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(ops, "SHORT_LIST", 0)
    monkeypatch.setattr(ops, "BROADCAST_ROWS", 1)
    texts, parts = [(k, f"row {k} of the table " * 4) for k in range(50)], [(i, f"row {i} of the table row {i}") for i in range(0, 60, 7)]
    found = ops.holding(spark.createDataFrame(texts, "k long, t string"), "t", spark.createDataFrame(parts, "i long, p string"), "p")
    assert sorted((r["k"], r["i"]) for r in found.collect()) == pairs(texts, parts)


def test_missing_combinations_in_several_cells(spark, monkeypatch):
    monkeypatch.setattr(ops, "CELL_ROWS", 4)
    left, right = spark.range(11).selectExpr("id AS u"), spark.createDataFrame([(x,) for x in "aabcdefghi"] + [(None,)], "m string")
    have = spark.createDataFrame([(u, m) for u in range(11) for m in "abcdefghi" if (u + ord(m)) % 3], "u long, m string")
    want = sorted([(u, m) for u in range(11) for m in "abcdefghi" if not (u + ord(m)) % 3] + [(u, None) for u in range(11)], key=str)
    assert sorted(map(tuple, ops.missing_combinations(left, right, have).collect()), key=str) == want
