"""Operators with one right answer, against brute force, SQL or the tokenizer library."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from rulespark.llm import licenses, sharding
from rulespark.llm.bpe import encode_texts
from rulespark.llm.decontaminate import LEAST_OVERLAP, MASKS, SHORT_MASKS, benchmark_leaks, overlap
from rulespark.llm.quality_rules import judge_quality
from rulespark.llm.queries import vocabulary_path
from tests.llm.fixtures import as_set, frame, odd_rows, sentence, stored


def sql_rows(text, rows, columns):
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    found = con.sql(text)
    at = [found.columns.index(c) for c in columns]
    return sorted((tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in at) for r in found.fetchall()), key=str)


def test_sharding_equals_sql_and_keeps_its_law(spark):
    rng = random.Random(4)
    hot = sentence(rng, 20)
    rows = odd_rows() + [(1000 + k, hot if k % 3 == 0 else sentence(rng, rng.randint(1, 80)), "en", "s", 1) for k in range(1500)]
    out = sharding.shard_records(frame(spark, rows), range_rows=20)
    columns = out.columns
    ours = as_set(out)
    assert ours == sql_rows(sharding.SQL, rows, columns)
    bytes_of, slots = Counter(), {}
    for r in out.collect():
        bytes_of[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    group_bytes, shards_of = Counter(), {}
    key = {r[0]: r[1] for r in rows}
    for r in rows:
        group_bytes[r[1]] += (len(r[1].encode()) if r[1] else 0) + 8
    for r in out.where("doc_id >= 1000").collect():
        shards_of.setdefault(key[r["doc_id"]], set()).add(r["shard"])
    share = sum(bytes_of.values()) / 24
    largest = max(*(b for b in group_bytes.values() if b <= share), *(len((r[1] or "").encode()) + 8 for r in rows))
    assert all(abs(bytes_of[k] - share) <= largest for k in range(24))
    # Equal texts stay together unless they are more than a shard.
    assert len(shards_of[hot]) > 1 and all(len(x) == 1 for t, x in shards_of.items() if group_bytes[t] <= share)
    checksum = {r["doc_id"]: r["text_crc32"] for r in out.where("doc_id >= 1000").collect()}
    assert checksum == {r[0]: zlib.crc32(r[1].encode()) for r in rows if r[0] and r[0] >= 1000}


def test_sharding_of_hot_ids_nulls_and_pairs(spark, monkeypatch):
    rng = random.Random(8)
    hot, pairs = sentence(rng, 20), [sentence(rng, rng.randint(5, 60)) for _ in range(200)]
    rows = [(None, hot, "en", "s", 1)] * 300 + [(7, hot, "en", "s", 1)] * 300 + [(k, hot, "en", "s", 1) for k in range(100, 200)] + [(1000 + k, pairs[k % 200], "en", "s", 1) for k in range(600)] + [(5000 + k, None, "en", "s", 1) for k in range(20)]
    monkeypatch.setattr(sharding, "LEAST_RANGES", 40)
    out = sharding.shard_records(frame(spark, rows).repartition(4), range_rows=10)
    assert as_set(out) == sql_rows(sharding.SQL, rows, out.columns)
    where = {}
    for r in out.where("doc_id >= 1000").collect():
        where.setdefault((r["doc_id"] - 1000) % 200 if r["doc_id"] < 5000 else "null", set()).add(r["shard"])
    assert all(len(x) == 1 for x in where.values()) and len(where) == 201


def test_licenses_equal_sql(spark):
    rng = random.Random(6)
    notices = ["This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "Released under the MIT License. mit license MIT LICENSE", "Apache License", "cc by cc by sa 4 0",
               "redistribution and use in source and binary forms, with or without modification", "gnu general public", "license mit", "the free and unencumbered software"]
    rows = odd_rows() + [(2000 + k, sentence(rng, 12) + " " + (notices[k % 40] if k % 40 < len(notices) else "") + " " + sentence(rng, 5), "en", "s", 1) for k in range(400)]
    out = licenses.scan_licenses(frame(spark, rows))
    assert as_set(out) == sql_rows(licenses.SQL, rows, out.columns)
    assert {r["labels"] for r in out.collect()} >= {"gpl,gpl-3.0", "cc-by,cc-by-nc-4.0", "mit", "apache", "cc-by,cc-by-sa-4.0", "bsd-3-clause", "unlicense", ""}


def test_licenses_equal_sql_however_frequent_a_notice_is(spark):
    rng = random.Random(16)
    notice = "Licensed under the Apache License, Version 2.0"
    many = [(k, sentence(rng, 12) + " " + (notice if k % 3 == 0 else ""), "en", "s", 1) for k in range(90)]
    few = [(k, t, "en", "s", 1) for k, t in enumerate([notice, "Released under the MIT License", "free and unencumbered software"])]
    for rows, wanted in ((many, {"apache,apache-2.0", ""}), (few, {"apache,apache-2.0", "mit", "unlicense"})):
        out = licenses.scan_licenses(frame(spark, rows))
        assert as_set(out) == sql_rows(licenses.SQL, rows, out.columns)
        assert {r["labels"] for r in out.collect()} == wanted


def test_licenses_equal_sql_with_several_notices_in_a_text(spark):
    rng = random.Random(17)
    notices = [" ".join(words) for _, words, _ in licenses.PARSED]
    rows = [(k, " ".join(f"{n} {sentence(rng, 3)}" for n in rng.sample(notices, rng.randint(2, 14))), "en", "s", 1) for k in range(20)]
    rows += [(100, " x ".join(notices), "en", "s", 1), *((200 + k, sentence(rng, 12), "en", "s", 1) for k in range(300))]
    out = licenses.scan_licenses(frame(spark, rows))
    assert as_set(out) == sql_rows(licenses.SQL, rows, out.columns)
    assert {label for label, _, _ in licenses.PARSED} <= set(out.where("doc_id = 100").first()["labels"].split(","))


def test_bpe_equals_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(vocabulary_path())
    odd = ["a<|endoftext|>b <|startoftext|>'re'S J̌ x\x1cy z  ½ ①", "don't ΑΣ İ K ﬁ 漢字かな 🙂🙂 é 'LL", "\x85\x1f a", "ok\x00ok", "<|endoftext|>", "é" * 300]
    rows = odd_rows() + [(3000 + k, t, "en", "s", 1) for k, t in enumerate(odd)]
    want = []
    for r in rows:
        ids = own.encode(r[1] or "", add_special_tokens=False).ids
        text = own.decode(ids, skip_special_tokens=False)
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert as_set(encode_texts(stored(spark, frame(spark, rows), tmp_path / "d"), vocabulary_path())) == sorted(want, key=str)


def base_counts(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\t-\r]+", text) if w]
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\t-\r]", line):
            dup += line in seen
            seen.add(line)
    spots = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times, inside = Counter(spots), set()
    for i, s in enumerate(spots):
        if times[s] > 1:
            inside.update(range(i, i + 5))
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed


def test_quality_rules_base_equals_brute_force(spark):
    rng = random.Random(8)
    again = sentence(rng, 9)
    rows = odd_rows() + [(k + 100, "\n".join(rng.choice([again, sentence(rng, 7), "", "# é*", " "]) for _ in range(rng.randint(1, 12))), "en", "s", 1) for k in range(200)]
    labels = spark.createDataFrame([(k + 100, k % 2, 0) for k in range(100)], "doc_id long, quality int, toxic int")
    out = judge_quality(frame(spark, rows), labels)
    assert as_set(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(((r[0], *base_counts(r[1])) for r in rows), key=str)
    assert all(r["kept"] == (not r["base_failed"] and r["log_ratio"] >= -0.25) for r in out.collect())


@pytest.mark.parametrize("changed", [0, 1, 3])
def test_decontamination_finds_planted_passages_and_leaves_the_rest(spark, changed):
    rng = random.Random(9 + changed)
    items = [(k, sentence(rng, rng.randint(6, 45))) for k in range(30)]
    rows, want = [], set()
    for k in range(150):
        words = sentence(rng, rng.randint(40, 200)).split()
        if k % 3 == 0:
            item, text = items[k % 30]
            passage = text.split()
            if len(passage) >= 24:
                for at in rng.sample(range(8, len(passage)), changed):
                    passage[at] = "other"
            at = rng.randrange(len(words))
            words[at:at] = [p.upper() + "," for p in passage]
            want.add((k, item))
        rows.append((k, " ".join(words), "en", "s", 1))
    rows += [(900, " ".join(items[0][1].split()[:4]), "en", "s", 1)]
    found = benchmark_leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want


def test_overlaps_equal_brute_force_and_meet_the_declared_rule(spark):
    rng = np.random.default_rng(13)
    for _ in range(400):
        equal = rng.random(rng.integers(1, 60)) < rng.choice([0.5, 0.7, 0.8, 0.9])
        spans = [(i, j) for i in range(len(equal)) for j in range(i + 12, len(equal) + 1) if 4 * equal[i:j].sum() >= 3 * (j - i)]
        got = overlap(equal, 12, 0.75)
        assert (got is None) == (not spans)
        if got:
            assert (got[0], got[0] + got[1]) in spans and got[2] == equal[got[0] : got[0] + got[1]].sum()
    words = random.Random(14)
    items = [sentence(words, n) for n in (13, 48, 16)]
    changed = [lambda i: i == 10, lambda i: i % 4 == 3, lambda i: i in (3, 4, 5, 6, 7)]
    rows = [(k, " ".join("zz" if c(i) else w for i, w in enumerate(t.split())), "en", "s", 1) for k, (t, c) in enumerate(zip(items, changed))]
    found = benchmark_leaks(frame(spark, rows), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} >= {(0, 0)} and (2, 2) not in {(r["doc_id"], r["item_id"]) for r in found}
    assert all(r["n_words"] >= 12 and 4 * r["n_equal"] >= 3 * r["n_words"] for r in found)


def unseen(masks, words, substituted):
    """How many placements of substitutions no mask sees past."""
    windows = [{at + k for k, c in enumerate(m) if c == "1"} for m in masks for at in range(words - len(m) + 1)]
    return sum(all(w & set(hit) for w in windows) for hit in itertools.combinations(range(words), substituted))


def test_masks_see_every_overlap_within_the_share():
    # A longer overlap within the share has one of these lengths within.
    for words in range(LEAST_OVERLAP, 2 * LEAST_OVERLAP):
        assert unseen(MASKS, words, words // 4) == 0, words
    for words in range(5, LEAST_OVERLAP):
        assert unseen(SHORT_MASKS, words, words // 4) == 0, words


def test_leaks_of_every_length_with_a_quarter_substituted(spark):
    rng = random.Random(21)
    items, docs = [], []
    for n in [*range(5, 12), 12, 12, 12, 14, 16, 20, 24, 40]:
        words = sentence(rng, n).split()
        items.append((len(items), " ".join(words)))
        for _ in range(6):
            spots = rng.sample(range(n), n // 4)
            said = [f"zz{k}" if k in spots else w for k, w in enumerate(words)]
            docs.append((1000 * len(items) + len(docs), f"{sentence(rng, 9)} {' '.join(said)}. {sentence(rng, 9)}", "en", "s", 1))
    clean = [(k, sentence(rng, 60), "en", "s", 1) for k in range(300)]
    out = benchmark_leaks(frame(spark, docs + clean), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r["doc_id"] for r in out} == {d[0] for d in docs} and {(r["doc_id"] // 1000 - 1, r["item_id"]) for r in out} == {(k, k) for k, _ in items}
