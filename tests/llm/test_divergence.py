"""The source audit against brute force and SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np

from rulespark.llm import divergence
from rulespark.llm.divergence import SQL, audit_sources, share
from tests.llm.fixtures import clashing, frame, odd_rows, sentence


def expected(rows, least):
    docs = [(r[2] or "", r[3] or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1] or "")))) for r in rows]
    df, counts, groups = Counter(), defaultdict(Counter), defaultdict(set)
    for lang, source, c in docs:
        groups[lang].add(source)
        df.update((lang, t) for t in c)
        counts[lang, source].update(c)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for (of, t), n in df.items() if of == lang and n >= least)
        v = len(kept)
        own = {s: [counts[lang, s][t] for t in kept] for s in sources}
        p = {s: [1 + (10**9 * (c + 2)) // (sum(cs) + 2 * v) for c in cs] for s, cs in own.items()}
        whole = [sum(cs) for cs in zip(*own.values())]
        q = [1 + (10**9 * (c + 2)) // (sum(whole) + 2 * v) for c in whole]
        for s in sources:
            pair = [(-sum((a - b) ** 2 // (a + b) for a, b in zip(p[s], p[o])), o.encode(), o) for o in sources if o != s]
            term = [(-((a - b) ** 2 // (a + b)), t.encode(), t) for t, c, a, b in zip(kept, own[s], p[s], q) if c and a > b]
            out += [(lang, s, "pair", x[2], -x[0], k + 1) for k, x in enumerate(sorted(pair))]
            out += [(lang, s, "term", x[2], -x[0], k + 1) for k, x in enumerate(sorted(term)[:10])]
    return sorted(out)


def corpus():
    rng = random.Random(13)
    common = ["alpha", "Beta", "the", "é", "漢字", "zz", "qq", "x9y", "ab", "cd", "ef", "gh", "ij", "kl"]
    rows = odd_rows()
    for k in range(900):
        source = "hot" if k % 3 == 0 else f"s{k % 11}"
        rows.append((k, " ".join(rng.choice(common[: 3 + k % 11]) if rng.random() < 0.6 else sentence(rng, 1) for _ in range(rng.randint(0, 30))), ["en", "de", None][k % 3], source, 1))
    return [*rows, (1, "lonely words", "fr", "only", 1), (2, "", "fr", "other", 1), (3, "same " * 40, "it", "one", 1)]


def test_equals_brute_force_and_sql(spark):
    rows = corpus()
    out = audit_sources(frame(spark, rows).repartition(5))
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    ours = sorted(map(tuple, out.collect()))
    assert ours == expected(rows, 10)
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    assert sorted(con.sql(SQL).fetchall()) == ours


def test_blocks_and_small_buffers_change_nothing(spark, monkeypatch):
    rows = corpus()
    for name, value in (("HELD_RUNS", 50), ("BLOCK_SOURCES", 4), ("CELLS", 30)):
        monkeypatch.setattr(divergence, name, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(tuple, audit_sources(frame(spark, rows).repartition(3), least=4, block_groups=5).collect())) == expected(rows, 4)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_clashing_names_and_empty_table(spark):
    rows = corpus()
    assert sorted(map(tuple, audit_sources(clashing(spark, rows)).collect())) == expected(rows, 10)
    assert audit_sources(frame(spark, [])).collect() == []


def test_share_is_exact_where_a_product_would_overflow():
    count, total, kept = 4 * 10**14 + 7, 8 * 10**15 + 11, 10**6 + 3
    assert int(share(np.array([count]), total, kept)[0]) == 1 + (10**9 * (count + 2)) // (total + 2 * kept)
