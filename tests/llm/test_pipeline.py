"""The pipeline's stages against brute force on a small table."""

import random

import corpus_pipeline
from rulespark.llm.neardup import near_duplicates
from tests.llm.fixtures import as_set, sentence
from tests.llm.test_neardup import components, shingles


def tables(spark, folder):
    rng = random.Random(12)
    docs, items = [], [(k, sentence(rng, 30)) for k in range(5)]
    passage = sentence(rng, 70)
    for k in range(120):
        letters = "abcdefghij" if k % 2 else "klmnopqrst"
        lines = [sentence(rng, rng.randint(10, 40), letters) for _ in range(3)]
        if k % 10 == 3:
            lines.insert(1, passage)
        if k % 15 == 4:
            lines.insert(2, items[k % 5][1])
        docs.append((k, "\n".join(lines), "aa" if k % 2 else "bb", "s"))
    docs += [(200 + k, docs[k][1] + " end", docs[k][2], "s") for k in range(0, 40, 4)]
    docs += [(300, "12 34", "aa", "s"), (301, None, None, None), (7, docs[7][1], "aa", "s")]
    rows = [(*d, len(d[1]) if d[1] else 0) for d in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items, passage


def test_stages_and_run(spark, tmp_path):
    folder = str(tmp_path)
    rows, items, passage = tables(spark, folder)
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        kept[name] = docs
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]

    ids = {n: [r["doc_id"] for r in d.select("doc_id").collect()] for n, d in kept.items()}
    assert set(ids["language_id"]) == {r[0] for r in rows} - {300, 301}
    groups = components({r[0]: shingles(r[1]) for r in rows if r[1] and r[0] != 300})
    assert sorted(ids["minhash_near_dedup"]) == sorted(k for k, c in groups.items() if k == c)
    assert set(ids["substring_dedup"]) == set(ids["minhash_near_dedup"])
    cut = {r["doc_id"]: r["text"] for r in kept["substring_dedup"].collect()}
    holders = sorted(k for k, t in cut.items() if passage in t)
    assert holders == [min(k for k in cut if k % 10 == 3)]
    assert all(r["n_chars"] == len(r["text"]) for r in kept["substring_dedup"].collect())
    leaks = {k for k, t in cut.items() if any(i in t for _, i in items)}
    assert leaks and set(ids["benchmark_decontamination"]) == set(cut) - leaks
    assert set(ids["bpe_encoding"]) == set(ids["benchmark_decontamination"])
    assert as_set(corpus_pipeline.run(spark, folder)) == as_set(kept["bpe_encoding"])
    assert near_duplicates(kept["minhash_near_dedup"]).where("NOT kept").count() == 0


STAGED = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_judge_rows_not_ids(spark, tmp_path):
    rng = random.Random(15)
    a, b, c = (sentence(rng, 40) for _ in range(3))
    rows = [(1, a), (2, a), (2, b), (None, c), (None, c), (None, a), (3, "12 34"), (3, b + " other end"), (None, "56"), (4, None), (1, a)]
    rows += [(k, sentence(rng, 40)) for k in range(10, 40)]
    docs = spark.createDataFrame([(*r, "aa", "s", 1) for r in rows], STAGED)
    docs.write.parquet(f"{tmp_path}/in")
    docs = spark.read.parquet(f"{tmp_path}/in")
    named = corpus_pipeline.language_id(spark, docs, str(tmp_path))
    left = sorted(((r["doc_id"] or -1, r["text"]) for r in named.collect()), key=str)
    assert left == sorted(((i or -1, t) for i, t in rows if t and not t[0].isdigit()), key=str)
    once = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, named, str(tmp_path)).collect()]
    assert sorted(once[k] for k in range(len(once)) if once[k][0] and once[k][0] < 10) == sorted([(1, a), (2, b)])
    assert [x for x in once if x[0] is None] == [(None, c)] and len(once) == 33


def test_stages_on_empty_tables_and_more_columns(spark, tmp_path):
    docs = spark.createDataFrame([], STAGED + ", version string, kept int")
    spark.createDataFrame([(1, "x y z")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    full = spark.createDataFrame([(1, "some words stand here", "en", "s", 21, "v", 2), (2, None, None, None, None, None, None)], docs.schema)
    for name, frame in (("e", docs), ("f", full)):
        frame.write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            frame = stage(spark, frame, str(tmp_path))
            if k < len(corpus_pipeline.STAGES) - 1:
                assert frame.columns == docs.columns
        assert frame.count() == (0 if name == "e" else 1)
