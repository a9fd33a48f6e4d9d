"""Small texts, and the odd rows that every operator has to bear."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, id long, words string, node long, size long, shard string, label int, removed string, c0 int"


def sentence(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def odd_rows(seed=5):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, a short text, odd characters."""
    rng = random.Random(seed)
    base = sentence(rng, 120)
    texts = [None, "", " \n\t ", "x", "one two three", base, base, base + " tail", base.upper(), sentence(rng, 60_000), "é ü 漢字 🙂 \x00 ,.;!", "a\n" * 40, "### %%% !!", sentence(rng, 30) + "\n" + base]
    rows = [(k, t, "en" if k % 3 else None, None if k % 4 == 0 else "s", len(t) if t else None) for k, t in enumerate(texts)]
    return [*rows, (None, base, "en", "s", 1), (None, None, None, None, None), rows[5], rows[5], (6, "another text under the same id", "de", "s", 3)]


def frame(spark, rows, path=None):
    return spark.createDataFrame(rows, DOCS)


def clashing(spark, rows):
    """The same rows with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 0.5, True, 7, "w", 1, 2, "x", 3, "r", 4) for r in rows], CLASHING)


def stored(spark, df, path):
    df.write.mode("overwrite").parquet(str(path))
    return spark.read.parquet(str(path))


def as_set(df, *columns):
    """Rows as sorted tuples, floats rounded."""
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*(columns or df.columns)).collect()), key=str)
