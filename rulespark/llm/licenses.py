"""License scans by a positional rare-token index, with DataFrame operations only.

License notices are templates: lists of words, some of which are mandatory key
phrases.  The corpus gives each template word an inverse document frequency.
The words of each template's key phrases with the highest ones have postings,
however frequent they are; hits of a text that agree on where a template would
begin are a candidate, which counts once its key phrases stand in their places.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases and the labels they stand for.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Label, notice (key phrases in brackets).
TEMPLATES = [
    ("agpl-3.0", "[gnu affero general public license] [version 3]"),
    ("apache-2.0", "licensed under the [apache license version 2 0]"),
    ("bsd-3-clause", "[redistribution and use in source and binary forms] with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "licensed under [cc by 4 0]"),
    ("cc-by-nc-4.0", "licensed under [cc by nc 4 0]"),
    ("cc-by-sa-4.0", "licensed under [cc by sa 4 0]"),
    ("cc0-1.0", "to the extent possible under law [waived all copyright and related or neighboring rights]"),
    ("gpl-3.0", "this work is licensed under the [gnu general public license version 3]"),
    ("isc", "[permission to use copy modify and or distribute this software for any purpose] with or without fee is hereby granted"),
    ("lgpl-3.0", "[gnu lesser general public license] version 3"),
    ("mit", "released under the [mit license]"),
    ("mit-text", "[permission is hereby granted free of charge to any person obtaining a copy of this software] and associated documentation files"),
    ("mpl-2.0", "this source code form is subject to the terms of the [mozilla public license] v 2 0"),
    ("unlicense", "this is [free and unencumbered software] released into the public domain"),
]

#: Words of each template that are looked up: hits that must agree.
LEAST_HITS = 2

#: Score of a text that has a base phrase only.
PHRASE_SCORE = 0.5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _parsed() -> list[tuple[str, list[str], list[int]]]:
    """(label, words, places of the words of key phrases) of each template."""
    out = []
    for label, notice in TEMPLATES:
        words, keys, inside = [], [], False
        for word in notice.split():
            inside |= word.startswith("[")
            if inside:
                keys.append(len(words))
            words.append(word.strip("[]"))
            inside &= not word.endswith("]")
        out.append((label, words, keys))
    return out


PARSED = _parsed()

VOCABULARY = sorted({w for _, words, _ in PARSED for w in words} | {w for p in PHRASES for w in p.split()})


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; a null text has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAPS, -1), "")


def _places(words: Column, license_words: Column, phrase: str) -> Column:
    """Where the words of a phrase stand consecutively: their first places."""
    parts = phrase.split()
    first = F.transform(words, lambda w, i: F.when(reduce(Column.__and__, [w == parts[0], *(F.get(words, i + k) == p for k, p in enumerate(parts) if k)]), i))
    possible = reduce(Column.__and__, [F.array_contains(license_words, p) for p in parts])
    return F.when(possible, F.array_compact(first)).otherwise(F.array().cast("array<int>"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    ``n_base`` counts the places of all base phrases, ``first_word`` and
    ``last_word`` are the smallest and largest of them (null without any).
    ``labels`` are the base labels and those of the templates found, both
    distinct, sorted and comma-joined, empty if there are none.  ``score`` is
    the largest share of a found template's words that stand in their places;
    PHRASE_SCORE if only a base phrase was found, else 0.

    A null text counts as an empty one: no words and no labels.  A null id
    stays null, repeated rows are scanned each, other columns are ignored,
    whatever their names, and an empty table gives an empty result.
    """
    vocabulary = F.lit(VOCABULARY)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    texts = texts.withColumn("known", F.array_intersect("words", vocabulary))

    # One row for each template word, and one (a null word) for the number of texts.
    counted = texts.select(F.explode(F.concat(F.col("known"), F.array(F.lit(None).cast("string")))).alias("word")).groupBy("word").count().collect()
    number = {r["word"]: r["count"] for r in counted}
    total = number.pop(None, 0)
    idf = {w: math.log((total + 1) / (number.get(w, 0) + 1)) for w in VOCABULARY}
    postings: dict[str, list[tuple[int, int]]] = {}
    for t, (_, words, key_places) in enumerate(PARSED):
        # A template that is found has all its key words, so any LEAST_HITS of them find it.
        first = {words[k]: k for k in reversed(key_places)}
        for w in sorted(first, key=lambda w: (-idf[w], w))[:LEAST_HITS]:
            postings.setdefault(w, []).append((t, first[w]))

    found = texts.withColumn("base", F.array(*(F.struct(F.lit(label).alias("label"), _places(F.col("words"), F.col("known"), phrase).alias("at")) for phrase, label in PHRASES.items())))
    found = found.withColumn("places", F.flatten(F.transform("base", lambda b: b["at"])))
    base_labels = F.array_sort(F.array_distinct(F.transform(F.filter("base", lambda b: F.size(b["at"]) > 0), lambda b: b["label"])))
    found = found.withColumn("base_labels", base_labels)

    entry = F.create_map(*(x for w, p in postings.items() for x in (F.lit(w), F.array(*(F.struct(F.lit(t).alias("t"), F.lit(k).alias("k")) for t, k in p)))))
    found = found.withColumn("rare", F.array_intersect("known", F.lit(sorted(postings))))
    hits = F.array_compact(F.transform("words", lambda w, i: F.when(F.array_contains("rare", w), F.struct(w.alias("w"), i.alias("i")))))
    starts = F.array_sort(F.flatten(F.transform(hits, lambda h: F.transform(F.element_at(entry, h["w"]), lambda p: F.struct(p["t"].alias("t"), (h["i"] - p["k"]).alias("s"))))))
    # A text with one rare word only can't give hits that agree.
    found = found.withColumn("starts", F.when(F.size("rare") >= LEAST_HITS, starts).otherwise(F.array().cast("array<struct<t:int,s:int>>")))
    # Equal entries are neighbours now: those whose LEAST_HITS - 1 predecessors are equal count.
    agreed = F.array_distinct(F.array_compact(F.transform("starts", lambda x, i: F.when(F.get(F.col("starts"), i - (LEAST_HITS - 1)) == x, x))))
    notice = F.array(*(F.lit(words) for _, words, _ in PARSED))
    keys = F.array(*(F.lit(k) for _, _, k in PARSED))
    names = F.lit([label for label, _, _ in PARSED])

    def verified(c: Column) -> Column:
        words, own = F.col("words"), F.get(notice, c["t"])
        same = F.forall(F.get(keys, c["t"]), lambda k: F.coalesce(F.get(words, c["s"] + k) == F.get(own, k), F.lit(False)))
        return same

    def share(c: Column) -> Column:
        words, own = F.col("words"), F.get(notice, c["t"])
        return F.size(F.filter(own_places(own), lambda k: F.coalesce(F.get(words, c["s"] + k) == F.get(own, k), F.lit(False)))) / F.size(own)

    def own_places(own: Column) -> Column:
        return F.sequence(F.lit(0), F.size(own) - 1)

    found = found.withColumn("agreed", agreed).withColumn("verified", F.filter("agreed", verified))
    templates = F.transform("verified", lambda c: F.get(names, c["t"]))
    best = F.coalesce(F.array_max(F.transform("verified", share)), F.lit(0.0))

    phrase_score = F.when(F.size("base_labels") > 0, F.lit(PHRASE_SCORE)).otherwise(F.lit(0.0))
    return found.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base_labels", templates))), ",").alias("labels"),
        F.greatest(best, phrase_score).alias("score"),
    )


def _oracle() -> str:
    """DuckDB SQL of the same scan, each template laid over every word of every text."""
    templates = ", ".join(f"('{label}', {words!r}, {keys!r})" for label, words, keys in PARSED)
    phrases = ", ".join(f"('{label}', {phrase.split()!r}, {list(range(len(phrase.split())))!r})" for phrase, label in PHRASES.items())
    return f"""
WITH notices(label, own, keys) AS (VALUES {templates}),
phrases(label, own, keys) AS (VALUES {phrases}),
texts AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM documents),
spots AS (SELECT r, words, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word FROM texts),
base AS (
  SELECT r, label, i - 1 AS place FROM spots JOIN phrases ON word = own[1]
  WHERE words[i : i + len(own) - 1] = own),
found AS (
  SELECT r, label, len(list_filter(range(1, len(own) + 1), lambda k: coalesce(words[i - keys[1] + k - 1] = own[k], false) AND i - keys[1] + k - 1 >= 1)) / len(own) AS share
  FROM spots JOIN notices ON word = own[keys[1] + 1]
  WHERE len(list_filter(keys, lambda k: NOT coalesce(words[i - keys[1] + k] = own[k + 1], false))) = 0),
b AS (SELECT r, count(*) AS n, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY r),
a AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM base UNION SELECT r, label FROM found) GROUP BY r),
s AS (SELECT r, max(share) AS share FROM found GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.first_word::BIGINT AS first_word, b.last_word::BIGINT AS last_word,
  coalesce(b.labels, '') AS base_labels, coalesce(a.labels, '') AS labels,
  greatest(coalesce(s.share, 0), CASE WHEN b.n > 0 THEN {PHRASE_SCORE} ELSE 0 END)::DOUBLE AS score
FROM texts LEFT JOIN b USING (r) LEFT JOIN a USING (r) LEFT JOIN s USING (r)
"""


SQL = _oracle()
