"""Numbered entries of a cell, cut at markers outside brackets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rulespark.functions.duties import occurrences

# A number that opens an entry, and the brackets within which it does not.
MARKER = r"(?:^|(?<=[\n；;。]))[ \t]*(?:[0-9０-９]+[.．、]|[（(][0-9０-９]+[)）])[ \t]*"
BRACKET = r"[（(《【\[）)》】\]]"
OPENING = ("（", "(", "《", "【", "[")
NUMBERED = r"^\s*(?:[0-9０-９]+[.．、]|[（(][0-9０-９]+[)）])"


def numbered_items(text: Column) -> Column:
    """array<struct<text, start, end>> with offsets in the text; blanks around an entry and stops at its end are left out.

    A running depth over the brackets before a marker tells whether it stands outside all of them.
    """
    brackets = occurrences(text, BRACKET)

    def depth(at: Column) -> Column:
        step = lambda n, b: F.when(b["start"] >= at, n).when(b["text"].isin(*OPENING), n + 1).otherwise(F.greatest(n - 1, F.lit(0)))
        return F.aggregate(brackets, F.lit(0), step)

    markers = F.filter(occurrences(text, MARKER), lambda m: depth(m["start"]) == 0)

    def entry(m: Column, k: Column) -> Column:
        end = F.coalesce(F.get(markers, k + 1)["start"], F.length(text))
        said = F.substr(text, m["end"] + 1, end - m["end"])
        left = F.regexp_replace(said, r"(?U)^\s+", "")
        own = F.regexp_replace(left, r"(?U)[\s。；;]+$", "")
        start = m["end"] + F.length(said) - F.length(left)
        return F.struct(own.alias("text"), start.alias("start"), (start + F.length(own)).alias("end"))

    return F.filter(F.transform(markers, entry), lambda e: e["text"] != "")
