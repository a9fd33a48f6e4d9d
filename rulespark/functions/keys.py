"""Text and key expressions that every join of the engine goes through.

``norm_text`` needs Unicode compatibility folding, which Spark SQL lacks, so it
is one Arrow UDF applied once where records enter; the rest are expressions.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANK = r"(?U)\s+"

# Fixed value: the labelled form of a measure number, "…-N…-控制措施M".
LABELLED_NUMBER = r"(?U)-\D*?(\d+)[^-]*-控制措施(\d+)"


@F.pandas_udf(T.StringType())
def fold_text(values: pd.Series) -> pd.Series:
    """NFKC folding; a null stays null."""
    return values.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFKC", v))


def strip_blanks(text: Column) -> Column:
    """``text`` without any white space, the ideographic space included."""
    return F.regexp_replace(text, BLANK, "")


def is_ascii(text: Column) -> Column:
    """Whether ``text`` is of ASCII alone, so that folding leaves it as it is."""
    return F.octet_length(text) == F.length(text)


def norm_text(text: Column) -> Column:
    """Folded and free of white space: the form in which texts are compared."""
    return strip_blanks(fold_text(text))


def norm_literal(text: str) -> str:
    """``norm_text`` of a parameter, on the driver."""
    return re.sub(r"\s+", "", unicodedata.normalize("NFKC", text or ""))


def display_text(text: Column) -> Column:
    """Runs of blanks become one, ends trimmed."""
    return F.trim(F.regexp_replace(text, BLANK, " "))


def all_numbers(text: Column) -> Column:
    """All integers of a text, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)"), 1), lambda d: d.try_cast("bigint"))


def measure_key(text: Column) -> Column:
    """The numbers by which measures are told apart: of the labelled form if it is one, else all of them.

    An empty array means that there is no reliable number.
    """
    labelled = F.array(F.regexp_extract(text, LABELLED_NUMBER, 1), F.regexp_extract(text, LABELLED_NUMBER, 2))
    return F.when(text.rlike(LABELLED_NUMBER), F.transform(labelled, lambda d: d.try_cast("bigint"))).otherwise(all_numbers(text))


def natural_key(text: Column) -> Column:
    """An array that orders texts with numbers in them as people do: digits are padded."""
    parts = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), 1)
    return F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 20, "0")).otherwise(p))


def identity(*columns: Column) -> Column:
    """A stable 24-digit name for a row: nulls and empty texts are told apart."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns]
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 24)


def contains_any(text: Column, terms: list[str]) -> Column:
    """Whether one of the terms stands in ``text``; never null."""
    found = F.lit(False)
    for term in terms:
        found = found | text.contains(term)
    return F.coalesce(found, F.lit(False))


def terms_in(text: Column, terms: list[str]) -> Column:
    """The terms that stand in ``text``, in the given order."""
    return F.filter(F.array(*(F.lit(t) for t in terms)).cast("array<string>"), lambda t: F.coalesce(F.contains(text, t), F.lit(False)))
