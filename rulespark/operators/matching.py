"""Matching of candidates and labels, and views that order or enrich records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def decided_candidates(ranked: DataFrame, query: str, score: str, least: float, margin: float) -> DataFrame:
    """The best candidate of each query with a ``verdict``: accepted, ambiguous (the next is within ``margin``) or weak."""
    order = Window.partitionBy(query).orderBy(F.desc(score), *[c for c in ranked.columns if c not in (query, score)])
    best = ranked.withColumn("_n", F.row_number().over(order)).withColumn("_next", F.lead(score).over(order)).where("_n = 1")
    verdict = F.when(F.col(score) < least, "weak").when(F.col(score) - F.coalesce("_next", F.lit(-1.0)) < margin, "ambiguous").otherwise("accepted")
    return best.withColumn("verdict", verdict).drop("_n", "_next")


def rejected_candidates(pairs: DataFrame, text: str, candidate: str, conflicts: dict[str, tuple[str, str]]) -> DataFrame:
    """``pairs`` with the names of the rules that forbid them: a pattern that the text shows and another that the candidate shows, either way round."""

    def clash(a: str, b: str) -> Column:
        return (F.col(text).rlike(a) & F.col(candidate).rlike(b)) | (F.col(text).rlike(b) & F.col(candidate).rlike(a))

    return pairs.withColumn("conflicts", F.array_compact(F.array(*(F.when(clash(a, b), F.lit(name)) for name, (a, b) in conflicts.items()))))


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], left_order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """Left and right rows with equal keys, paired one to one in order: (keys, left_…, right_…), the rest with nulls.

    So manual labels are compared with findings: each label meets one finding.
    """

    def numbered(df: DataFrame, order: Sequence[str], side: str) -> DataFrame:
        n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).alias("_n")
        return df.select(*keys, n, *(F.col(c).alias(f"{side}_{c}") for c in order))

    return numbered(left, left_order, "left").join(numbered(right, right_order, "right"), [*keys, "_n"], "full_outer").drop("_n")


def split_labels(rows: DataFrame, text: str, classes: dict[str, str]) -> DataFrame:
    """Manual opinions: a cell's numbered or listed items, one row each, with the first class whose pattern it shows."""
    items = F.filter(F.split(text, r"[；;\n]+|(?:^|(?<=[\s。；;]))\d+[.、)）]"), lambda x: F.trim(x) != "")
    out = rows.withColumn("item", F.explode(items)).withColumn("item", F.trim("item"))
    name = F.lit(None).cast("string")
    for label, pattern in classes.items():
        name = F.coalesce(name, F.when(F.col("item").rlike(pattern), label))
    return out.withColumn("label", F.coalesce(name, F.lit("other")))


def out_of_order(rows: DataFrame, sheet: Sequence[str], row: str, key: str) -> DataFrame:
    """``rows`` of the sheets whose keys are out of order, with ``new_row``: a stable sort, so equal keys keep their order."""
    before = Window.partitionBy(*sheet).orderBy(row)
    bad = rows.withColumn("_down", F.coalesce(F.col(key) < F.lag(key).over(before), F.lit(False))).groupBy(*sheet).agg(F.bool_or("_down").alias("_bad")).where("_bad").drop("_bad")
    first = F.min(row).over(Window.partitionBy(*sheet))
    place = F.row_number().over(Window.partitionBy(*sheet).orderBy(F.col(key).asc_nulls_last(), row))
    return rows.join(bad, list(sheet), "left_semi").withColumn("new_row", first + place - 1)


def enriched(matrix: DataFrame, duties: DataFrame, keys: Sequence[str], shown: Sequence[str]) -> DataFrame:
    """``matrix`` with the distinct values of its duty rows beside it, one text for each shown column."""
    parts = duties.groupBy(*keys).agg(*(F.array_join(F.array_sort(F.collect_set(c)), "、").alias(f"duty_{c}") for c in shown))
    return matrix.join(parts, list(keys), "left")
