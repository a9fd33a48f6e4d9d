"""What the cells of a workbook tell about its sheets and columns."""

from __future__ import annotations

import io
import zipfile
from typing import Any
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulespark.functions import facts
from rulespark.functions.keys import measure_key, norm_text

SHEET = ["relative_path", "sheet"]

# Fixed value: the namespace of a text document's parts.
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def hidden_sheets(cells: DataFrame) -> DataFrame:
    """Sheets that were left out because they are hidden."""
    return cells.where("hidden").select(*SHEET).distinct()


def unread_files(cells: DataFrame) -> DataFrame:
    return cells.where("error IS NOT NULL").select("relative_path", "sheet", "error")


def answer_columns(cells: DataFrame, headers: DataFrame, least: int = 2) -> DataFrame:
    """Columns without a known header that hold ``least`` explicit applicability answers or more."""
    known = headers.select(*SHEET, F.explode("columns").alias("field", "col")).select(*SHEET, "col")
    below = cells.where("error IS NULL").join(headers.select(*SHEET, "header_row"), SHEET).where(F.col("row") > F.col("header_row")).join(known, [*SHEET, "col"], "left_anti")
    read = below.withColumn("_text", norm_text(F.col("current"))).withColumn("_decision", facts.applicability(F.col("_text"))["decision"])
    return read.where("_decision IS NOT NULL").groupBy(*SHEET, "col").agg(F.count(F.lit(1)).alias("answers")).where(F.col("answers") >= least)


def owner_evidence(cells: DataFrame, names: DataFrame, least_rows: int = 2, least_share: float = 0.9) -> DataFrame:
    """The unit that the body of a sheet names: in ``least_rows`` rows or more, and in ``least_share`` of the rows that name any.

    ``names``: entity_code and name, the roster; joined on the whole cell.
    """
    body = cells.where("error IS NULL").select(*SHEET, "row", norm_text(F.col("current")).alias("_name"))
    named = body.join(names.select("entity_code", norm_text(F.col("name")).alias("_name")), "_name").select(*SHEET, "row", "entity_code").distinct()
    by_unit = named.groupBy(*SHEET, "entity_code").agg(F.count(F.lit(1)).alias("rows"))
    total = F.sum("rows").over(Window.partitionBy(*SHEET))
    return by_unit.withColumn("share", F.col("rows") / total).where((F.col("rows") >= least_rows) & (F.col("share") >= least_share))


def current_sheets(headers: DataFrame, rows: DataFrame, old: str = "过渡|原|旧") -> DataFrame:
    """``headers`` without the old duty sheets of files that have exactly one populated current one.

    ``rows``: records or cells with relative_path and sheet, telling which sheets are populated.
    """
    filled = rows.select(*SHEET).distinct().withColumn("_filled", F.lit(True))
    marked = headers.join(filled, SHEET, "left").withColumn("_old", F.col("sheet").rlike(old))
    live = F.count_if(~F.col("_old") & F.coalesce("_filled", F.lit(False))).over(Window.partitionBy("relative_path", "record_type"))
    drop = F.col("_old") & (F.col("record_type") == "position_duty") & (F.col("_live") == 1)
    return marked.withColumn("_live", live).where(~drop).select(headers.columns)


def with_overrides(headers: DataFrame, overrides: DataFrame, files: DataFrame) -> DataFrame:
    """``headers`` with columns that a user has confirmed: (sha256, sheet, field, col), pinned by the file's digest."""
    pinned = overrides.join(files.select("relative_path", "sha256"), "sha256").groupBy(*SHEET).agg(F.map_from_entries(F.collect_list(F.struct("field", "col"))).alias("_own"))
    joined = headers.join(pinned, SHEET, "left")
    merged = F.map_concat(F.map_filter("columns", lambda k, _: ~F.map_contains_key("_own", k)), F.col("_own"))
    return joined.withColumn("columns", F.when(F.col("_own").isNull(), F.col("columns")).otherwise(merged)).select(headers.columns)


@F.pandas_udf(T.StringType())
def _docx_text(contents: pd.Series, most: pd.Series) -> pd.Series:
    def one(content: bytes, paragraphs: int) -> str | None:
        try:
            root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
            return None
        return "\n".join("".join(t.text or "" for t in p.iter(f"{WORD}t")) for p in list(root.iter(f"{WORD}p"))[:paragraphs])

    return pd.Series([one(c, n) for c, n in zip(contents, most)], dtype=object)


def explanation_texts(files: DataFrame, paragraphs: int = 30) -> DataFrame:
    """The first paragraphs of text documents; null if a document can't be read."""
    return files.where("true_format = 'docx'").select("relative_path", _docx_text("content", F.lit(paragraphs)).alias("text"))


def baseline_order(spark: SparkSession, baselines: list[dict[str, Any]]) -> DataFrame:
    """(business_id, variant_id, key, rank) of the measure orders of frozen templates."""
    rows = [(b["business_id"], b.get("variant_id", "default"), b["measure_order"]) for b in baselines]
    listed = spark.createDataFrame(rows, "business_id string, variant_id string, ids array<string>").select("business_id", "variant_id", F.posexplode("ids").alias("rank", "id"))
    return listed.select("business_id", "variant_id", measure_key(F.col("id")).alias("key"), "rank")
