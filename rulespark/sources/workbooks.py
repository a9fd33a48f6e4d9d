"""Workbooks as DataFrames: files, cells, sheets and records.

A small helper turns one file's bytes into cells, a file at a time inside a
task.  Everything after that - which row is the header, which column is which
field, which sheet is which list - is grouping and joining of cells.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from typing import IO
from xml.etree import ElementTree
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rulespark.functions.keys import norm_text
from rulespark.operators.relational import holding
from rulespark.plans.records import with_record_id
from rulespark.sources.stored import SHORT_TABLE, by_key
from rulespark.sources.tables import header_rows, in_regions, with_area, within

SPAN = "array<struct<text:string,start:int,end:int>>"
CELLS = f"relative_path string, sheet string, hidden boolean, `row` int, col int, coordinate string, raw string, current string, formula string, state string, deleted_spans {SPAN}, red_spans {SPAN}, area string, column_hidden boolean, error string"

# The parts of a workbook package.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"

#: Cells that leave a task at a time, and characters of text among them.
BATCH_CELLS, BATCH_CHARACTERS = 20_000, 4 << 20

#: Rows of a sheet that are read together into records.
BLOCK_ROWS = 1 << 14

#: Bytes of a sheet's XML that are looked at in one step.
STEP_BYTES = 1 << 20

RED = "FFFF0000"

__all__ = ["classify_material", "header_rows", "longest_alias", "read_cells", "read_files", "records_from_cells", "with_system_types", "workbook_cells"]


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if c.isalpha():
            n = n * 26 + ord(c.upper()) - 64
    return n


def _rich(node: ElementTree.Element) -> tuple[str, list, list]:
    """The text of a shared or inline string, its struck-out and its red spans."""
    text, struck, red = "", [], []
    runs = node.findall(f"{MAIN}r")
    if not runs:
        return "".join(t.text or "" for t in node.findall(f"{MAIN}t")), [], []
    for run in runs:
        part = "".join(t.text or "" for t in run.findall(f"{MAIN}t"))
        style = run.find(f"{MAIN}rPr")
        if style is not None and part:
            span = {"text": part, "start": len(text), "end": len(text) + len(part)}
            strike = style.find(f"{MAIN}strike")
            if strike is not None and strike.get("val", "1") not in ("0", "false"):
                struck.append(span)
            colour = style.find(f"{MAIN}color")
            if colour is not None and colour.get("rgb") == RED:
                red.append(span)
        text += part
    return text, struck, red


def _without(text: str, spans: list) -> str:
    for s in sorted(spans, key=lambda s: -s["start"]):
        text = text[: s["start"]] + text[s["end"] :]
    return text


def _place(reference: str) -> tuple[int, int]:
    return int(re.sub(r"\D", "", reference)), _column(reference)


def _layout(stream: IO[bytes]) -> tuple[list[tuple[int, int, int, int, str]], list[tuple[int, int]]]:
    """The merged areas of a sheet in order of their first row, and its ranges of hidden columns; the sheet is read through and must be well-formed."""
    found, hidden = [], []

    def start(name: str, attributes: dict[str, str]) -> None:
        kind = name.rpartition(":")[2]
        if kind == "mergeCell":
            first, _, last = attributes["ref"].partition(":")
            found.append((*_place(first), *_place(last or first), attributes["ref"]))
        elif kind == "col" and attributes.get("hidden") in ("1", "true"):
            hidden.append((int(attributes["min"]), int(attributes["max"])))

    parser = expat.ParserCreate()
    parser.StartElementHandler = start
    while part := stream.read(STEP_BYTES):
        parser.Parse(part, False)
    parser.Parse(b"", True)
    return sorted(found), hidden


def _cell(c: ElementTree.Element, shared: list) -> dict | None:
    """What a cell says; None if it only has a format."""
    kind, value, formula = c.get("t"), c.find(f"{MAIN}v"), c.find(f"{MAIN}f")
    text, struck, red = value.text if value is not None and value.text else "", [], []
    if kind == "s" and value is not None:
        text, struck, red = shared[int(value.text)]
    elif kind == "inlineStr":
        text, struck, red = _rich(c.find(f"{MAIN}is"))
    if not text and formula is None:
        return None
    current = _without(text, struck)
    state = "formula_no_cache" if formula is not None and value is None else "formula_cached" if formula is not None else "value" if current.strip() else "empty"
    return {"coordinate": c.get("r"), "raw": text, "current": current, "formula": formula.text if formula is not None else None, "state": state, "deleted_spans": struck, "red_spans": red}


def sheet_cells(open_sheet: Callable[[], IO[bytes]], shared: list) -> Iterator[dict]:
    """The cells of a sheet that say something, row by row as the XML passes; a row is let go once it is read.

    A merged area repeats its first cell down to the last row of the sheet that
    has content; rows and columns that only have formats give nothing.
    """
    with open_sheet() as stream:
        areas, hidden = _layout(stream)
    held: list[tuple[tuple[int, int, int, int, str], dict]] = []  # areas that have begun, with their first cell
    due, last = 0, 0

    def unseen(col: int) -> bool:
        return any(low <= col <= high for low, high in hidden)

    def repeats(row: int) -> Iterator[dict]:
        """The copies of the areas that cover a row."""
        for (r1, c1, r2, c2, ref), first in held:
            if r1 <= row <= r2:
                for col in range(c1, c2 + 1):
                    if (row, col) != (r1, c1):
                        yield first | {"row": row, "col": col, "area": ref, "column_hidden": unseen(col)}

    with open_sheet() as stream:
        root = None
        for event, node in ElementTree.iterparse(stream, events=("start", "end")):
            if event == "start":
                if node.tag == f"{MAIN}sheetData":
                    root = node
                continue
            if node.tag != f"{MAIN}row":
                continue
            cells: dict[tuple[int, int], dict] = {}
            for c in node.iter(f"{MAIN}c"):
                row, col = _place(c.get("r"))
                if (own := _cell(c, shared)) is not None:
                    cells[row, col] = own | {"row": row, "col": col, "area": None, "column_hidden": unseen(col)}
            if root is not None:
                root.clear()
            for row in sorted({r for r, _ in cells}):
                for between in range(last + 1, row):
                    yield from repeats(between)
                held = [x for x in held if x[0][2] >= row]
                while due < len(areas) and areas[due][0] <= row:
                    if areas[due][0] == row and (first := cells.get(areas[due][:2])) is not None:
                        held.append((areas[due], first))
                        first["area"] = areas[due][4]
                    due += 1
                own = {place: c for place, c in cells.items() if place[0] == row}
                yield from (own | {(c["row"], c["col"]): c for c in repeats(row)}).values()
                last = row


def workbook_cells(content: bytes) -> Iterator[dict]:
    """The cells of a workbook, sheet after sheet; struck-out text is no current text.

    The texts that its sheets share are held, everything else passes: a sheet of any size takes
    the memory of a row and of the merged areas that cover it.
    """
    book = zipfile.ZipFile(io.BytesIO(content))
    read = lambda name: ElementTree.fromstring(book.read(name))
    shared: list = []
    if "xl/sharedStrings.xml" in book.namelist():
        with book.open("xl/sharedStrings.xml") as stream:
            for _, node in ElementTree.iterparse(stream):
                if node.tag == f"{MAIN}si":
                    shared.append(_rich(node))
                    node.clear()
    links = {r.get("Id"): r.get("Target") for r in read("xl/_rels/workbook.xml.rels")}
    for sheet in read("xl/workbook.xml").iter(f"{MAIN}sheet"):
        place = links[sheet.get(LINK)].lstrip("/")
        place = place if place.startswith("xl/") else f"xl/{place}"
        base = {"sheet": sheet.get("name"), "hidden": sheet.get("state", "visible") != "visible", "error": None}
        for cell in sheet_cells(lambda place=place: book.open(place), shared):
            yield base | cell


def read_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(relative_path, sha256, true_format, length, content) of the files under a folder, lock and dot files left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    head = F.hex(F.substring("content", 1, 8))
    form = F.when(head.startswith("504B0304"), F.when(F.lower(name).endswith(".docx"), "docx").otherwise("xlsx")).when(head.startswith("D0CF11E0"), "ole").when(head.startswith("25504446"), "pdf").otherwise("other")
    return found.where(~name.rlike(r"^(\.|~\$)")).select(F.col("path").alias("relative_path"), F.sha2("content", 256).alias("sha256"), form.alias("true_format"), "length", "content")


def read_cells(files: DataFrame) -> DataFrame:
    """CELLS of the workbooks among ``files``, in bounded batches; a file that can't be read on gives a row with its error."""
    names = [c.split(" ")[0].strip("`") for c in CELLS.replace(SPAN, "spans").split(", ")]

    def batches(path: str, content: bytes) -> Iterator[list[dict]]:
        rows, characters = [], 0
        try:
            for cell in workbook_cells(content):
                rows.append({"relative_path": path} | cell)
                characters += len(cell["current"])
                if len(rows) == BATCH_CELLS or characters > BATCH_CHARACTERS:
                    yield rows
                    rows, characters = [], 0
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, expat.ExpatError, ValueError, IndexError, AttributeError) as e:
            rows.append({"relative_path": path, "row": 0, "col": 0, "error": f"{type(e).__name__}: {e}"})
        yield rows

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["relative_path"], frame["content"]):
                for rows in batches(path, content):
                    yield pd.DataFrame(rows, columns=names).astype(object).where(lambda x: x.notna(), None)

    books = files.where("true_format = 'xlsx'").select("relative_path", "content")
    # One file is a unit of work: a batch of whole workbooks must not pile up in a worker.
    return books.repartition("relative_path").mapInPandas(run, CELLS)


def classify_material(path: Column) -> Column:
    """The kind of material by the words of a file's name."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(name.contains("说明"), "explanation").when(name.contains("矩阵") | name.contains("取证"), "matrix").when(name.contains("三清单"), "three_lists")


def longest_alias(rows: DataFrame, text: str, aliases: DataFrame, alias: str, value: str) -> DataFrame:
    """``rows`` with the value of the longest alias that stands in ``text``; null if two values tie or no alias stands there."""
    named = holding(rows.select(text).distinct(), text, aliases.select(F.col(alias).alias("_a"), F.col(value).alias("_v")).distinct(), "_a")
    by_length = named.groupBy(text, F.length("_a").alias("_n")).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    best = by_length.groupBy(text).agg(F.max(F.struct("_n", "_low", "_high")).alias("_best"))
    one = best.select(text, F.when(F.col("_best._low") == F.col("_best._high"), F.col("_best._low")).alias(value))
    return rows.join(one, text, "left")


def records_from_cells(cells: DataFrame, headers: DataFrame, files: DataFrame, include_hidden: bool = False, regions: DataFrame | None = None) -> DataFrame:
    """Business records: the rows below each header, within its region, that say anything; fields by name.

    ``files`` gives entity_code, business_code, business_id and variant_id of each relative_path.
    ``regions``: the ``title_regions`` of ``cells`` that have not been parted by them.
    """
    cells, place = in_regions(cells) if regions is None else cells, ["relative_path", "sheet", "region"]
    headers = headers if "region" in headers.columns else headers.withColumn("region", F.lit(0))
    visible = cells.where("error IS NULL") if include_hidden else cells.where("error IS NULL AND NOT hidden")
    # Sheets are dealt in blocks of rows, so a long one is the work of many tasks; headers go to every block below them.
    at = place if regions is None else place[:2]
    block = lambda row: F.expr(f"{row} div {BLOCK_ROWS}")
    long = visible.where(F.col("row") >= BLOCK_ROWS).groupBy(*at).agg(F.max(block("`row`")).alias("_last"))
    fields = headers.join(by_key(long), at, "left").withColumn("_last", F.coalesce("_last", F.lit(0)))
    if regions is not None:
        fields = fields.join(by_key(regions.drop("kind")), place, "left").withColumn("_last", F.least("_last", block("last_row")))
    fields = fields.withColumn("_block", F.explode(F.sequence(block("header_row"), F.greatest("_last", block("header_row")))))
    fields = fields.select(*place, "_block", "header_row", "record_type", *([] if regions is None else ["first_row", "last_row", "first_col", "last_col"]), F.map_keys("columns").alias("_all"), F.explode("columns").alias("field", "_col"))
    # A hash leads the keys: rows are sorted by it far faster than by the long texts of places, which begin alike.
    keyed = lambda df: by_key(df.withColumn("_at", F.xxhash64(*at, "_block")))
    # The column is compared, but is no key: cells of a row stay together, and are gathered without being dealt again.
    visible = visible if regions is None else with_area(visible)
    own = keyed(visible.withColumn("_block", block("`row`"))).join(keyed(fields), ["_at", *at, "_block"]).where((F.col("row") > F.col("header_row")) & F.col("col").between(F.col("_col"), F.col("_col")))
    if regions is not None:
        own = own.where(F.col("first_row").isNull() | within())
    cell = F.struct(
        "raw",
        "current",
        "coordinate",
        "formula",
        F.when(F.col("state") == "formula_cached", F.col("current")).alias("cached"),
        "state",
        "deleted_spans",
        F.lit(False).alias("deleted_unavailable"),
        "red_spans",
    )
    # Rows lie together once sorted, so a window gathers them: the two steps of an aggregate would copy every cell twice more.
    row = [*place, "_block", "row", "record_type"]
    window = Window.partitionBy("_at", *row).orderBy("_col")
    every = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = own.select("_at", *row, "_all", "_col", F.struct("field", cell.alias("cell")).alias("_cell"), (F.col("state") != "empty").alias("_full"))
    rows = rows.withColumn("_n", F.row_number().over(window)).withColumn("_cells", F.collect_list("_cell").over(every)).withColumn("_some", F.bool_or("_full").over(every))
    rows = rows.where("_n = 1 AND _some").withColumn("fields", F.map_from_entries("_cells"))
    # A column that the header names but a row leaves out is an empty cell, not an absent one.
    blank = F.struct(
        F.lit("").alias("raw"), F.lit("").alias("current"), F.lit("").alias("coordinate"), F.lit(None).cast("string").alias("formula"), F.lit(None).cast("string").alias("cached"), F.lit("empty").alias("state"),
        F.array().cast(SPAN).alias("deleted_spans"), F.lit(False).alias("deleted_unavailable"), F.array().cast(SPAN).alias("red_spans"),
    )
    rows = rows.withColumn("_left", F.array_except("_all", F.map_keys("fields")))
    rows = rows.withColumn("fields", F.when(F.size("_left") == 0, F.col("fields")).otherwise(F.map_concat("fields", F.map_from_entries(F.transform("_left", lambda k: F.struct(k, blank))))))
    person = F.element_at("fields", "person_names")["current"]
    number = F.element_at("fields", "person_ids")["current"]
    names = F.filter(F.split(F.coalesce(person, F.lit("")), r"[、,，;；/\s]+"), lambda x: x != "")
    ids = F.filter(F.split(F.coalesce(number, F.lit("")), r"[、,，;；/\s]+"), lambda x: x != "")
    sure = (F.size(names) == 1) & (F.size(ids) == 1)
    people = F.transform(names, lambda n: F.struct(n.alias("name"), F.when(sure, F.get(ids, F.lit(0))).alias("person_id"), sure.alias("identity_reliable")))
    scopes = files.select("relative_path", "entity_code", "business_code", F.coalesce("business_id", "business_code").alias("business_id"), F.coalesce("variant_id", F.lit("default")).alias("variant_id"))
    few = scopes.limit(SHORT_TABLE + 1).count() <= SHORT_TABLE
    out = rows.join(F.broadcast(scopes) if few else by_key(scopes), "relative_path").select(
        "record_type", "entity_code", "business_code", "business_id", "variant_id", F.col("relative_path").alias("file_path"), "sheet", "row", "fields", F.lit(None).cast("string").alias("record_id"), people.alias("person_keys")
    )
    return with_record_id(out)


def with_system_types(records: DataFrame) -> DataFrame:
    """System rules whose type is blank take the one that their owner tells."""
    from rulespark.functions import facts

    owner = norm_text(F.coalesce(F.element_at("fields", "system_owner")["current"], F.lit("")))
    records = records.withColumn("_level", facts.system_level(owner))
    kind = F.col("_level")
    blank = F.coalesce(F.element_at("fields", "system_type")["current"], F.lit("")) == ""
    fill = (F.col("record_type") == "system_rule") & blank & kind.isNotNull() & F.map_contains_key("fields", F.lit("system_type"))
    filled = F.transform_values("fields", lambda k, v: F.when(k == "system_type", v.withField("current", kind).withField("state", F.lit("value"))).otherwise(v))
    return records.withColumn("fields", F.when(fill, filled).otherwise(F.col("fields"))).drop("_level")
