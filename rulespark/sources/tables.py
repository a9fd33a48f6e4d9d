"""Tables within sheets: the regions that titles part a sheet into, and the rows that head them.

A title on its own row begins a region that reaches to the next title below or
beside it; cells join their region by intervals.  A header is the first row of
a region that names every core field of a type, where a cell names a field by
its text, or by the text without bracketed notes, remarks after a colon or a
line end, or qualifiers; if that is not enough, among the first rows by the
longest alias that the text holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulespark.functions import facts
from rulespark.functions.duties import once
from rulespark.functions.keys import BLANK, contains_any, fold_text, is_ascii, norm_literal, norm_text, strip_blanks
from rulespark.sources.stored import SHORT_TABLE, by_key, stored

PLACE = ["relative_path", "sheet"]

# Titles of lists, what may stand beside them, and sheets that hold none.
TITLES = {
    "matrix": ["风控矩阵", "风险控制矩阵"],
    "position_duty": ["岗位内控责任清单", "岗位职责清单"],
    "incompatible_position": ["不相容岗位清单"],
    "system_rule": ["系统控制规则清单", "系统规则清单"],
}
TITLE_NUMBER = r"(?:[一二三四五六七八九十\d]+[、.．)）:：]?)*"
TITLE_END = r"(?:填报区域|填报区|填报表)?(?:\([^()]*\))?"
FORM_REMARK = r"^(?:填报单位|编制单位|会计主体|单位名称|填报日期|编制日期|填报人|填报部门|日期)[:：].+"
AUXILIARY = ["核对过程", "核对版本", "意见建议", "业务流程", "流程图", "填报说明", "WpsReserved"]

# Headers that are told by a pattern: (type, pattern, field); the first group is the unit they belong to.
HEADER_PATTERNS = [
    ("matrix", r"^(.*?)[-—:：]?(?:矩阵)?是否适用.*$", "applicability"),
    ("matrix", r"^((?:.*(?:公司|分公司|本部))?)(?:修改备注|不适用原因|不适用理由)$", "applicability_reason"),
    ("matrix", r"^()(?:备注\(适用情况\)|矩阵适用情况)$", "applicability"),
    ("matrix", r"^([一-鿿]{0,40}?)(?:矩阵)?适用情况(?:[,，].*)?$", "applicability"),
    ("matrix", r"^((?:.*(?:公司|分公司|本部|中心))?)[-—:：]?责任主体(?:\((?:市公司|原集体企业|需根据实际情况调整)\))?$", "responsibility"),
    ("matrix", r"^责任主体\(([^()]*(?:公司|分公司|本部|中心))\)$", "responsibility"),
    ("matrix", r"^()(?:公司控制载体|控制载体\(原集体企业\)|控制载体\(市公司\))$", "carrier"),
    ("position_duty", r"^().*姓名.*$", "person_names"),
    ("position_duty", r"^()部门\([^()]{1,30}\)$", "department"),
]

#: More than the columns of any sheet: what a fuzzy name adds to its column.
FUZZY = 1 << 32

#: Rows from the top of a region in which a header may be told by the longest alias its texts hold.
FUZZY_ROWS = 5


def title_kind(text: Column) -> Column:
    """The list that a normalised text is the whole title of, else null."""
    kinds = [F.when(text.rlike(f"^{TITLE_NUMBER}(?:{'|'.join(names)}){TITLE_END}$"), F.lit(kind)) for kind, names in TITLES.items()]
    found = F.array_compact(F.array(*kinds))
    # Hardly any text holds the name of a list; the patterns are for those.
    return F.when(contains_any(text, [name for names in TITLES.values() for name in names]), F.when(F.size(found) == 1, F.get(found, F.lit(0))))


def title_regions(cells: DataFrame) -> DataFrame:
    """(relative_path, sheet, region, kind, first_row, last_row, first_col, last_col): what the titles of a sheet part it into.

    A row counts as titles if it holds nothing else than titles and remarks of
    the form.  The last bounds are null where nothing follows.  Sheets of
    auxiliary names have no regions.
    """
    said = cells.where("error IS NULL AND state != 'empty' AND area IS NULL OR coordinate IS NOT NULL AND area LIKE concat(coordinate, ':%')").where(~contains_any(F.col("sheet"), AUXILIARY))
    # A merged area speaks by its first cell.
    row, col = _reference(F.col("coordinate"))
    said = said.where(F.when(F.col("area").isNull(), True).otherwise((F.col("row") == row) & (F.col("col") == col)))
    # A text of ASCII alone needs no folding, and is no title and no remark.
    other = said.where(~is_ascii(F.col("current"))).select(*PLACE, "row", "col", fold_text(F.col("current")).alias("_text"))
    other = once(once(other, _text=strip_blanks(F.col("_text"))).where("_text != ''"), kind=title_kind(F.col("_text")))
    other = stored(other.select(*PLACE, "row", "col", "kind", (F.col("kind").isNotNull() | F.col("_text").rlike(FORM_REMARK)).alias("_fits")))
    ascii = said.where(is_ascii(F.col("current")) & F.col("current").rlike(r"\S")).select(*PLACE, "row", F.lit(None).cast("string").alias("kind"), F.lit(False).alias("_fits"))
    # Few rows are titles: those are counted out before the titles themselves are gathered.
    pure = other.select(*PLACE, "row", "kind", "_fits").unionByName(ascii).groupBy(*PLACE, "row").agg(F.bool_and("_fits").alias("_pure"), F.count("kind").alias("_some")).where("_pure AND _some > 0").select(*PLACE, "row")
    rows = other.where("kind IS NOT NULL").join(by_key(pure), [*PLACE, "row"]).groupBy(*PLACE, "row").agg(F.sort_array(F.collect_set(F.struct("col", "kind"))).alias("_titles"))
    rows = rows.withColumn("last_row", F.lead("row").over(Window.partitionBy(*PLACE).orderBy("row")) - 1)
    one = rows.select(*PLACE, "row", "last_row", F.size("_titles").alias("_n"), "_titles", F.posexplode("_titles").alias("_k", "_t"))
    regions = one.select(
        *PLACE, F.col("_t.kind").alias("kind"), F.col("row").alias("first_row"), "last_row",
        F.when(F.col("_n") == 1, 1).otherwise(F.col("_t.col")).alias("first_col"), (F.get("_titles", F.col("_k") + 1)["col"] - 1).alias("last_col"),
    )
    return regions.withColumn("region", F.row_number().over(Window.partitionBy(*PLACE).orderBy("first_row", "first_col")))


def _reference(reference: Column) -> tuple[Column, Column]:
    """Row and column of a reference such as B7."""
    letters = F.regexp_extract(reference, "^([A-Z]+)", 1)
    col = F.aggregate(F.split(letters, ""), F.lit(0), lambda n, c: F.when(c == "", n).otherwise(n * 26 + F.ascii(c) - 64))
    return F.regexp_extract(reference, r"(\d+)$", 1).cast("int"), col


def with_area(cells: DataFrame) -> DataFrame:
    """``cells`` with ``_area``: the corners of the merged area that a cell belongs to, null for most; told here once, not at every region."""
    (r1, c1), (r2, c2) = (_reference(F.split_part(F.col("area"), F.lit(":"), F.lit(k))) for k in (1, 2))
    return cells.withColumn("_area", F.when(F.col("area").isNotNull(), F.struct(r1.alias("r1"), c1.alias("c1"), r2.alias("r2"), c2.alias("c2"))))


def within() -> Column:
    """Whether a cell (row, col, _area) counts in the region beside it (first_row, last_row, first_col, last_col).

    A merged area that reaches beyond a region repeats nothing within it, so
    that no table hands its texts down to the next.
    """
    last_row, last_col, area = F.col("last_row"), F.col("last_col"), F.col("_area")
    inside = (F.col("row") >= F.col("first_row")) & (last_row.isNull() | (F.col("row") <= last_row)) & (F.col("col") >= F.col("first_col")) & (last_col.isNull() | (F.col("col") <= last_col))
    whole = (area["r1"] >= F.col("first_row")) & (last_row.isNull() | (area["r2"] <= last_row)) & (area["c1"] >= F.col("first_col")) & (last_col.isNull() | (area["c2"] <= last_col))
    first = (F.col("row") == area["r1"]) & (F.col("col") == area["c1"])
    return inside & (area.isNull() | whole | first)


def with_regions(cells: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """``cells`` with ``region`` and ``region_kind``: 0 and null on sheets without titles; cells before the first title of a sheet drop out.

    ``regions``: the ``title_regions`` of all cells, where ``cells`` are some of them.
    """
    regions = stored(title_regions(cells)) if regions is None else regions
    # Beside its regions, a sheet that has any is one that meets all its cells: what meets no other stands before the titles.
    sheets = regions.select(*PLACE).distinct().withColumn("region", F.lit(0))
    parts = regions.unionByName(sheets, allowMissingColumns=True).select(*(F.col(c).alias(f"_of_{c}") for c in PLACE), F.col("region").alias("_region"), F.col("kind").alias("region_kind"), "first_row", "last_row", "first_col", "last_col")
    same = (F.col("relative_path") == F.col("_of_relative_path")) & (F.col("sheet") == F.col("_of_sheet"))
    found = with_area(cells).join(by_key(parts), same & ((F.col("_region") == 0) | within()), "left")
    kept = F.col("_region").isNull() | (F.col("_region") > 0) & F.col("error").isNull()
    return found.where(kept).select(*cells.columns, F.coalesce("_region", F.lit(0)).alias("region"), "region_kind")


def in_regions(cells: DataFrame) -> DataFrame:
    """``cells``, with every cell of a sheet in one region where nobody has parted them."""
    if "region" in cells.columns:
        return cells
    return cells.withColumn("region", F.lit(0)).withColumn("region_kind", F.lit(None).cast("string"))


def _before_last_group(text: Column) -> Column:
    """The text before the bracketed group at its end; null without one."""
    begin = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("seen"), F.lit(-1).alias("cut"))

    def step(s: Column, c: Column) -> Column:
        depth = s["depth"] + F.when(c.isin(")", "]", "】"), 1).when(c.isin("(", "[", "【"), -1).otherwise(0)
        done = (depth <= 0) & (s["seen"] >= 0)
        return F.when(s["cut"] >= 0, s).otherwise(F.struct(depth.alias("depth"), (s["seen"] + 1).alias("seen"), F.when(done, s["seen"] + 1).otherwise(-1).alias("cut")))

    cut = F.aggregate(F.reverse(F.filter(F.split(text, ""), lambda c: c != "")), begin, step)["cut"]
    closed = text.rlike(r"[)\]】]$") & (cut > 0) & (cut < F.length(text)) & F.substr(text, F.length(text) - cut + 1, F.lit(1)).isin("(", "[", "【")
    return F.when(closed, F.rtrim(F.substr(text, F.lit(1), F.length(text) - cut)))


def header_candidates(text: Column, aliases: list[str]) -> Column:
    """What a header may say, the fullest first: the text, without the groups at its end, and what stands before a line end or a colon.

    A boundary is passed over if an alias follows it: two fields in one cell name none.
    """
    raw = F.trim(text, F.lit(" \t\r\n"))

    def bare(t: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(4)), F.array(t), lambda found, _: F.when(_before_last_group(F.element_at(found, -1)).isNull(), found).otherwise(F.concat(found, F.array(_before_last_group(F.element_at(found, -1))))))

    parts = F.filter(F.split(raw, ""), lambda c: c != "")
    ends = F.filter(F.transform(parts, lambda c, i: F.when(c.isin("\r", "\n", ":", "："), i)), lambda i: i.isNotNull())
    tail = lambda i: strip_blanks(F.substr(raw, i + 2))
    usable = F.reverse(F.filter(ends, lambda i: ~tail(i).isin(*aliases)))
    found = F.concat(bare(raw), F.flatten(F.transform(usable, lambda i: bare(F.rtrim(F.substr(raw, F.lit(1), i))))))
    return F.array_distinct(F.filter(F.transform(found, strip_blanks), lambda t: t != ""))


def named_headers(cells: DataFrame, aliases: dict[str, dict[str, list[str]]], regions: DataFrame | None = None) -> DataFrame:
    """(…place, region, row, col, record_type, field, owner, fuzzy): the fields that cells name.

    ``cells`` have their region, or it is told by ``regions`` for those that may name a field.

    Exact by the first candidate that is an alias or fits a pattern, with the unit it names;
    fuzzy by the longest alias in the text, where longest aliases of one field only.
    """
    listed = [(t, f, norm_literal(a)) for t, fields in aliases.items() for f, names in fields.items() for a in [f, *names]]
    table = F.broadcast(cells.sparkSession.createDataFrame(sorted(set(listed)), "record_type string, field string, header string"))
    words = sorted({a for _, _, a in listed} | {"适用", "责任主体", "控制载体", "姓名", "修改备注", "不适用原因", "不适用理由", "部门"})
    where = [*PLACE, "region", "row", "col"]
    kept = [*where, "region_kind"] if regions is None else [*PLACE, "row", "col", "area", "error"]
    # Folding leaves ASCII as it is, so most texts of ASCII alone are passed over before it.
    may = ~is_ascii(F.col("current")) | F.col("current").rlike(BLANK) | contains_any(F.col("current"), [w for w in words if w.isascii()])
    texts = cells.where("error IS NULL AND state != 'empty'").where(may).select(*kept, fold_text(F.col("current")).alias("_raw"))
    texts = stored(once(texts, _text=strip_blanks(F.col("_raw"))).where(contains_any(F.col("_text"), words)))
    said = texts.select("_raw", "_text").distinct()
    said = said.select("_raw", "_text", F.posexplode(header_candidates(F.col("_raw"), [a for _, _, a in listed])).alias("_order", "header"))
    by_alias = said.join(table, "header").select("_raw", "_order", F.lit(99).alias("_rule"), "record_type", "field", F.lit("").alias("owner"))
    rules = F.array(*(F.struct(F.lit(k).alias("rule"), F.lit(t).alias("record_type"), F.lit(f).alias("field"), F.regexp_extract("header", p, 1).alias("owner"), F.col("header").rlike(p).alias("fits")) for k, (t, p, f) in enumerate(HEADER_PATTERNS)))
    by_rule = said.select("_raw", "_order", F.explode(F.filter(rules, lambda r: r["fits"])).alias("r")).select("_raw", "_order", F.col("r.rule").alias("_rule"), "r.record_type", "r.field", F.regexp_replace("r.owner", "[-—:：]+$", "").alias("owner"))
    by_rule = by_rule.where(F.col("record_type").isin(list(aliases)))
    best = by_alias.unionByName(by_rule).groupBy("_raw", "record_type").agg(F.min(F.struct("_order", "_rule", "field", "owner")).alias("_best"))
    exact = best.select("_raw", "record_type", F.col("_best.field").alias("field"), F.col("_best.owner").alias("owner"), F.lit(False).alias("fuzzy"))
    held = said.select("_raw", "_text").distinct().join(table, F.contains("_text", F.col("header"))).where("header != field").groupBy("_raw", "record_type", F.length("header").alias("_n")).agg(F.min("field").alias("_low"), F.max("field").alias("_high"))
    longest = held.groupBy("_raw", "record_type").agg(F.max(F.struct("_n", "_low", "_high")).alias("_best")).where("_best._low = _best._high")
    loose = longest.select("_raw", "record_type", F.col("_best._low").alias("field"), F.lit("").alias("owner"), F.lit(True).alias("fuzzy")).join(exact.select("_raw", "record_type"), ["_raw", "record_type"], "left_anti")
    # Headers are few texts on many sheets; which side is short can't be told from the size of a stored table.
    told = stored(exact.unionByName(loose))
    told = F.broadcast(told) if told.limit(SHORT_TABLE + 1).count() <= SHORT_TABLE else by_key(told)
    texts = texts if regions is None else with_regions(texts, regions)
    return texts.join(told, "_raw").where("region_kind IS NULL OR region_kind = record_type").select(*where, "record_type", "field", "owner", "fuzzy")


def header_rows(cells: DataFrame, aliases: dict[str, dict[str, list[str]]], core: dict[str, list[str]], regions: DataFrame | None = None) -> DataFrame:
    """(relative_path, sheet, region, header_row, record_type, columns): the first row of a region that names all core fields of a type.

    ``aliases``: record type -> field -> header texts; ``core``: record type ->
    fields a header has to name.  Of several columns that name a field the
    first counts, an exact one before a fuzzy one.  Fuzzy names count among the first FUZZY_ROWS rows
    of a region, and only if the row is complete with them.  ``regions``: the
    ``title_regions`` of ``cells`` that have not been parted by them.
    """
    cells = in_regions(cells) if regions is None else cells
    where = [*PLACE, "region", "row", "record_type"]
    if regions is None:
        top = cells.where("error IS NULL").groupBy(*PLACE, "region").agg(F.min("row").alias("_top"))
    else:
        # A region begins with its title.
        top = cells.where("error IS NULL").groupBy(*PLACE).agg(F.min("row").alias("_top")).withColumn("region", F.lit(0))
        top = top.unionByName(regions.select(*PLACE, "region", F.col("first_row").alias("_top")))
    # One number in the order of (fuzzy, col), which is summed up faster than a struct.
    first = named_headers(cells, aliases, regions).groupBy(*where, "field").agg(F.min(F.col("fuzzy").cast("long") * FUZZY + F.col("col")).alias("_c"))
    rows = first.groupBy(*where).agg(F.collect_list(F.struct("field", (F.col("_c") % FUZZY).cast("int").alias("col"), (F.col("_c") >= FUZZY).alias("fuzzy"))).alias("_all"))
    rows = rows.join(by_key(top), [*PLACE, "region"])
    # An exact name and a fuzzy one can claim one column of different fields never: a cell has one of the two.
    exact = F.filter("_all", lambda x: ~x["fuzzy"])
    whole, whole_fuzzy = F.lit(False), F.lit(False)
    for kind, fields in core.items():
        wanted = F.array(*(F.lit(f) for f in fields)).cast("array<string>")
        own = F.col("record_type") == kind
        whole = whole | (own & (F.size(F.array_except(wanted, F.transform(exact, lambda x: x["field"]))) == 0))
        whole_fuzzy = whole_fuzzy | (own & (F.size(F.array_except(wanted, F.transform("_all", lambda x: x["field"]))) == 0))
    rows = rows.withColumn("_some", F.when(whole_fuzzy & (F.col("row") < F.col("_top") + FUZZY_ROWS), F.col("_all")).when(whole, exact)).where("_some IS NOT NULL")
    rows = rows.withColumn("columns", F.map_from_entries(F.transform("_some", lambda x: F.struct(x["field"], x["col"]))))
    w = Window.partitionBy(*PLACE, "region").orderBy("row", F.size("columns").desc(), "record_type")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*PLACE, "region", F.col("row").alias("header_row"), "record_type", "columns")


# Fields that a header names for a unit, and the field that stands beside another.
OWNED_FIELDS = ["applicability", "control_measure", "carrier"]
BESIDE = {"applicability_reason": "applicability", "position": "department"}


def read_texts(cells: DataFrame) -> DataFrame:
    """(place, region, row, col, column_hidden, _text, _said): normalised texts and the answer that each gives, as a table that several plans read."""
    texts = in_regions(cells).where("error IS NULL").select(*PLACE, "region", "row", "col", "column_hidden", norm_text(F.col("current")).alias("_text"))
    return stored(once(texts, _said=facts.applicability(F.col("_text"))["decision"]))


def column_profiles(cells: DataFrame, headers: DataFrame, aliases: dict[str, dict[str, list[str]]], names: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """(place, region, record_type, header_row, field, col, owner, hidden, valid, owned, signature, explicit, unclear, own_rows): every column that a header row names for a field, with what stands below.

    ``names``: relative_path and name, the forms under which the unit of a file
    goes.  A column is valid if its header names no unit, this one, or asks for
    applicability in so many words.  The signature sums up the rows, so that
    equal columns have equal ones.
    """
    cells = in_regions(cells)
    where = [*PLACE, "region"]
    own = names.groupBy("relative_path").agg(F.collect_set(norm_text(F.col("name"))).alias("_names"))
    named = named_headers(cells, aliases).withColumnRenamed("row", "header_row").join(by_key(headers.select(*where, "header_row", "record_type", "columns")), [*where, "header_row", "record_type"])
    # A fuzzy column is one that the header row was completed with.
    named = named.where(~F.col("fuzzy") | F.coalesce(F.element_at("columns", F.col("field")) == F.col("col"), F.lit(False))).drop("columns", "fuzzy")
    text = read_texts(cells) if texts is None else texts
    titles = text.select(*where, F.col("row").alias("header_row"), "col", "column_hidden", F.col("_text").alias("_header"))
    named = named.join(by_key(titles), [*where, "header_row", "col"]).join(own, "relative_path", "left").withColumn("_names", F.coalesce("_names", F.array().cast("array<string>")))
    owned = (F.col("owner") != "") & F.array_contains("_names", F.col("owner"))
    valid = (F.col("owner") == "") | owned | ((F.col("field") == "applicability") & F.col("_header").contains("是否适用"))
    keys = [*where, "record_type", "header_row", "field", "col", "owner"]
    named = named.select(*keys, F.coalesce("column_hidden", F.lit(False)).alias("hidden"), valid.alias("valid"), owned.alias("owned"), "_names")
    below = named.join(by_key(text.select(*where, "row", "col", "_text", "_said").where("_text != ''")), [*where, "col"], "left")
    below = below.withColumn("_said", F.when(F.col("row") > F.col("header_row"), F.col("_said"))).withColumn("_text", F.when(F.col("row") > F.col("header_row"), F.col("_text")))
    counted = below.groupBy(*keys, "hidden", "valid", "owned").agg(
        F.coalesce(F.sum(F.when(F.col("_text").isNotNull(), F.xxhash64("row", "_text").cast("decimal(38,0)"))), F.lit(0)).cast("decimal(38,0)").alias("signature"),
        F.count_if(F.col("_said").isNotNull()).alias("explicit"), F.count_if(F.col("_text").isNotNull() & F.col("_said").isNull()).alias("unclear"),
        F.count_if(F.col("_text").isNotNull() & F.exists("_names", lambda n: F.contains(F.col("_text"), n))).alias("own_rows"),
    )
    return counted


def resolved_columns(cells: DataFrame, headers: DataFrame, aliases: dict[str, dict[str, list[str]]], names: DataFrame) -> DataFrame:
    """``headers`` with one column a field, told by owner, visibility and content, and ``reasons`` (field -> why).

    Of the valid columns of a field the visible ones count, hidden ones only if
    there is no other.  Of several: the one whose header names the unit; the one whose
    cells do; the one beside the column it belongs to; any of equal ones; for
    applicability the only one that answers every row it fills, if no other
    contradicts it.  A field without a valid column is ``owner_unconfirmed``, one that this does not
    decide a ``column_conflict``; both drop out of ``columns``.
    """
    texts = read_texts(cells)
    profiles = stored(column_profiles(cells, headers, aliases, names, texts))
    where = [*PLACE, "region", "record_type", "header_row"]
    option = F.struct("col", "owned", "hidden", "signature", "explicit", "unclear", "own_rows")
    fields = profiles.groupBy(*where, "field").agg(F.array_sort(F.collect_list(F.when(F.col("valid"), option))).alias("_valid"))
    shown = F.filter("_valid", lambda o: ~o["hidden"])
    fields = fields.withColumn("_options", F.when(F.size(shown) > 0, shown).otherwise(F.col("_valid"))).withColumn("_hid", F.size("_options") < F.size("_valid"))

    # Rows of an applicability whose options answer differently.
    answers = profiles.where("field = 'applicability' AND valid").select(*where, "col", "hidden")
    text = texts.where("_said IS NOT NULL").select(*PLACE, "region", "row", "col", "_said")
    said = answers.join(by_key(text), [*PLACE, "region", "col"]).where(F.col("row") > F.col("header_row"))
    by_row = said.groupBy(*where, "row").agg(F.min("_said").alias("_low"), F.max("_said").alias("_high"))
    against = by_row.groupBy(*where).agg(F.count_if(F.col("_low") != F.col("_high")).alias("_against"))
    # Read by three plans below, which would each be planned with all of it written out.
    fields = stored(fields.join(by_key(against), where, "left"))

    def only(condition) -> Column:
        """The one option that fits, else null."""
        fit = F.filter("_options", condition)
        return F.when(F.size(fit) == 1, F.get(fit, F.lit(0))["col"])

    first, last = F.get("_options", F.lit(0))["col"], F.try_element_at(F.col("_options"), F.lit(-1))["col"]
    owned = F.when(F.col("field").isin(OWNED_FIELDS), only(lambda o: o["owned"]))
    by_values = only(lambda o: o["own_rows"] > 0)
    equal = F.size(F.array_distinct(F.transform("_options", lambda o: o["signature"]))) == 1
    answered = F.when((F.col("field") == "applicability") & (F.coalesce("_against", F.lit(0)) == 0), only(lambda o: (o["explicit"] > 0) & (o["unclear"] == 0)))
    verdict = lambda col, why: F.struct(col.cast("int").alias("col"), F.lit(why).alias("why"))

    def chosen(beside: Column) -> Column:
        paired = only(lambda o: o["col"] == beside + 1)
        return (
            F.when(F.size("_options") == 0, verdict(F.lit(None), "owner_unconfirmed"))
            .when((F.size("_options") == 1) & F.col("_hid"), verdict(first, "visible_equivalent_preferred"))
            .when((F.size("_options") == 1) & F.get("_options", F.lit(0))["hidden"], verdict(first, "hidden_field_required"))
            .when(F.size("_options") == 1, verdict(first, "single_field"))
            .when(owned.isNotNull(), verdict(owned, "current_unit_header"))
            .when(by_values.isNotNull(), verdict(by_values, "current_unit_values"))
            .when(paired.isNotNull(), verdict(paired, "paired"))
            .when(equal, verdict(F.when(F.col("field") == "applicability", last).otherwise(first), "equivalent_columns"))
            .when(answered.isNotNull(), verdict(answered, "answer_values"))
            .otherwise(verdict(F.lit(None), "column_conflict"))
        )

    # What a column stands beside does not stand beside another itself.
    alone = fields.where(~F.col("field").isin(list(BESIDE))).withColumn("_c", chosen(F.lit(None).cast("int")))
    alone = stored(alone.select(*where, "field", "_c.col", "_c.why"))
    out = alone
    for field, other in BESIDE.items():
        anchor = alone.where(F.col("field") == other).select(*where, F.col("col").alias("_beside"))
        out = out.unionByName(fields.where(F.col("field") == field).join(by_key(anchor), where, "left").withColumn("_c", chosen(F.col("_beside"))).select(*where, "field", "_c.col", "_c.why"))
    whole = out.groupBy(*where).agg(
        F.map_from_entries(F.array_compact(F.collect_list(F.when(F.col("col").isNotNull(), F.struct("field", "col"))))).alias("_columns"), F.map_from_entries(F.collect_list(F.struct("field", "why"))).alias("reasons")
    )
    return headers.join(by_key(whole), where, "left").withColumn("columns", F.coalesce("_columns", F.col("columns"))).drop("_columns")
