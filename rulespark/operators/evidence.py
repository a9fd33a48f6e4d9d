"""What material says of itself: whose it is, which names it uses, how its headers changed, and which row a name may mean.

None of it decides a check; each result carries the evidence it rests on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulespark.functions.keys import norm_text
from rulespark.operators.relational import holding

#: Characters of a full name at least.
LEAST_NAME = 6


def voted_units(texts: DataFrame, file: str, text: str, roster: DataFrame, aliases: DataFrame) -> DataFrame:
    """(file, entity_code, evidence, conflict): the unit that the texts of a file name.

    ``roster``: entity_code and name; ``aliases``: alias and entity_code.  Within a
    text a full name counts only if no longer one that holds it was found
    there; in another text it counts by itself.  Where no full name is found,
    confirmed short names and codes that are a whole text vote.  One unit is
    the answer; several are a conflict, with the evidence of all.
    """
    said = texts.select(file, norm_text(F.col(text)).alias("_text")).where("_text != ''").distinct()
    names = roster.select("entity_code", F.col("name").alias("_shown"), norm_text(F.col("name")).alias("_name")).where(F.length("_name") >= LEAST_NAME)
    found = holding(said.select("_text").distinct(), "_text", names, "_name")
    longer = found.select("_text", F.col("_name").alias("_longer")).distinct()
    maximal = found.join(longer, (found["_text"] == longer["_text"]) & (F.col("_name") != F.col("_longer")) & F.contains("_longer", F.col("_name")), "left_anti")
    full = said.join(maximal, "_text").select(file, "entity_code", F.concat(F.lit("标准全称:"), "_shown").alias("_by"))
    short = holding(said.select("_text").distinct(), "_text", aliases.select("entity_code", "alias", norm_text(F.col("alias")).alias("_alias")), "_alias")
    code = said.join(roster.select("entity_code", norm_text(F.col("entity_code")).alias("_text")).where("_text != ''"), "_text")
    less = said.join(short, "_text").select(file, "entity_code", F.concat(F.lit("确认简称:"), "alias").alias("_by")).unionByName(code.select(file, "entity_code", F.concat(F.lit("单位代码:"), "entity_code").alias("_by")))
    votes = full.unionByName(less.join(full.select(file).distinct(), file, "left_anti")).distinct()
    counted = votes.groupBy(file).agg(F.min("entity_code").alias("_low"), F.max("entity_code").alias("_high"), F.array_sort(F.collect_set("_by")).alias("evidence"))
    one = F.col("_low") == F.col("_high")
    out = texts.select(file).distinct().join(counted, file, "left")
    return out.select(file, F.when(one, F.col("_low")).alias("entity_code"), F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"), F.coalesce(~one, F.lit(False)).alias("conflict"))


# Cells that hold no name, and what a name does not hold.
NO_TERM = ["无", "不涉及", "不适用", "暂无", "待定", "部门", "岗位名称", "控制载体"]
NOT_A_NAME = r"[。；;\n]|(?:负有?|承担).{0,8}责任|请(?:明确|填写|修改)"
REVIEW_HEADER = r"(?:\d{1,2}[.月-]\d{1,2}.*初审|初审|审核意见|复审意见|省公司版本责任主体[（(]核对后删除|岗位清单已有的控制措施编号)"
LIST_NUMBER = r"^\s*(?:\d+[.．、)]|[（(]\d+[)）])\s*"
#: Characters that a term of a carrier, and of another field, has at most.
MOST_CARRIER, MOST_TERM = 100, 55


def admissible(term: Column, field: Column) -> Column:
    """Whether a cell's item may be a term: a name of its own, not a remark or a sentence."""
    n = norm_text(term)
    sized = F.length(n).between(F.lit(2), F.when(field == "carrier", MOST_CARRIER).otherwise(MOST_TERM))
    return sized & ~term.rlike(REVIEW_HEADER) & ~n.startswith("=") & ~n.isin(NO_TERM) & ~term.rlike(NOT_A_NAME)


def term_catalog(cells: DataFrame, holdout_units: Sequence[str] = (), sources: int = 3) -> DataFrame:
    """(field, term, spellings, occurrences, holdout_occurrences, eligible_occurrences, units, businesses, first_sources, status).

    ``cells``: field, text, entity_code, business_code, source and eligible (its
    sheet is a current, visible one of a known scope).  A unit is held out as a
    whole, so that what is recognised can be tried on material that taught
    nothing.  A term is ``recognition_only`` if eligible material of other units uses it,
    else ``candidate_only``; neither makes it right or equal to another.
    Carrier cells are lists; ``first_sources`` are the first places in order.
    """
    held = F.coalesce(F.col("entity_code").isin(*holdout_units) if holdout_units else F.lit(False), F.lit(False))
    split = F.split("text", r"[;；\n、，,](?![^（(【《\[]*[)）】》\]])")
    items = F.when(F.col("field") == "carrier", F.transform(split, lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, LIST_NUMBER, ""), r"^[ \t\r。；;，,]+|[ \t\r。；;，,]+$", ""), "^《([^》]*)》$", "$1"))).otherwise(F.array("text"))
    listed = cells.withColumn("_held", held).withColumn("spelling", F.explode(items)).where(F.col("spelling") != "")
    # A spelling is judged once however often it stands somewhere.
    judged = listed.select("field", "spelling").distinct().where(admissible(F.col("spelling"), F.col("field"))).withColumn("term", norm_text(F.col("spelling")))
    partial = listed.groupBy("field", "spelling", "entity_code", "business_code", "source").agg(F.count(F.lit(1)).alias("_n"), F.count_if("_held").alias("_h"), F.count_if(F.col("eligible") & ~F.col("_held")).alias("_e"))
    used = partial.join(judged, ["field", "spelling"])
    first = F.row_number().over(Window.partitionBy("field", "term").orderBy("source"))
    places = used.select("field", "term", "source").distinct().withColumn("_k", first).where(F.col("_k") <= sources)
    shown = places.groupBy("field", "term").agg(F.array_sort(F.collect_list("source")).alias("first_sources"))
    out = used.groupBy("field", "term").agg(
        F.array_sort(F.collect_set("spelling")).alias("spellings"), F.sum("_n").alias("occurrences"), F.sum("_h").alias("holdout_occurrences"), F.sum("_e").alias("eligible_occurrences"),
        F.count_distinct("entity_code").alias("units"), F.count_distinct("business_code").alias("businesses"),
    )
    return out.join(shown, ["field", "term"]).withColumn("status", F.when(F.col("eligible_occurrences") > 0, "recognition_only").otherwise("candidate_only"))


def header_changes(actual: DataFrame, expected: DataFrame, template: Sequence[str]) -> DataFrame:
    """(relative_path, sheet, coordinate, expected_path, actual_path): headers of a frozen template that a sheet lacks or names otherwise.

    ``actual``: relative_path, sheet, the columns ``template`` that tell the
    template, coordinate and path (texts from the topmost group to the column);
    ``expected``: the columns ``template``, coordinate and path.  Texts are compared
    normalised; a coordinate without a header has a null ``actual_path``.
    """

    def flat(rows: DataFrame, name: str) -> DataFrame:
        """One text for a path: its parts normalised, level by level."""
        keys = [c for c in rows.columns if c != "path"]
        levels = rows.select(*keys, F.col("path").alias(name), F.posexplode_outer("path").alias("_level", "_part"))
        return levels.groupBy(*keys, name).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_level", norm_text(F.coalesce("_part", F.lit(""))).alias("p")))), lambda x: x["p"]), "/").alias(f"_{name}"))

    sheets = actual.select("relative_path", "sheet", *template).distinct()
    wanted = sheets.join(flat(expected, "expected_path"), list(template))
    own = flat(actual, "actual_path")
    joined = wanted.join(own, ["relative_path", "sheet", *template, "coordinate"], "left")
    return joined.where(F.col("_actual_path").isNull() | (F.col("_actual_path") != F.col("_expected_path"))).select("relative_path", "sheet", "coordinate", "expected_path", "actual_path")


# What tells positions and departments apart.
SEVERAL = r"[、,;；/\n]"
UNIT_END = r"(?:公司|单位|本部)$"
GRADES = r"([一二三四五六七八九十百零〇两]+|\d+)级职员"
LEADERS = r"经理|主任|书记|处长|科长|部长|总监|总工"
ROLE_WORDS = r"(经办|审核|审批|复核)"
DENIED_DUTY = r"不(?:负|承担|负责|参与)|无需|无须|免于"
FUNCTIONS = ["资金", "预算", "核算", "税务", "薪酬", "培训", "车辆", "物资", "纪检", "法律", "科技", "设备"]
DEPARTMENT_FUNCTIONS = {"财务": "财务|财会|会计", "审计": "审计", "组织人事": "组织|人事|人力资源", "党建": "党建|党群", "纪检": "纪检|监察", "营销": "营销", "物资": "物资|采购", "建设": "建设|基建", "科技": "科技|研发"}
CHINESE_DIGITS = "一二三四五六七八九"
DEPARTMENT_WEIGHT, POSITION_WEIGHT = 0.3, 0.7


def _grade(text: Column) -> Column:
    digit = lambda c: F.instr(F.lit(CHINESE_DIGITS), c)
    tens, ones = F.regexp_extract(text, f"^([{CHINESE_DIGITS}]?)十([{CHINESE_DIGITS}]?)$", 1), F.regexp_extract(text, f"^([{CHINESE_DIGITS}]?)十([{CHINESE_DIGITS}]?)$", 2)
    compound = F.when(tens == "", 1).otherwise(digit(tens)) * 10 + F.when(ones == "", 0).otherwise(digit(ones))
    return F.when(text.rlike(r"^\d+$"), text.cast("bigint").cast("string")).when(text.rlike(f"^[{CHINESE_DIGITS}]?十[{CHINESE_DIGITS}]?$"), compound.cast("string")).when(text.rlike(f"^[{CHINESE_DIGITS}]$"), digit(text).cast("string")).otherwise(text)


def position_conflicts(a: Column, b: Column) -> Column:
    """Why two positions can't be one: array of reasons."""
    grades = lambda t: F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(GRADES), 1), _grade)))
    roles = lambda t: F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(ROLE_WORDS), 1)))
    fields = lambda t: F.filter(F.array(*(F.lit(x) for x in FUNCTIONS)), lambda x: F.contains(t, x))
    both = lambda f: (F.size(f(a)) > 0) & (F.size(f(b)) > 0)
    return F.array_compact(
        F.array(
            F.when(both(grades) & (grades(a) != grades(b)), "grade"),
            F.when(a.rlike(LEADERS) & b.rlike(LEADERS) & (a.contains("副") != b.contains("副")), "deputy"),
            F.when(both(roles) & (roles(a) != roles(b)), "role"),
            F.when(a.rlike(DENIED_DUTY) != b.rlike(DENIED_DUTY), "denial"),
            F.when(both(fields) & ~F.arrays_overlap(fields(a), fields(b)), "function"),
        )
    )


def department_conflict(a: Column, b: Column) -> Column:
    kinds = lambda t: F.array_compact(F.array(*(F.when(t.rlike(p), F.lit(k)) for k, p in DEPARTMENT_FUNCTIONS.items())))
    return (F.size(kinds(a)) > 0) & (F.size(kinds(b)) > 0) & ~F.arrays_overlap(kinds(a), kinds(b))


def responsibility_parts(text: Column, names: Column, generic: Sequence[str] = ()) -> Column:
    """struct(department, position, reason) of a normalised item unit - department - position; a reason says why it is not read."""
    parts = F.filter(F.split(text, "[-—－]"), lambda p: p != "")
    known = F.array_union(F.coalesce(names, F.array().cast("array<string>")), F.array(*(F.lit(g) for g in generic)).cast("array<string>"))
    owner, n = F.get(parts, F.lit(0)), F.size(parts)
    department, position = F.element_at(parts, -2), F.element_at(parts, -1)
    reason = (
        F.when(~n.isin(2, 3), "structure")
        .when((n == 2) & (F.array_contains(known, owner) | owner.rlike(UNIT_END)), "no_department")
        .when((n == 3) & ~F.array_contains(known, owner), "foreign_unit")
        .when(F.concat(F.get(parts, n - 2), F.get(parts, n - 1)).rlike(SEVERAL), "several")
    )
    return F.struct(F.when(reason.isNull(), F.try_element_at(parts, F.lit(-2))).alias("department"), F.when(reason.isNull(), F.try_element_at(parts, F.lit(-1))).alias("position"), reason.alias("reason"))


def structured_candidates(queries: DataFrame, candidates: DataFrame, scope: Sequence[str], names: Sequence[str] = (), generic: Sequence[str] = (), top: int = 3, least_department: float = 0.5, least_position: float = 0.65, margin: float = 0.04) -> DataFrame:
    """The candidates that a responsibility item may mean: (query, candidate, department_score, position_score, score, exact, rank, ambiguous), or a row of the query with a ``reason`` and nulls.

    ``queries``: query, text, department_vector, position_vector and the columns
    ``scope``; ``candidates``: candidate, department, position, their vectors
    (of length 1) and ``scope``.  Only candidates of the same scope are compared; what is structurally
    unclear, or conflicts in grade, rank, role, denial or function, is rejected before any score.
    A score is 0.3 of the department's and 0.7 of the position's likeness, equal texts count 1;
    both must reach their least.  Equal positions come first; the first is
    ambiguous if the next of its kind is within ``margin``.  Nothing is approved.
    """
    known = F.array(*(F.lit(n) for n in names)).cast("array<string>")
    asked = queries.withColumn("_q", responsibility_parts(norm_text(F.col("text")), known, generic))
    whole = [F.coalesce(F.col(c).cast("string"), F.lit("")) != "" for c in scope]
    placed = whole[0]
    for w in whole[1:]:
        placed = placed & w
    asked = asked.withColumn("_reason", F.when(~placed, "scope").otherwise(F.col("_q.reason")))
    own = candidates.withColumn("_d", norm_text(F.col("department"))).withColumn("_p", norm_text(F.col("position")))
    prefixed = responsibility_parts(F.concat_ws("-", "_d", "_p"), known)
    own = own.withColumn("_r", prefixed).withColumn("_d", F.when(F.col("_d").rlike("[-—－]"), F.when(F.col("_r.reason").isNull(), F.col("_r.department"))).otherwise(F.col("_d")))
    own = own.where(F.coalesce(F.col("_d") != "", F.lit(False)) & F.coalesce(F.col("_p") != "", F.lit(False)) & ~F.concat("_d", "_p").rlike(SEVERAL))
    right = own.select(*scope, "candidate", "_d", "_p", F.col("department_vector").alias("_dv"), F.col("position_vector").alias("_pv"))
    pairs = asked.where("_reason IS NULL").join(right, list(scope))
    pairs = pairs.where((F.size(position_conflicts(F.col("_q.position"), F.col("_p"))) == 0) & ~department_conflict(F.col("_q.department"), F.col("_d")))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)
    exact_d, exact_p = F.col("_q.department") == F.col("_d"), F.col("_q.position") == F.col("_p")
    pairs = pairs.withColumn("department_score", F.round(F.when(exact_d, 1.0).otherwise(dot("department_vector", "_dv")), 6)).withColumn("position_score", F.round(F.when(exact_p, 1.0).otherwise(dot("position_vector", "_pv")), 6)).withColumn("exact", exact_p)
    pairs = pairs.where((F.col("position_score") >= least_position) & (F.col("department_score") >= least_department))
    pairs = pairs.withColumn("score", F.round(DEPARTMENT_WEIGHT * F.col("department_score") + POSITION_WEIGHT * F.col("position_score"), 6))
    order = Window.partitionBy("query").orderBy(F.col("exact").desc(), F.col("score").desc(), "candidate")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).withColumn("_next", F.lead(F.struct("exact", "score")).over(order)).where(F.col("rank") <= top)
    near = (F.col("rank") == 1) & F.coalesce((F.col("_next.exact") == F.col("exact")) & (F.round(F.col("score") - F.col("_next.score"), 6) < margin), F.lit(False))
    shown = ["query", "candidate", "department_score", "position_score", "score", "exact", "rank"]
    found = ranked.select(*shown, near.alias("ambiguous"), F.lit(None).cast("string").alias("reason"))
    kinds = dict(found.dtypes)
    silent = asked.join(found.select("query").distinct(), "query", "left_anti").select("query", F.coalesce("_reason", F.lit("no_candidate")).alias("reason"))
    return found.unionByName(silent.select(*(F.col(c) if c in ("query", "reason") else F.lit(None).cast(kinds[c]).alias(c) for c in found.columns)))
