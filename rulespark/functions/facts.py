"""What cells say: applicability answers, responsibility clauses, carrier names, system owners.

All of them are expressions over normalised text (see ``keys.norm_text``), so
they stay in generated code and are computed once per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rulespark.functions.keys import contains_any

# The decision table of applicability answers, in order.
POSITIVE = r"^(?:适用|是)(?=$|[,:;。])"
NEGATIVE = r"^(?:不适用|否)(?=$|[,:;。]|因|本|县|无|暂|不)"
NEGATED_POSITIVE = r"(?:但|仍|也|同时|实际)(?:为|是)?适用"
UNCERTAIN = r"是否|待(?:确认|核实|定)|不确定|并非|不是不|不一定|可能|[?？]|(?:如|若).*(?:适用|执行)|但.*(?:开展|适用|执行)"

# Answers that only tell for units of a level, by the unit's full name, and headers of columns of levels.
COUNTY_UNIT, CITY_UNIT = r"^国网湖南省电力有限公司.{2,6}县供电分公司$", r"^国网湖南省电力有限公司.{2,6}供电分公司本部$"
CITY_RUN, NOT_FOR_COUNTIES = "市公司集中管控,县公司不适用", "此条不适用县、支公司"
LEVEL_HEADERS = ("适用层级", "适用主体")
CITY_AND_COUNTY, CITY_SEATS = "地市及区县", "地市本部、变电检修公司、输电检修公司、吉首支公司"

# Responsibility types by role, and the words that assume or deny one.
RESPONSIBILITY_TYPES = ("主体责任", "审核责任", "审批责任")
ASSUMES = r"负有?|承担|担负|具有|履行"
DENIES = r"(?:不|未|无需|无须|并非|不是|没有|免于)[^,;。]{0,6}(?:负|承担|担负|具有|履行)"

# Levels of a system, and the markers of its owner.
FIRST_LEVEL, SECOND_LEVEL, THIRD_LEVEL = "一级部署系统", "二级部署系统", "三级部署系统"
SUBORDINATE_MARKERS = ("市公司", "县公司", "供电公司", "供电分公司", "分公司", "子公司")
PROVINCE_NAMES = ("湖南", "省公司", "湖南电力", "湖南省", "湖南省级单位")
PROVINCE_MARKERS = ("国网湖南省电力有限公司", "湖南省电力公司", "湖南电力公司", "湖南省公司", "湖南电力")
HEADQUARTERS_MARKERS = ("总部", "国网总部", "国家电网总部", "国家电网有限公司总部")
HEADQUARTERS_NEGATIONS = ("非总部", "不属于总部", "不是总部")

# An answer taken at its first word; the grades of staff; how the name of a unit is shortened.
PLAIN_NO, PLAIN_YES = r"^(?:不适用|否)", r"^(?:适用|是)(?:$|[,:;。])"
GRADE_DIGITS = "一二三四五六七八九十"
GRADE = rf"([{GRADE_DIGITS}]|[1-9][0-9]*)级职员"
UNIT_PREFIX = r"^(?:国网湖南省电力有限公司|国网湖南)"
CENTRE = r"^(.+?中心)(?:\([^()]+\))?(?:本部)?$"
SUPPLY_UNIT = r"^(.+?)(县|市)?供电分公司(本部)?$"


def plain_answer(text: Column) -> Column:
    """The decision of an answer by its first word alone; null if it tells neither."""
    return F.when(text.rlike(PLAIN_NO), "not_applicable").when(text.rlike(PLAIN_YES), "applicable")


def _grade_number(grade: Column) -> Column:
    at = F.instr(F.lit(GRADE_DIGITS), grade)
    return F.when(grade != "", F.when(at > 0, at.cast("string")).otherwise(grade))


def bare_grade(position: Column) -> Column:
    """The number of a position that is a grade and nothing else, else null."""
    return _grade_number(F.regexp_extract(position, f"^{GRADE}$", 1))


def grade_of_title(position: Column) -> Column:
    """The number of the grade that a position carries in brackets at its end, else null."""
    return _grade_number(F.regexp_extract(position, rf"^[^()、,;/]+\({GRADE}\)$", 1))


def title_before_grade(position: Column) -> Column:
    return F.regexp_replace(position, rf"\({GRADE}\)$", "")


def unit_forms(name: Column) -> Column:
    """The names under which a unit goes, the longest first; two signs or fewer are no name."""
    short = F.regexp_replace(name, UNIT_PREFIX, "")
    place, level, seat = (F.regexp_extract(short, SUPPLY_UNIT, k) for k in (1, 2, 3))
    forms = [name, short, F.regexp_extract(short, CENTRE, 1), F.when(short.contains("有限公司"), F.regexp_replace(short, "^.*?有限公司", ""))]
    for town in (place, F.concat(place, level)):
        forms += [F.when(place != "", x) for x in (F.concat(town, F.lit("公司")), F.concat(town, F.lit("供电公司")), F.concat(F.lit("国网"), town, F.lit("供电公司")))]
    forms.append(F.when(seat != "", F.concat(place, seat)))
    sized = F.transform(F.array_distinct(F.array_compact(F.array(*forms))), lambda n: F.struct(F.length(n).alias("size"), n.alias("name")))
    return F.transform(F.reverse(F.array_sort(F.filter(sized, lambda x: x["size"] >= 3))), lambda x: x["name"])


def without_unit(department: Column, unit: Column) -> Column:
    """A department without the longest name of its unit before it."""
    fits = F.filter(unit_forms(unit), lambda n: F.startswith(department, n) & (F.length(department) > F.length(n)))
    rest = F.regexp_replace(F.substr(department, F.length(F.get(fits, F.lit(0))) + 1), "^[-—:：]+", "")
    return F.when(F.size(fits) > 0, rest).otherwise(department)


def applicability(text: Column) -> Column:
    """struct(state, decision, reason) of an answer; a null text is a missing source."""
    t = F.regexp_replace(F.regexp_replace(text, r"^[。;]+", ""), r"[。;]+$", "")
    positive, negative = t.rlike(POSITIVE), t.rlike(NEGATIVE)
    state = (
        F.when(text.isNull(), "source_missing")
        .when(t == "", "empty")
        .when((positive & t.contains("不适用")) | (negative & t.rlike(NEGATED_POSITIVE)), "conflict")
        .when(t.rlike(UNCERTAIN), "unknown")
        .when(negative, "explicit_negative")
        .when(positive, "explicit_positive")
        .otherwise("unknown")
    )
    decision = F.when(state == "explicit_positive", "applicable").when(state == "explicit_negative", "not_applicable")
    reason = F.when(state == "explicit_negative", F.regexp_replace(F.regexp_replace(t, NEGATIVE, ""), r"^[ ,;:。/\-—]+|[ ,;:。/\-—]+$", ""))
    return F.struct(state.alias("state"), decision.alias("decision"), reason.alias("reason"))


def applicability_of(text: Column, unit: Column, header: Column) -> Column:
    """``applicability`` of an answer, or what it says for a unit of this level, by the unit's full name and the column's header; both may be null."""
    plain = applicability(text)
    t = F.regexp_replace(F.regexp_replace(text, r"^[。;]+", ""), r"[。;]+$", "")
    county, city = F.coalesce(unit.rlike(COUNTY_UNIT), F.lit(False)), F.coalesce(unit.rlike(CITY_UNIT), F.lit(False))
    levels = F.coalesce(header.isin(*LEVEL_HEADERS), F.lit(False))
    told = lambda state, decision, reason: F.struct(F.lit(state).alias("state"), F.lit(decision).alias("decision"), reason.cast("string").alias("reason"))
    open_answer = plain["decision"].isNull() & text.isNotNull()
    return (
        F.when(open_answer & county & (t == CITY_RUN), told("explicit_negative", "not_applicable", F.lit("市公司集中管控")))
        .when(open_answer & county & (t == NOT_FOR_COUNTIES), told("explicit_negative", "not_applicable", t))
        .when(open_answer & levels & (((county | city) & (t == CITY_AND_COUNTY)) | (city & (t == CITY_SEATS))), told("explicit_positive", "applicable", F.lit(None)))
        .otherwise(plain)
    )


def clauses(text: Column) -> Column:
    return F.filter(F.split(text, r"[,，;；。!！]"), lambda c: c != "")


def assumed_types(text: Column) -> Column:
    """The responsibility types that some clause assumes without denying it."""
    kinds = F.array(*(F.lit(t) for t in RESPONSIBILITY_TYPES))
    good = F.filter(clauses(text), lambda c: c.rlike(ASSUMES) & ~c.rlike(DENIES))
    return F.filter(kinds, lambda k: F.exists(good, lambda c: F.contains(c, k)))


def denied_types(text: Column) -> Column:
    """The responsibility types that some clause denies."""
    kinds = F.array(*(F.lit(t) for t in RESPONSIBILITY_TYPES))
    bad = F.filter(clauses(text), lambda c: c.rlike(DENIES))
    return F.filter(kinds, lambda k: F.exists(bad, lambda c: F.contains(c, k)))


def list_items(text: Column) -> Column:
    """The items of a list cell: parted at list separators and line ends outside brackets."""
    parts = F.split(text, r"[、,;；\n](?![^（(【《\[]*[)）】》\]])")
    return F.array_distinct(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != ""))


def carrier_names(text: Column) -> Column:
    """The carriers that a list cell names, quotation marks taken off."""
    return F.array_distinct(F.transform(list_items(text), lambda p: F.regexp_replace(p, r"^《|》$", "")))


def quoted_names(text: Column) -> Column:
    """The names in book-title marks of a running text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("《([^《》]+)》"), 1))


def duty_key(text: Column) -> Column:
    """A duty for comparison: one fixed equivalence, one verb for assuming, one connector between listed nouns."""
    text = F.regexp_replace(text, "系统变更审批轨迹", "系统审批轨迹")
    text = F.regexp_replace(text, r"(?:负有?|承担|担负|具有)(?=(?:主体|审核|审批|复核)责任)", "负")
    return F.regexp_replace(text, r"(?<=[表单册书据录迹件项款息])(?:以及|与|和|及)(?=[^,，。;；!?！？]{1,40}(?:表|单|册|书|据|录|迹|件|项|款|息))", "、")


def duty_signature(text: Column) -> Column:
    """A duty without its handling or reviewing responsibility, by which two roles of one duty meet."""
    return F.regexp_replace(duty_key(text), r"(?:主体|审核)(?=责任)", "")


def system_level(owner: Column) -> Column:
    """The level of a system by its owner, null where the owner does not tell."""

    def has(markers: tuple[str, ...]) -> Column:
        return contains_any(owner, list(markers))

    province = owner.isin(list(PROVINCE_NAMES)) | has(PROVINCE_MARKERS)
    headquarters = ~has(HEADQUARTERS_NEGATIONS) & has(HEADQUARTERS_MARKERS)
    return F.when((owner == "") | has(SUBORDINATE_MARKERS), None).when(province, SECOND_LEVEL).when(headquarters, FIRST_LEVEL)
