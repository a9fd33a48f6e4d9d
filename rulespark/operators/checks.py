"""The checks: each takes a context, the rows in scope and parameters, and returns issues.

A check is a plan.  Rows meet only rows of the same entity, business and
variant; nothing is collected.  ``CHECKS`` maps (name, version) to the check;
earlier versions of a name stand for the latest one unless listed apart.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulespark.functions import carriers, duties, facts
from rulespark.functions.items import NUMBERED, numbered_items
from rulespark.functions.keys import contains_any, norm_literal, norm_text, strip_blanks, terms_in
from rulespark.operators.relational import any_of, holding
from rulespark.plans.records import PLACE, SCOPE, Context, issues, scope_known, wide, with_key
from rulespark.sources.stored import judged_once, spread, stored

Check = Callable[[Context, DataFrame, dict[str, Any]], DataFrame]
CHECKS: dict[tuple[str, int], Check] = {}

ROLES = {"经办": "主体责任", "审核": "审核责任", "审批": "审批责任"}
EMPTY_WORDS = ("", "无", "不涉及")


def check(name: str, *versions: int) -> Callable[[Check], Check]:
    def keep(f: Check) -> Check:
        for v in versions:
            CHECKS[name, v] = f
        return f

    return keep


def readable(name: str) -> Column:
    return F.col(f"{name}_state").isin("empty", "value")


def literals(values: list[str]) -> list[str]:
    return [norm_literal(v) for v in values]


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def has_detail(fields: Column) -> Column:
    """Whether a row of an incompatible list says anything: an unreadable cell counts as something."""
    cells = F.map_entries(F.map_filter(fields, lambda k, _: ~k.isin("sequence", "row_number")))
    return F.exists(cells, lambda e: (F.coalesce(e["value"]["state"], F.lit("")) == "formula_no_cache") | ~strip_blanks(F.coalesce(e["value"]["current"], F.lit(""))).isin(*EMPTY_WORDS))


def unavailable(rows: DataFrame, name: str) -> DataFrame:
    return rows.where(~readable(name)).withColumn("_absent", F.col(f"{name}_state") == "absent")


@check("required_fields", 1)
def required_fields(ctx: Context, rows: DataFrame, p: dict[str, Any]) -> DataFrame:
    fields, when = list(p["fields"]), p.get("when") or {}
    own = wide(rows, sorted({*fields, *([when["field"]] if when else [])}))
    if when:
        own = own.where(F.coalesce(F.col(when["field"]), F.lit("")).isin(literals(when.get("in", []))))
    placeholders = literals(p.get("placeholders", ["无", "待定", "-"]))
    out = []
    for f in fields:
        bad = F.when(F.col(f) == "", "未填写").when(F.col(f).isin(placeholders), "内容不具体")
        out.append(issues(unavailable(own, f), "review", "field_unavailable", f))
        out.append(issues(own.where(readable(f)).withColumn("_why", bad).where("_why IS NOT NULL"), "violation", "field_missing", f, ["reason"], reason=F.col("_why")))
    return union(out)


def _field_constraints(exceptions: bool, third_position: bool) -> Check:
    def run(ctx: Context, rows: DataFrame, p: dict[str, Any]) -> DataFrame:
        asked = p["field"]
        names = [asked]
        if asked == "position":
            names += ["position_a", "position_b", "position_name"] + (["position_c"] if third_position else [])
        listed = F.col("record_type") == "incompatible_position"
        own = wide(rows.where(~listed | has_detail(F.col("fields"))), names)
        generic = literals(p.get("placeholders", []))
        # Departments that name no department.
        vague = ["项目管理部门", "资产使用保管部门", "管理部门", "相关部门", "有关部门"] if asked == "department" else []
        out = []
        for f in names:
            some = own
            if f != asked or asked.startswith("position"):
                # An incompatible list is checked on the position columns it has; other lists on the asked one.
                present = F.col(f"{f}_state") != "absent"
                some = own.where(F.when(listed, present).otherwise(F.lit(f == asked)))
            tail = F.try_element_at(F.filter(F.split(F.col(f), r"[-—－]"), lambda x: x != ""), F.lit(-1))
            tested = F.coalesce(tail, F.lit("")) if asked == "department" else F.col(f)
            some = some.withColumn("_tested", tested)
            excused = F.lit(False)
            if exceptions:
                excused = F.col(f).isin(literals(p.get("exact_exceptions", []))) | any_of([F.col(f).startswith(x) for x in literals(p.get("prefix_exceptions", []))]) | contains_any(F.col(f), literals(p.get("contains_exceptions", [])))
            not_concrete = F.col("_tested").isin(generic + vague) | (F.col("_tested") == "") | any_of([F.col("_tested").rlike(x) for x in p.get("placeholder_patterns", [])])
            problems = F.array_compact(F.array(F.when(not_concrete & ~excused, "field_not_concrete"), F.when(contains_any(F.col("_tested"), literals(p.get("separators", []))), "field_not_split")))
            out.append(issues(unavailable(some, f), "review", "field_unavailable", f))
            out.append(issues(some.where(readable(f)).withColumn("_problem", F.explode(problems)), "violation", F.col("_problem"), f, actual_text=F.col(f)))
        return union(out)

    return run


for _v in (1, 2, 3):
    CHECKS["field_constraints", _v] = _field_constraints(False, False)
CHECKS["field_constraints", 4] = _field_constraints(False, True)
CHECKS["field_constraints", 5] = CHECKS["field_constraints", 6] = _field_constraints(True, True)


@check("text_pattern", 1)
def text_pattern(ctx: Context, rows: DataFrame, p: dict[str, Any]) -> DataFrame:
    f = p["field"]
    bad = wide(rows, [f]).where((F.col(f) != "") & ~any_of([F.col(f).rlike(x) for x in p["patterns"]]))
    return issues(bad, "violation", "pattern_missing", f, text=F.substring(f, 1, 200))


@check("forbidden_reference", 1)
def forbidden_reference(ctx: Context, rows: DataFrame, p: dict[str, Any]) -> DataFrame:
    own = wide(rows, sorted({*p["fields"], "measure_id", "key_control_point"}))
    target = norm_literal(p.get("measure_contains", ""))
    if target:
        own = own.where(F.concat(F.coalesce("measure_id", F.lit("")), F.coalesce("key_control_point", F.lit(""))).contains(target))
    text = F.concat(*(F.coalesce(F.col(f), F.lit("")) for f in p["fields"]))
    own = own.withColumn("_terms", terms_in(text, literals(p["terms"]))).where(F.size("_terms") > 0)
    soft = contains_any(text, literals(p.get("negation_markers", ["删除", "不使用", "停用", "示例"])))
    return issues(own, F.when(soft, "review").otherwise("violation"), "forbidden_reference", None, matched_text=F.substring(text, 1, 200), forbidden_terms=F.col("_terms"))


@check("text_duplicates", 1)
def text_duplicates(ctx: Context, rows: DataFrame, p: dict[str, Any]) -> DataFrame:
    return records_unique(ctx, rows, {"key_fields": [p["field"]]})


@check("records_unique", 1)
def records_unique(ctx: Context, rows: DataFrame, p: dict[str, Any]) -> DataFrame:
    """Second and later rows of a key; the first in the order of place is the reference."""
    names = [f for f in p["key_fields"] if f not in (*SCOPE, "person_keys")]
    own = with_key(wide(rows, sorted({*names, "measure_id"}), ("person_keys",)))
    people = F.array_sort(F.transform("person_keys", lambda x: strip_blanks(F.coalesce(F.when(x["person_id"] != "", x["person_id"]), x["name"], F.lit("")))))
    unsure = F.exists("person_keys", lambda x: F.coalesce(x["person_id"], F.lit("")) == "")
    keys = [F.coalesce(F.col("key").cast("string"), F.col(f)) if f == "measure_id" else people if f == "person_keys" else F.coalesce(F.col(f), F.lit("")) for f in p["key_fields"]]
    w = Window.partitionBy(*keys).orderBy(*PLACE)
    own = own.withColumn("_n", F.row_number().over(w)).withColumn("_first", F.first(F.concat_ws("!", "sheet", F.col("row").cast("string"))).over(w))
    kind = F.lit("violation")
    if "person_keys" in p["key_fields"]:
        own = own.withColumn("_first_unsure", F.first(unsure).over(w))
        kind = F.when(F.coalesce(unsure | F.col("_first_unsure"), F.lit(False)), "review").otherwise("violation")
    return issues(own.where("_n > 1"), kind, "record_repeated", None, duplicate_locations=F.col("_first"))


DUTY_FIELDS = ["measure_id", "duty", "department", "position", "person_names", "role"]


def _duplicate_duties(same_sheet: bool) -> Check:
    def run(ctx: Context, rows: DataFrame, p: dict[str, Any]) -> DataFrame:
        own = with_key(wide(rows, DUTY_FIELDS)).where(scope_known())
        for f in DUTY_FIELDS:
            own = own.where(F.col(f) != "")
        number = F.coalesce(F.col("key").cast("string"), F.col("measure_id"))
        digest = F.xxhash64(number, facts.duty_key(F.col("duty")), "department", "position", "person_names", "role")
        keys = [*SCOPE, *(["file_path", "sheet"] if same_sheet else []), digest, facts.duty_key(F.col("duty")), number, "department", "position", "person_names", "role"]
        w = Window.partitionBy(*keys)
        order = w.orderBy(*PLACE)
        place = F.struct(*PLACE)
        # The neighbours in the order of place are named; a group of any size stays one row each.
        other = F.coalesce(F.lag(place).over(order), F.lead(place).over(order))
        own = own.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_other", other).where("_n > 1")
        return issues(own, "violation", "duplicate_duty", None, repeats=F.col("_n"), duplicate_location=F.col("_other"))

    return run


CHECKS["duplicate_duties", 1] = _duplicate_duties(False)
CHECKS["duplicate_duties", 2] = _duplicate_duties(True)


def _duty_presence(ctx: Context, rows: DataFrame, fields: list[str]) -> DataFrame:
    """Matrix rows with a readable measure number, with ``exists``: whether a duty row of the scope has it."""
    duties = with_key(wide(ctx.of_type("position_duty"), ["measure_id"])).where(scope_known() & F.col("key").isNotNull())
    have = duties.select(*SCOPE, "key").distinct().withColumn("exists", F.lit(True))
    own = with_key(wide(rows, fields)).where(scope_known() & (F.col("measure_id") != ""))
    return own.join(have, [*SCOPE, "key"], "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


@check("missing_duty_measures", 1)
def missing_duty_measures(ctx: Context, rows: DataFrame, p: dict[str, Any]) -> DataFrame:
    own = _duty_presence(ctx, rows, ["measure_id"]).where("NOT exists").join(ctx.submitted("position_duty"), SCOPE, "left_semi")
    return issues(own, "review", "missing_duty_measure", None, ["measure_id"], measure_id=F.col("measure_id"))


def _alignment(version: int) -> Check:
    def run(ctx: Context, rows: DataFrame, p: dict[str, Any]) -> DataFrame:
        own = _duty_presence(ctx, rows, ["measure_id", "applicability"])
        if version == 1:
            own = own.join(ctx.submitted("position_duty"), SCOPE, "left_semi")
        own = answered(ctx, own.where(readable("applicability")))
        state, decision = F.col("_a.state"), F.coalesce(F.col("_a.decision"), F.lit(""))
        present = decision != "applicable"
        absent = (decision != "not_applicable") if version == 1 else (decision == "applicable")
        if version == 3:
            present = present & (state != "empty")
        own = own.where(F.when(F.col("exists"), present).otherwise(absent))
        return issues(own, "review", "measure_applicability_mismatch", None, ["measure_id"], measure_id=F.col("measure_id"), measure_present=F.col("exists"), applicability_state=state, applicability_decision=F.col("_a.decision"))

    return run


for _v in (1, 2, 3):
    CHECKS["measure_applicability_alignment", _v] = _alignment(_v)


def _reference_exists(with_applicability: bool) -> Check:
    def run(ctx: Context, rows: DataFrame, p: dict[str, Any]) -> DataFrame:
        source, target = p["source_field"], p["target_field"]
        listed = F.col("record_type") == "incompatible_position"
        own = with_key(wide(rows.where(~listed | has_detail(F.col("fields"))), [source]), source)
        unknown = own.where(~scope_known())
        own = own.where(scope_known()).join(ctx.submitted(p["target_record_type"]), SCOPE, "left_semi")
        targets = with_key(wide(ctx.of_type(p["target_record_type"]), sorted({target, "applicability"})), target)
        targets = answered(ctx, targets).withColumn("_state", F.when(F.col("applicability_state") == "unreadable", "source_unavailable").otherwise(F.col("_a.state")))
        number = F.coalesce(F.col("key").cast("string"), F.col(target))
        known = (
            targets.where(F.col(target) != "")
            .groupBy(*SCOPE, number.alias("_number"))
            .agg(
                F.bool_and(F.coalesce(F.col("_a.decision") == "applicable", F.lit(False))).alias("_all"),
                F.bool_and(F.coalesce(F.col("_a.decision") == "not_applicable", F.lit(False))).alias("_none"),
                F.bool_or(F.col("_state").isin("source_missing", "source_unavailable")).alias("_unread"),
            )
        )
        gaps = targets.groupBy(*SCOPE).agg(F.bool_or(~readable(target)).alias("_gap"))
        named = own.where(readable(source) & (F.col(source) != "")).withColumn("_number", F.coalesce(F.col("key").cast("string"), F.col(source)))
        joined = named.join(known, [*SCOPE, "_number"], "left").join(gaps, SCOPE, "left")
        lost = joined.where("_all IS NULL").withColumn("_open", F.coalesce("_gap", F.lit(True)))
        out = [
            issues(unknown, "review", "reference_field_unavailable", source),
            issues(unavailable(own, source), "review", "reference_field_unavailable", source),
            issues(own.where(F.col(source) == ""), "violation", "reference_missing", source),
            issues(lost, F.when(F.col("_open"), "review").otherwise("violation"), F.when(F.col("_open"), "reference_matrix_unavailable").otherwise("reference_not_found"), source, ["reference"], reference=F.col(source)),
        ]
        if with_applicability:
            met = joined.where("_all IS NOT NULL AND (_unread OR NOT _all)")
            what = F.when(F.col("_unread"), "reference_applicability_unavailable").when(F.col("_none"), "reference_not_applicable").otherwise("reference_applicability_unresolved")
            out.append(issues(met, F.when(~F.col("_unread") & F.col("_none"), "violation").otherwise("review"), what, source, ["reference"], reference=F.col(source)))
        return union(out)

    return run


CHECKS["reference_exists", 1] = _reference_exists(False)
CHECKS["reference_exists", 2] = _reference_exists(True)


def unit_names(ctx: Context) -> DataFrame:
    """(entity_code, _unit): the roster, one row a unit."""
    return ctx.entities.groupBy("entity_code").agg(F.min("name").alias("_unit")).withColumn("_unit", norm_text(F.col("_unit")))


def answered(ctx: Context, rows: DataFrame, name: str = "_a") -> DataFrame:
    """``rows`` with what their applicability says for their unit, under the header it was read from."""
    out = rows.join(unit_names(ctx), "entity_code", "left")
    if ctx.answer_headers is None:
        out = out.withColumn("_header", F.lit(None).cast("string"))
    else:
        out = out.join(ctx.answer_headers.groupBy("file_path", "sheet").agg(F.min("header").alias("_header")).withColumn("_header", norm_text(F.col("_header"))), ["file_path", "sheet"], "left")
    return out.withColumn(name, facts.applicability_of(F.col("applicability"), F.col("_unit"), F.col("_header"))).drop("_unit", "_header")


def _explicit_role() -> Column:
    inferred = F.filter(F.array(*(F.lit(t) for t in ROLES.values())), lambda t: F.contains(F.col("duty"), t))
    by_type = F.create_map(*(F.lit(x) for role, t in ROLES.items() for x in (t, role)))
    return F.when(F.coalesce("role", F.lit("")) != "", F.col("role")).when(F.size(inferred) == 1, F.element_at(by_type, F.get(inferred, F.lit(0))))


@check("roles_disjoint", 1)
def roles_disjoint(ctx: Context, rows: DataFrame, p: dict[str, Any]) -> DataFrame:
    """People that hold both roles of a pair in a group; by (group, person), so that no set grows with a group."""
    names = sorted({f for f in p["group_by"] if f not in SCOPE} | {"measure_id", "duty", "role"})
    own = with_key(wide(rows, names, ("person_keys",))).withColumn("_role", _explicit_role())
    group = [F.coalesce(F.col("key").cast("string"), F.col("measure_id"), F.lit("")).alias("_g_measure_id") if f == "measure_id" else F.coalesce(F.col(f), F.lit("")).alias(f"_g_{f}") for f in p["group_by"]]
    named = [f"_g_{f}" for f in p["group_by"]]
    own = own.select("*", *group)
    out = [issues(own.where("_role IS NULL"), "review", "role_unresolved", "role")]
    person = F.explode("person_keys").alias("_p")
    who = F.coalesce(F.when(F.col("_p.person_id") != "", F.col("_p.person_id")), F.col("_p.name"))
    seen = own.where("_role IS NOT NULL").select("*", person).withColumn("_who", strip_blanks(who)).withColumn("_sure", F.coalesce(F.col("_p.person_id"), F.lit("")) != "").where("_who != ''")
    for left, right in p["role_pairs"]:
        both = seen.groupBy(*named, "_who").agg(F.bool_or(F.col("_role") == left).alias("_l"), F.bool_or(F.col("_role") == right).alias("_r"), F.bool_and("_sure").alias("_all_sure")).where("_l AND _r")
        hit = seen.where(F.col("_role").isin(left, right)).join(both.select(*named, "_who", "_all_sure"), [*named, "_who"])
        out.append(issues(hit, F.when(F.col("_all_sure"), "violation").otherwise("review"), "role_overlap", "person_names", ["conflict_people"], conflict_people=F.col("_who"), roles=F.lit(f"{left}/{right}")))
    return union(out)


def _same_duty(whole_cells: bool, by_text: bool) -> Check:
    def run(ctx: Context, rows: DataFrame, p: dict[str, Any]) -> DataFrame:
        own = with_key(wide(rows, ["measure_id", "duty", "role", "department", "person_names", "control_measure"], ("person_keys",)))
        out = [
            issues(unavailable(own, "role"), "review", "separation_field_unavailable", "role"),
            issues(own.where(F.col("role") == ""), "violation", "explicit_role_missing", "role"),
            issues(own.where((F.col("role") != "") & ~F.col("role").isin(list(ROLES))), "violation", "invalid_role", "role", actual_text=F.col("role")),
        ]
        if by_text:
            # Without a stated role, the one type that the duty assumes beyond doubt.
            own = duties.with_facts(own, "duty", [], 3)
            known = F.array_intersect(duties.assumed(F.col("_facts"), True), F.array(*(F.lit(t) for t in ROLES.values())))
            kinds = F.when(~duties.contradicts_itself(F.col("_facts")) & ~duties.unresolved(F.col("_facts")), known)
        else:
            kinds = facts.assumed_types(F.coalesce("duty", F.lit("")))
        by_type = F.create_map(*(F.lit(x) for role, t in ROLES.items() for x in (t, role)))
        own = own.withColumn("_role", F.when(F.col("role").isin(list(ROLES)), F.col("role")).when((F.coalesce("role", F.lit("")) == "") & (F.size(kinds) == 1), F.element_at(by_type, F.get(kinds, F.lit(0)))))
        own = own.where("_role IS NOT NULL").drop("_facts")
        placeless = own.where(~scope_known())
        out.append(issues(placeless, "review", "separation_scope_missing", "measure_id"))
        own = own.where(scope_known())
        key = F.col("key").cast("string")
        if by_text:
            # Without a number the full text of the measure decides, where it belongs to one number only.
            usable = (F.coalesce("control_measure", F.lit("")) != "") & ~F.col("control_measure").isin("无", "不涉及", "-", "/")
            texts = with_key(wide(ctx.records.where(F.col("record_type").isin("matrix", "position_duty")), ["measure_id", "control_measure"])).where("key IS NOT NULL AND control_measure != ''")
            one = texts.groupBy(*SCOPE, "control_measure").agg(F.min("key").alias("_low"), F.max("key").alias("_high"))
            own = own.join(one, [*SCOPE, "control_measure"], "left")
            key = F.coalesce(key, F.when(usable & (F.col("_low") == F.col("_high")), F.col("_low").cast("string")), F.when(usable & F.col("_low").isNull(), F.concat(F.lit("content:"), "control_measure")))
        own = own.withColumn("_measure", key)
        out.append(issues(own.where("_measure IS NULL"), "review", "separation_correspondence_unresolved", "measure_id"))
        own = own.where("_measure IS NOT NULL").withColumn("_signature", facts.duty_signature(F.coalesce("duty", F.lit(""))))
        person = F.explode_outer(F.filter("person_keys", lambda x: (F.coalesce(x["name"], F.lit("")) != "") & ~x["name"].isin("/", "-", "无") & ~x["name"].rlike(r"等|…|\.{3}|待定"))).alias("_p")
        seen = own.select("*", person)
        out.append(issues(seen.where("_p IS NULL").withColumn("_absent", F.col("person_names_state") == "absent"), "review", F.when(F.col("person_names_state") == "absent", "separation_field_unavailable").otherwise("person_missing"), "person_names"))
        seen = seen.where("_p IS NOT NULL").withColumn("_who", strip_blanks(F.col("_p.name")))
        keys = [*SCOPE, "_measure", "_signature", "_who"]
        left = seen.where("_role = '经办'")
        right = seen.where("_role = '审核'").select(*keys, *(F.col(c).alias(f"_o_{c}") for c in [*PLACE, "department", "person_names"]), F.col("_p.person_id").alias("_o_id"))
        pairs = left.join(right, keys).where("coalesce(_p.person_id, '') = '' OR coalesce(_o_id, '') = '' OR _p.person_id = _o_id")
        if whole_cells:
            gone = any_of([F.coalesce(F.col(c), F.lit("")) == "" for c in ("department", "_o_department", "person_names", "_o_person_names")])
            out.append(issues(pairs.where(gone), "review", "separation_field_unavailable", "department"))
            pairs = pairs.where(~gone & (F.col("department") == F.col("_o_department")) & (F.col("person_names") == F.col("_o_person_names")))
        related = {"related_file": F.col("_o_file_path"), "related_sheet": F.col("_o_sheet"), "related_row": F.col("_o_row"), "conflict_people": F.col("_who")}
        out.append(issues(pairs, "violation", "same_duty_person_overlap", "person_names", list(related), **related))
        return union(out)

    return run


CHECKS["roles_same_duty", 1] = CHECKS["roles_same_duty", 2] = _same_duty(False, False)
CHECKS["roles_same_duty", 3] = _same_duty(False, True)
CHECKS["roles_same_duty", 4] = _same_duty(True, True)


def _words_found(ctx: Context, own: DataFrame, text: str, words: list[str]) -> DataFrame:
    """``own`` with ``_words``: the words that stand in the text, whatever their number."""
    if not words:
        return own.withColumn("_words", F.array().cast("array<string>"))
    found = holding(own.select("record_id", text), text, ctx.spark.createDataFrame([(w,) for w in words], "_word string"), "_word")
    return own.join(found.groupBy("record_id").agg(F.collect_set("_word").alias("_words")), "record_id", "left")


def _set_subset(version: int) -> Check:
    """Carriers that a row names beyond those of its measure.

    1 reads the carrier column or else the running text, the others both, each
    reported by its source; the versions read running text by the grammar of
    their number (see ``carriers``), and from 3 on carriers have short names.
    """

    def run(ctx: Context, rows: DataFrame, p: dict[str, Any]) -> DataFrame:
        source, target, body = p["source_field"], p["target_field"], p.get("fallback_explicit_field")
        aliases = {norm_literal(k): norm_literal(v) for k, v in (p.get("aliases") or {}).items()}
        named = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv)) if aliases else None

        def canonical(x: Column) -> Column:
            return F.coalesce(F.element_at(named, x), x) if aliases else x

        def measure(rows: DataFrame) -> DataFrame:
            return with_key(rows).withColumn("_k", F.coalesce(F.col("key").cast("string"), F.concat(F.lit("text:"), "measure_id")))

        own = stored(wide(lines_as_items(rows, source), sorted({source, "measure_id", *([body] if body else [])})))
        numberless = ~readable("measure_id") | (F.col("measure_id") == "")
        known = measure(own.where(scope_known() & ~numberless))
        targets = measure(wide(lines_as_items(ctx.of_type(p.get("target_record_type", "matrix")), target), sorted({target, "measure_id"})).where(readable("measure_id")))
        listed = F.array_sort(F.array_distinct(F.transform(facts.carrier_names(F.coalesce(F.col(target), F.lit(""))), canonical)))
        allowed = targets.withColumn("_set", listed).groupBy(*SCOPE, "_k").agg(F.min("_set").alias("_low"), F.max("_set").alias("_high"), F.bool_or(~readable(target)).alias("_gone"))
        joined = stored(known.join(allowed, [*SCOPE, "_k"], "left"))
        usable = joined.where("NOT _gone AND _low = _high")
        short = carriers.local_aliases(F.col("_low"), version) if version >= 3 else F.array().cast(carriers.KNOWN)

        def judge_cell(said: DataFrame) -> DataFrame:
            named = lambda x: F.coalesce(F.get(F.filter("_short", lambda s: s["term"] == x), F.lit(0))["name"], canonical(x))
            missing = F.array_except(F.transform(facts.carrier_names(F.col(source)), named), "_low")
            return duties.once(said, _short=short).select(source, "_low", missing.alias("_missing"))

        cells = judged_once(usable.where(F.coalesce(F.col(source), F.lit("")) != ""), [source, "_low"], judge_cell)
        beyond = {"source_kind": F.col("_kind"), "missing_references": F.col("_missing")}
        out = [
            issues(own.where(~scope_known()), "review", "carrier_scope_unconfirmed"),
            issues(own.where(scope_known() & numberless), "review", "carrier_measure_id_missing", "measure_id"),
            issues(joined.where("_low IS NULL OR (NOT _gone AND _low != _high)"), "review", "matrix_ambiguous", "measure_id"),
            issues(joined.where("_gone"), "review", "carrier_target_unavailable", "measure_id"),
            issues(cells.where("size(_missing) > 0").withColumn("_kind", F.lit("carrier_field")), "review", "carrier_reference_unmatched", source, ["source_kind"], **beyond),
        ]
        if version >= 2:
            out.append(issues(usable.where(F.col(f"{source}_state") == "unreadable"), "review", "carrier_source_unavailable", source))
        if body:
            if version >= 2:
                out.append(issues(usable.where(F.coalesce(F.col(body), F.lit("")) == ""), "review", "carrier_source_unavailable", body))
            texts = usable.where(F.coalesce(F.col(body), F.lit("")) != "")
            texts = texts if version >= 2 else texts.where(F.coalesce(F.col(source), F.lit("")) == "")
            texts = _words_found(ctx, texts, body, literals(p.get("terminology") or []))
            said = judged_once(texts, [body, "_low", "_words"], lambda t: carriers.with_references(t, body, "_low", version, aliases, "_words").where("_refs.status = 'unavailable' OR size(_refs.unresolved) > 0"))
            said = said.withColumn("_kind", F.lit("duty_text")).withColumn("_missing", F.col("_refs.unresolved"))
            out.append(issues(said.where("_refs.status = 'unavailable'"), "review", "carrier_parse_unavailable", body, fragments=F.col("_refs.unavailable")))
            out.append(issues(said.where("size(_missing) > 0"), "review", "carrier_reference_unmatched", body, ["source_kind"], **beyond))
        return union(out)

    return run


for _v in range(1, 6):
    CHECKS["set_subset", _v] = _set_subset(_v)


def _first_of_sheet(rows: DataFrame) -> DataFrame:
    place = Window.partitionBy("file_path", "sheet").orderBy("row", "record_id")
    return rows.withColumn("_place", F.row_number().over(place)).where("_place = 1").drop("_place")


def _struck(field: Column, items: bool) -> Column:
    """What a cell strikes out: array<struct<text, said, whole>>, each span and, with ``items``, each numbered entry of the whole cell within a span."""
    spans = F.coalesce(field["deleted_spans"], F.array())
    found = F.transform(spans, lambda s: F.struct(strip_blanks(s["text"]).alias("text"), s["text"].alias("said"), F.lit(True).alias("whole")))
    if items:
        inside = F.filter(numbered_items(F.coalesce(field["raw"], F.lit(""))), lambda i: F.exists(spans, lambda s: (s["start"] <= i["start"]) & (i["end"] <= s["end"])))
        found = F.concat(found, F.transform(inside, lambda i: F.struct(strip_blanks(i["text"]).alias("text"), i["text"].alias("said"), F.lit(False).alias("whole"))))
    return found


def _deleted_text(version: int) -> Check:
    """Struck-out text of the matrix that a row still uses.

    1 looks for the struck spans; 2 also for numbered entries that are struck
    as a whole, and lets stand what every current row of the measure retains
    (what only some retain is a review); 3 looks at rows of a known measure
    only, within their measure.
    """

    def run(ctx: Context, rows: DataFrame, p: dict[str, Any]) -> DataFrame:
        target, fields = p["target_field"], list(p["source_fields"])
        by_measure = version == 3 or p.get("match_scope", "measure") == "measure"
        group = [*SCOPE, "_k"] if by_measure else SCOPE

        def keyed(rows: DataFrame) -> DataFrame:
            return with_key(rows).withColumn("_k", F.when(F.coalesce("measure_id", F.lit("")) != "", F.coalesce(F.col("key").cast("string"), F.concat(F.lit("text:"), "measure_id"))))

        def cell(name: str) -> Column:
            return F.element_at("fields", name)

        own = keyed(wide(rows, sorted({"measure_id", target}), ("fields",)))
        gone = cell(target)["formula"].isNotNull() & (F.size(F.coalesce(cell(target)["deleted_spans"], F.array())) > 0)
        own = stored(own.withColumn("_target", F.when(gone, "").otherwise(strip_blanks(F.coalesce(cell(target)["current"], F.lit(""))))).drop("fields"))
        if version == 3:
            own = own.where("_k IS NOT NULL")
        out = [issues(_first_of_sheet(own.where(~scope_known())), "review", "deletion_scope_unknown")]
        own = own.where(scope_known())
        if by_measure and version < 3:
            out.append(issues(own.where("_k IS NULL"), "review", "deletion_measure_missing", "measure_id"))
            own = own.where("_k IS NOT NULL")

        # A struck-out number still tells the measure of a deleted row.
        base = ctx.records.where(F.col("record_type").isin("matrix", "deleted_matrix"))
        number = cell("measure_id")
        whole_number = number.withField("current", F.coalesce(F.when(number["current"] != "", number["current"]), number["raw"], F.lit("")))
        base = base.withColumn("fields", F.when(number.isNotNull(), F.transform_values("fields", lambda k, v: F.when(k == "measure_id", whole_number).otherwise(v))).otherwise(F.col("fields")))
        base = keyed(wide(base, ["measure_id"], ("fields",)))
        # Equal cells of a measure are read once and counted.
        cells = [F.col(f"_cell{k}") for k in range(len(fields))]
        kinds_of = base.select(*group, "record_type", *(F.struct(*(cell(f)[part].alias(part) for part in ("raw", "current", "deleted_spans", "deleted_unavailable")), cell(f).isNull().alias("absent")).alias(f"_cell{k}") for k, f in enumerate(fields)))
        kinds_of = spread(kinds_of.groupBy(*kinds_of.columns).agg(F.count(F.lit(1)).alias("_n")), *group)
        unread = [c["absent"] | F.coalesce(c["deleted_unavailable"], F.lit(False)) for c in cells]
        struck = F.flatten(F.array(*(F.when(u, F.array()).otherwise(_struck(c, version >= 2)) for u, c in zip(unread, cells))))
        current = F.array(*(strip_blanks(F.coalesce(c["current"], F.lit(""))) for c in cells))
        sources = stored(duties.once(kinds_of, _lost=any_of(unread), _struck=F.filter(struck, lambda s: s["text"] != ""), _current=current).drop(*(f"_cell{k}" for k in range(len(fields)))))
        some = sources.groupBy(*group).agg(F.bool_or("_lost").alias("_lost"), F.bool_or(F.size("_struck") > 0).alias("_any"), F.coalesce(F.sum(F.when(F.col("record_type") == "matrix", F.col("_n"))), F.lit(0)).alias("_rows"))
        texts = sources.select(*group, F.inline("_struck")).distinct()
        if version >= 2:
            parts = F.when(F.col("whole") & F.col("said").rlike(NUMBERED), F.transform(numbered_items(F.col("said")), lambda e: strip_blanks(e["text"])))
            entries = duties.once(texts, _entries=parts)
            listed = F.coalesce((F.size("_entries") > 0) & F.forall("_entries", lambda e: F.exists("_current", lambda c: F.contains(c, e))), F.lit(False))
            held = F.exists("_current", lambda c: F.contains(c, F.col("text"))) | listed
            current_rows = sources.where("record_type = 'matrix'").groupBy(*group, "_current").agg(F.sum("_n").alias("_n"))
            kept = entries.join(current_rows, group).where(held).groupBy(*group, "text", "said", "whole").agg(F.sum("_n").alias("_kept"))
            texts = texts.join(kept, [*group, "text", "said", "whole"], "left").withColumn("_kept", F.coalesce("_kept", F.lit(0)))
        else:
            texts = texts.withColumn("_kept", F.lit(0))

        known = own.join(some, group, "left")
        if version < 3:
            out.append(issues(_first_of_sheet(known.where("_lost IS NULL")), "review", "deletion_matrix_missing"))
        out.append(issues(_first_of_sheet(known.where("_lost")), "review", "deletion_source_unavailable"))
        out.append(issues(unavailable(known.where("_any"), target), "review", "deletion_duty_unavailable", target))
        read = known.where(F.col("_any") & readable(target) & (F.col("_target") != ""))
        asked = read.select(*group, "_target", "_rows").distinct()
        if by_measure:
            found = asked.join(texts, group).where(F.contains("_target", F.col("text")))
        else:
            renamed = texts.select(*(F.col(c).alias(f"_s_{c}") for c in SCOPE), "text", "said", "whole", "_kept")
            same = any_of([~F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in SCOPE])
            found = holding(asked, "_target", renamed, "text").where(~same)
        judged = found.groupBy(*group, "_target").agg(
            F.array_sort(F.collect_set(F.when(F.col("_kept") == 0, F.struct("text", "said")))).alias("_hits"),
            F.array_sort(F.collect_set(F.when((F.col("_kept") > 0) & (F.col("_kept") != F.col("_rows")), F.col("said")))).alias("_split"),
        )
        shown = F.col("_hits") if version == 1 else F.filter("_hits", lambda h: ~F.exists("_hits", lambda o: (o["text"] != h["text"]) & F.contains(o["text"], h["text"])))
        judged = stored(judged.withColumn("_texts", F.array_distinct(F.transform(shown, lambda h: h["said"]))))
        judged = read.join(judged, [*group, "_target"])
        out.append(issues(judged.where("size(_split) > 0"), "review", "deletion_current_conflict", target, conflicting_texts=F.col("_split")))
        out.append(issues(judged.where("size(_hits) > 0"), "violation", "deleted_matrix_text_reappeared", target, deleted_texts=F.col("_texts"), all_texts=F.array_distinct(F.transform("_hits", lambda h: h["said"])), final_text_wins=F.lit(version >= 2)))
        return union(out)

    return run


for _v in (1, 2, 3):
    CHECKS["deleted_text_reappears", _v] = _deleted_text(_v)


@check("applicability_values", 1, 2)
def applicability_values(ctx: Context, rows: DataFrame, p: dict[str, Any]) -> DataFrame:
    words = literals(p.get("placeholders", []))
    own = answered(ctx, wide(rows, ["applicability", "applicability_reason"]))
    read = own.where(readable("applicability"))
    no = read.where((F.col("_a.decision") == "not_applicable") & ((F.coalesce("_a.reason", F.lit("")) == "") | F.col("_a.reason").isin(words)))
    empty = (F.col("applicability") == "") | F.col("applicability").isin(words)
    unclear = read.where(F.col("_a.decision").isNull() & ~empty)
    return union(
        [
            issues(own.where("applicability_state = 'unreadable'"), "review", "applicability_cache_missing", "applicability"),
            issues(read.where(empty), "violation", "applicability_empty", "applicability"),
            issues(no.where("applicability_reason_state = 'unreadable'"), "review", "reason_cache_missing", "applicability_reason"),
            issues(no.where((F.col("applicability_reason_state") != "unreadable") & (F.coalesce("applicability_reason", F.lit("")).isin(["", *words]))), "violation", "not_applicable_reason_empty", "applicability_reason"),
            issues(unclear, "limitation", "applicability_meaning_unresolved", "applicability", state=F.col("_a.state")),
        ]
    )


def _like(pattern: str) -> Callable[[Column], Column]:
    return lambda x: x.rlike(pattern)


def _equal(text: str) -> Callable[[Column], Column]:
    return lambda x: x == text


def lines_as_items(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with the line ends of one cell as list separators, which normalising would drop."""
    listed = F.transform_values("fields", lambda k, v: F.when(k == name, v.withField("current", F.regexp_replace(v["current"], r"[\r\n]+", "、"))).otherwise(v))
    return rows.withColumn("fields", listed)


def responsible(text: Column) -> Column:
    """The items of a normalised cell of responsible units; a null cell has none."""
    return F.array_distinct(F.filter(F.split(F.coalesce(text, F.lit("")), "[、,;]"), lambda x: x != ""))


def segments(item: Column) -> Column:
    """unit - department - position of an item, the empty ones left out."""
    return F.filter(F.split(item, r"[-—－]"), lambda x: x != "")


def unit_segments(parts: Column) -> Column:
    """The segments of an item that name units: all before department and position, or the first of a shorter one."""
    return F.when(F.size(parts) >= 3, F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 2, F.lit(1)))).otherwise(F.slice(parts, 1, 1))


# Fixed value: words of a responsible unit's cell that leave its scope open.
OPEN_SCOPE = r"负责(?!人)|承担|适用|待(?:确认|核实|定)|未知|其他|可能|包括|仅|等|[-/—]$"


def _sound(config: dict[str, Any]) -> bool:
    """Whether restrictions can be read: a wrong one must not exclude a unit."""

    def patterns(listed: Any) -> bool:
        if not isinstance(listed, list) or not all(isinstance(x, str) and x for x in listed):
            return False
        try:
            return all(re.compile(x) for x in listed)
        except re.error:
            return False

    rules = config.get("restrictions")
    if not isinstance(rules, list) or not rules or not patterns(config.get("known_entity_patterns", [])):
        return False
    ids = [r.get("id") if isinstance(r, dict) else None for r in rules]
    if not all(isinstance(i, str) and i for i in ids) or len(set(ids)) != len(ids):
        return False
    return all(r.get("patterns") and patterns(r["patterns"]) and patterns(r.get("entity_patterns")) and patterns(r.get("required_patterns", [])) for r in rules)


def _whole(text: Column, patterns: list[str]) -> Column:
    """Whether one of the patterns fits the whole text; never null."""
    return F.coalesce(any_of([text.rlike(f"^(?:{x})$") for x in patterns]), F.lit(False))


def restricted_groups(ctx: Context, own: DataFrame, config: dict[str, Any]) -> DataFrame:
    """``own`` with what the whole group of responsible units (``_items``) says of the row's unit.

    ``_verdict`` is applicable, not_applicable or null (undecided, ``_why`` says
    for what reason); ``_restrictions`` are the ids of the restrictions that every item falls
    under.  A restriction has patterns of whole items, patterns of the full names of
    units it holds for (none: for no unit), and patterns that some item must
    fit.  An item that begins with the full name or a confirmed alias of one
    unit is that unit's, whatever pattern its words fit.  Without a
    restriction a group of known units that includes the row's own does not
    exclude it.
    """
    none = F.lit(None).cast("string")
    if not _sound(config):
        return own.withColumn("_verdict", none).withColumn("_why", F.lit("configuration")).withColumn("_restrictions", F.array().cast("array<string>"))
    rules = config["restrictions"]
    roster = unit_names(ctx).where("entity_code IS NOT NULL AND _unit != ''")
    confirmed = [(norm_literal(k), v["entity_code"] if isinstance(v, dict) else v) for k, v in (config.get("entity_aliases") or {}).items() if not isinstance(v, dict) or v.get("confirmed") is True]
    aliases = ctx.spark.createDataFrame([x for x in confirmed if x[0] and isinstance(x[1], str)], "_name string, entity_code string").join(roster.select("entity_code"), "entity_code")
    names = roster.select(F.col("_unit").alias("_name"), "entity_code").unionByName(aliases.select("_name", "entity_code")).distinct()

    # A unit's item is its name and at most a department and a position.
    items = own.select(F.explode("_items").alias("_item")).distinct()
    cut = F.regexp_replace("_item", r"[-/][^-/,;、]+$", "")
    bases = items.select("_item", F.explode(F.array_distinct(F.array(F.col("_item"), cut, F.regexp_replace(cut, r"[-/][^-/,;、]+$", "")))).alias("_name"))
    owners = bases.join(names, "_name").groupBy("_item").agg(F.min("entity_code").alias("_owner"), F.max("entity_code").alias("_other")).where("_owner = _other").drop("_other")
    owners = owners.join(roster.select(F.col("entity_code").alias("_owner"), F.col("_unit").alias("_owner_name")), "_owner")
    fits = [(_whole(F.col("_item"), r["patterns"]) & (F.col("_owner").isNull() | _whole(F.col("_owner_name"), r["entity_patterns"]) if r["entity_patterns"] else _whole(F.col("_item"), r["patterns"]))).alias(f"_fit{k}") for k, r in enumerate(rules)]
    judged = items.join(owners, "_item", "left").select("_item", "_owner", *fits)
    each = own.select("record_id", "entity_code", F.explode("_items").alias("_item")).join(judged, "_item")
    known = F.col("_owner").isNotNull()
    for k in range(len(rules)):
        known = known | F.col(f"_fit{k}")
    group = each.groupBy("record_id").agg(
        *(F.bool_and(f"_fit{k}").alias(f"_all{k}") for k in range(len(rules))), F.bool_and(known).alias("_known"), F.bool_or(F.coalesce(F.col("_owner") == F.col("entity_code"), F.lit(False))).alias("_here"),
    )
    out = own.join(group, "record_id", "left").join(roster, "entity_code", "left")
    under = [F.coalesce(F.col(f"_all{k}"), F.lit(False)) & _all_of([F.exists("_items", _like(f"^(?:{x})$")) for x in r.get("required_patterns", [])]) for k, r in enumerate(rules)]
    says = F.array_compact(F.array(*(F.when(u, F.struct(F.lit(r["id"]).alias("id"), F.lit(bool(r["entity_patterns"])).alias("some"), _whole(F.col("_unit"), r["entity_patterns"]).alias("holds"))) for u, r in zip(under, rules))))
    out = duties.once(out, _says=says)
    unit_known = _whole(F.col("_unit"), [x for r in rules for x in r["entity_patterns"]] + list(config.get("known_entity_patterns", [])))
    several = F.size(F.array_distinct(F.transform("_says", lambda x: x["holds"]))) > 1
    open_scope = (F.size("_items") == 0) | F.exists("_items", lambda i: i.rlike(OPEN_SCOPE))
    why = (
        F.when(~readable("responsibility"), "source_unavailable").when(open_scope, "open_scope")
        .when(F.size("_says") == 0, F.when(F.col("_unit").isNotNull() & F.col("_known") & F.col("_here"), none).otherwise("unknown_units"))
        .when(~F.exists("_says", lambda x: x["some"]), none).when(F.col("_unit").isNull(), "unit_unknown").when(~unit_known, "unit_class_unknown").when(several, "conflicting_restrictions")
    )
    out = out.withColumn("_why", why)
    verdict = F.when((F.size("_says") == 0) | F.get("_says", F.lit(0))["holds"], "applicable").otherwise("not_applicable")
    kept = F.when(F.col("_why").isin("source_unavailable", "open_scope"), F.array().cast("array<string>")).otherwise(F.transform("_says", lambda x: x["id"]))
    return out.withColumn("_verdict", F.when(F.col("_why").isNull(), verdict)).withColumn("_restrictions", kept).drop("_says", "_unit", "_known", "_here", *(f"_all{k}" for k in range(len(rules))))


def _all_of(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


@check("responsibility_applicability", 1)
def responsibility_applicability(ctx: Context, rows: DataFrame, p: dict[str, Any]) -> DataFrame:
    """The answer of a row against the restriction that its whole group of responsible units falls under; what can't be told is a limitation."""
    own = wide(lines_as_items(rows, "responsibility"), ["responsibility", "applicability"])
    own = restricted_groups(ctx, own.withColumn("_items", responsible(F.col("responsibility"))), p)
    own = own.withColumn("_a", F.when(readable("applicability"), facts.applicability(F.col("applicability"))["decision"])).withColumn("_bound", F.size("_restrictions") > 0)
    dark = own.where("_verdict IS NULL OR (_bound AND _a IS NULL)").withColumn("_why", F.coalesce("_why", F.lit("no_clear_answer")))
    against = own.where("_bound AND _verdict IS NOT NULL AND _a IS NOT NULL AND _a != _verdict")
    return union(
        [
            issues(dark, "limitation", "responsibility_applicability_unresolved", "responsibility", ["reason"], reason=F.col("_why"), restriction_ids=F.col("_restrictions")),
            issues(against, "violation", "responsibility_applicability_conflict", "applicability", responsibility_decision=F.col("_verdict"), stated_decision=F.col("_a"), restriction_ids=F.col("_restrictions")),
        ]
    )


@check("responsibility_unit_specific", 1)
def responsibility_unit_specific(ctx: Context, rows: DataFrame, p: dict[str, Any]) -> DataFrame:
    f, names = p["field"], literals(p["generic_unit_names"])
    own = wide(lines_as_items(rows, f), sorted({f, "applicability"})).where(~F.coalesce(F.col("applicability"), F.lit("")).rlike("^(?:不适用|否)"))
    units = F.flatten(F.transform(responsible(F.col(f)), lambda x: unit_segments(segments(x))))
    own = own.withColumn("_units", F.array_intersect(units, F.array(*(F.lit(n) for n in names)).cast("array<string>")))
    return union([issues(unavailable(own, f), "review", "responsibility_unit_unavailable", f), issues(own.where(F.size("_units") > 0), "violation", "responsibility_unit_not_concrete", f, generic_unit_names=F.col("_units"))])


def _types(texts: list[str]) -> Column:
    return F.array(*(F.lit(t) for t in texts)).cast("array<string>")


def _first_mapping(own: DataFrame, role: str, text: str, mapping: dict[str, list[str]]) -> DataFrame:
    """Version 1: the words of the mapping anywhere in the text."""
    says = {r: contains_any(F.coalesce(F.col(text), F.lit("")), words) for r, words in mapping.items()}
    own = own.withColumn("_roles", F.array_compact(F.array(*(F.when(v, F.lit(r)) for r, v in says.items())).cast("array<string>")))
    known = own.where(F.col("_wanted").isNotNull())
    met = F.exists("_wanted", lambda t: F.contains(F.coalesce(F.col(text), F.lit("")), t))
    return union(
        [
            issues(own.where("_wanted IS NULL"), "review", "responsibility_role_unresolved", role, ["role"], role=F.col(role)),
            issues(known.where("size(_roles) > 1"), "review", "responsibility_multiple_types", text, roles=F.col("_roles")),
            issues(known.where("size(_roles) <= 1").where(~met), "violation", "responsibility_role_missing", text, ["role"], role=F.col(role), expected=F.col("_wanted")),
        ]
    )


def _value_mapping(version: int) -> Check:
    """A role needs the responsibility of its mapping.

    1: in any words; 2: assumed in a statement that is not denied, quoted or
    delegated; 3: nor somebody else's or taken back later; 4: only rows that
    state a role, with unclear scopes left undecided; 5: one of several types
    that the row assumes is enough.
    """

    def run(ctx: Context, rows: DataFrame, p: dict[str, Any]) -> DataFrame:
        role, text = p["source_field"], p["text_field"]
        mapping = {norm_literal(k): literals(v) for k, v in p["mapping"].items()}
        wanted = F.element_at(F.create_map(*(x for k, v in mapping.items() for x in (F.lit(k), _types(v)))), F.coalesce(F.col(role), F.lit(""))) if mapping else F.lit(None).cast("array<string>")
        own = wide(rows, [role, text]).withColumn("_wanted", wanted)
        if version == 1:
            return _first_mapping(own, role, text, mapping)
        if version >= 4:
            own = own.where(F.coalesce(F.col(role), F.lit("")) != "")
        own = stored(own)
        known = own.where("_wanted IS NOT NULL")

        def judge(said: DataFrame) -> DataFrame:
            some = duties.with_facts(said, text, [], 1 if version == 2 else 2 if version == 3 else 3)
            says = F.col("_facts")
            mapped = _types(sorted({t for words in mapping.values() for t in words}))
            some = some.withColumn("_assumed", F.array_intersect(duties.assumed(says, version >= 4), mapped))
            more = F.size(duties.beyond_statements(says)) > 0
            delegated = F.exists(says["statements"], lambda s: s["delegated"])
            none = F.size("_assumed") == 0
            agrees = F.arrays_overlap("_assumed", "_wanted")
            if version == 2:
                blurred = delegated | (says["text"].rlike("(?:主体|审核|审批)[^。,;责任]{1,3}责任") & none)
                what = F.when(more | blurred, "responsibility_role_unresolved")
            else:
                others = duties.only_of_others(says) if version == 3 else F.exists(says["statements"], lambda s: s["other_actor"]) & (F.size(duties.own_statements(says, True)) == 0)
                decided = F.when(duties.contradicts_itself(says), "responsibility_self_contradiction")
                if version >= 4:
                    decided = decided.when(duties.unresolved(says), "responsibility_role_unresolved")
                what = decided.when(others, "responsibility_other_actor").when(says["malformed"] & none, "responsibility_expression_malformed").when(more | (delegated & none), "responsibility_role_unresolved")
            what = what.when(F.size("_assumed") > 1, "responsibility_multiple_types").when(agrees, F.lit(None)).when(none, "responsibility_role_missing").otherwise("responsibility_role_conflict")
            some = some.withColumn("_what", what).where("_what IS NOT NULL")
            if version == 5:
                some = some.where(~agrees | duties.contradicts_itself(says))
            return some.select(text, "_wanted", "_assumed", "_what")

        some = judged_once(known.where(readable(text) & (F.col(text) != "")), [text, "_wanted"], judge)
        kind = F.when(F.col("_what").isin("responsibility_role_unresolved", "responsibility_multiple_types"), "review").otherwise("violation")
        return union(
            [
                issues(own.where("_wanted IS NULL"), "review", "responsibility_role_unresolved", role, ["role"], role=F.col(role)),
                issues(unavailable(known, text), "review", "responsibility_unavailable", text),
                issues(some, kind, F.col("_what"), text, ["role"], role=F.col(role), expected=F.col("_wanted"), assumed=F.col("_assumed")),
            ]
        )

    return run


for _v in range(1, 6):
    CHECKS["value_mapping", _v] = _value_mapping(_v)


def _phrase_by_pattern(version: int, attributes: list[str]) -> Callable[[Column], Column]:
    """Versions 1 to 4 accept a text by patterns alone."""
    words = "|".join(f"\\Q{a}\\E" for a in attributes)
    bare = "|".join(f"\\Q{a}\\E" for a in dict.fromkeys([*attributes, *(a[:-1] for a in attributes if a.endswith("性"))]))
    longest = "|".join(f"\\Q{a}\\E" for a in sorted(dict.fromkeys([*attributes, *(a[:-1] for a in attributes if a.endswith("性"))]), key=len, reverse=True))
    # The sentence patterns and their denials.
    said = words if version <= 2 else bare
    stated = rf"对[^。！？!?；;]*?(?:{said})[^。！？!?；;]*?(?:负有?|承担)[^。！？!?；;]*?责任"
    stated_denial = r"不负|不承担|无需|不需要"
    denial = r"(?:不(?:必|用|再|得|应|应当|需要|能|会|愿)?|无需|无须|免于)"
    charged = rf"对(?:(?![，,](?:但|并|且|而)?(?:{denial})?对)[^。！？!?；;])*?(?:{said})(?:(?:[、,，]|及|和|与)(?:{said}))*[，,]?(?:直接|全面|共同|分别)?负责(?=[，,。；;！？!?]|$)"
    charged_list = rf"(?:{said})(?:(?:[、,，]|及|和|与)(?:{said}))*[，,]?(?:直接|全面|共同|分别)?负责$"
    shared = rf"[^。!?！？;]{{2,180}}?(?:{longest})[^。!?！？;]{{0,80}}?(?:具有|负有?|承担|有)(?:主体|审核|审批|复核)?责任"
    shared_object = rf"^([^。!?！？;]{{2,180}}?)(?:{longest})"
    shared_denial = r"不(?:负|承担|具有|对)|没(?:有|有义务)|无需|无须|免于|不需要"

    def accepted(duty: Column) -> Column:
        ok = F.exists(duties.occurrences(duty, stated), lambda m: ~m["text"].rlike(stated_denial) & (F.substr(duty, m["start"], F.lit(1)) != "不") | ((m["start"] == 0) & ~m["text"].rlike(stated_denial)))
        if version >= 2:

            def charges(m: Column) -> Column:
                thing = F.regexp_replace(F.regexp_replace(F.substr(m["text"], F.lit(2)), charged_list, ""), "^[的、,，与及和]+|[的、,，与及和]+$", "")
                content = F.regexp_replace(thing, rf"(?:{said})|[的、,，及和与]", "")
                return (content != "") & ~thing.rlike("^[照比]") & ~F.substr(duty, F.lit(1), m["start"]).rlike(rf"{denial}(?:直接|全面|共同|分别)?$")

            ok = ok | F.exists(duties.occurrences(duty, charged), charges)
        if version == 4:
            ok = ok & ~duty.rlike("(?:无需|无须|免于|不需要)对")
            thing = lambda m: F.regexp_replace(F.regexp_extract(m["text"], shared_object, 1), rf"(?:{longest})|[对的、,及和与]", "")
            ok = ok | F.exists(duties.occurrences(duty, shared), lambda m: (F.length(thing(m)) >= 2) & ~m["text"].rlike(shared_denial))
        return ok

    return accepted


def _phrase_by_facts(some: DataFrame, attributes: list[str], version: int) -> DataFrame:
    """Versions 5 to 8: rows whose statements do not make the phrase, with ``_what`` and ``_kind``."""
    first = duties.with_facts(some, "duty", attributes, 1 if version == 5 else 2)
    says = F.col("_facts")
    own = duties.own_statements(says)
    complete = F.exists(own, lambda s: (F.size(s["qualities"]) > 0) & s["object_present"])
    spoken = (F.size(says["qualities"]) > 0) & ((F.size(own) > 0) | (F.size(says["mentioned"]) > 0) | says["text"].contains("责任"))
    all_denied = (F.size(says["statements"]) > 0) & F.forall(says["statements"], lambda s: s["negative"])
    open_ends = F.when(spoken & ~all_denied, "responsibility_structure_unresolved").otherwise("responsibility_assertion_missing")
    if version == 5:
        what = F.when(complete, F.lit(None)).when((F.size(own) > 0) & (F.size(says["qualities"]) == 0), "responsibility_quality_missing").otherwise(open_ends)
    else:
        unlinked = F.exists(own, lambda s: s["unlinked"])
        plain = (F.size(own) > 0) & ~F.exists(own, lambda s: F.size(s["qualities"]) > 0) & (F.size(duties.beyond_statements(says)) == 0)
        silent = (F.size(says["statements"]) == 0) & (F.size(says["mentioned"]) == 0) & ~says["text"].rlike("(?:负有?|承担|担负|具有|履行|落实)[^。;；]{0,35}责任")
        what = (
            F.when(duties.contradicts_itself(says), "responsibility_self_contradiction").when(complete, F.lit(None)).when(duties.only_of_others(says), "responsibility_other_actor")
            .when(says["malformed"], "responsibility_expression_malformed").when(unlinked, "responsibility_structure_unresolved").when(plain, "responsibility_quality_missing")
            .when(silent, "responsibility_assertion_missing").otherwise(open_ends)
        )
    first = first.withColumn("_what", what)
    if version <= 6:
        return first.where("_what IS NOT NULL").withColumn("_kind", F.when(F.col("_what") == "responsibility_structure_unresolved", "review").otherwise("violation"))
    full = duties.with_facts(first, "duty", attributes, 3, "_full")
    says = F.col("_full")
    if version == 8:
        phrased = F.exists(duties.own_statements(says), lambda s: (F.size(s["qualities"]) > 0) & (F.size(F.array_except(s["unresolved"], F.array(F.lit("actor_identity")))) == 0))
        return full.where(~phrased | duties.contradicts_itself(says)).withColumn("_kind", F.lit("violation"))
    typed = lambda s: F.arrays_overlap(s["roles"], _types(list(facts.RESPONSIBILITY_TYPES)))
    stands = F.exists(duties.own_statements(says, True), lambda s: ((F.size(s["qualities"]) > 0) & s["object_present"]) | typed(s))
    others = F.exists(says["statements"], lambda s: s["other_actor"])
    late = F.when(duties.contradicts_itself(says), "responsibility_self_contradiction").when(others, "responsibility_other_actor").otherwise("responsibility_assertion_missing")
    full = full.where(~stands | duties.contradicts_itself(says)).withColumn("_what", F.when(duties.unresolved(says), "responsibility_structure_unresolved").otherwise(F.coalesce("_what", late)))
    return full.withColumn("_kind", F.when(F.col("_what") == "responsibility_structure_unresolved", "review").otherwise("violation"))


def _phrase(version: int) -> Check:
    """A duty states an attribute and a responsibility.

    1 to 4: by sentence patterns; 5 and 6: a statement of the row itself that
    links an object and an attribute, with the reason it fails; 7: or one of a
    type, unclear scopes left undecided; 8: an attribute within a statement; 9: both
    words anywhere.
    """

    def run(ctx: Context, rows: DataFrame, p: dict[str, Any]) -> DataFrame:
        own = stored(wide(rows, ["duty"])) if 5 <= version <= 8 else wide(rows, ["duty"])
        duty, attributes = F.col("duty"), literals(p["attributes"])
        some = own.where(readable("duty") if version <= 3 else readable("duty") & (duty != ""))
        evidence: dict[str, Column] = {}
        kind: Column = F.lit("violation")
        what: Column = F.lit("responsibility_phrase_missing")
        if version <= 4:
            some = own.where(readable("duty"))
            bad = some.where(~_phrase_by_pattern(version, attributes)(duty))
        elif version <= 8:
            bad = judged_once(some, ["duty"], lambda said: _phrase_by_facts(said, attributes, version).select("duty", "_what", "_kind"))
            kind = F.col("_kind")
            if version <= 6:
                what = F.col("_what")
            elif version == 7:
                evidence = {"original_issue_type": F.col("_what")}
        else:
            bad = some.withColumn("_attributes", terms_in(duty, attributes)).withColumn("_kinds", terms_in(duty, list(facts.RESPONSIBILITY_TYPES)))
            bad = bad.where((F.size("_attributes") == 0) | (F.size("_kinds") == 0))
            evidence = {"responsibility_attributes": F.col("_attributes"), "responsibility_types": F.col("_kinds")}
        return union([issues(unavailable(own, "duty"), "review", "responsibility_unavailable", "duty"), issues(bad, kind, what, "duty", **evidence)])

    return run


for _v in range(1, 10):
    CHECKS["responsibility_phrase", _v] = _phrase(_v)


@check("responsibility_department_alignment", 1)
def responsibility_department_alignment(ctx: Context, rows: DataFrame, p: dict[str, Any]) -> DataFrame:
    synonyms = {norm_literal(k): literals(v) for k, v in p.get("keyword_mappings", {}).items() if norm_literal(k)}
    own = with_key(wide(rows, ["measure_id", "responsibility"])).join(ctx.submitted("position_duty"), SCOPE, "left_semi")
    own = own.withColumn("_asked", terms_in(F.coalesce("responsibility", F.lit("")), list(synonyms))).where(F.size("_asked") > 0)
    duties = with_key(wide(ctx.of_type("position_duty"), ["measure_id", "department"])).where(scope_known() & F.col("key").isNotNull())
    backed = F.array_compact(F.array(*(F.when(contains_any(F.col("department"), v), F.lit(k)) for k, v in synonyms.items()))) if synonyms else F.array().cast("array<string>")
    have = duties.select(*SCOPE, "key", F.explode(backed).alias("_word")).groupBy(*SCOPE, "key").agg(F.collect_set("_word").alias("_backed"))
    out = own.join(have, [*SCOPE, "key"], "left").withColumn("_missing", F.array_except("_asked", F.coalesce("_backed", F.array().cast("array<string>")))).where(F.size("_missing") > 0)
    return issues(out, "review", "responsibility_department_mismatch", "responsibility", ["measure_id"], measure_id=F.col("measure_id"), missing_keywords=F.col("_missing"))


def _pairs_of_duties(ctx: Context, canonical: Callable[[Column], Column], without_unit: bool) -> DataFrame:
    """(SCOPE, key, _d, _p): the departments and positions of duty rows, if asked without the name of their unit."""
    duties = with_key(wide(ctx.of_type("position_duty"), ["measure_id", "department", "position"])).where(scope_known())
    department = F.coalesce("department", F.lit(""))
    if without_unit:
        # The roster is joined, not broadcast by hint: its size is left to the statistics.
        duties = duties.join(unit_names(ctx), "entity_code", "left")
        department = facts.without_unit(department, F.col("_unit"))
    return duties.select(*SCOPE, "key", canonical(department).alias("_d"), canonical(F.coalesce("position", F.lit(""))).alias("_p")).distinct()


def _coverage(version: int) -> Check:
    """Versions add: details of generic units (2), departments without their unit's name (3), details of all items
    (4), applicability as interpreted (5), unread and empty cells told apart (7), restrictions of units (8); 6 is 5,
    whose suggestions decide nothing."""

    def run(ctx: Context, rows: DataFrame, p: dict[str, Any]) -> DataFrame:
        """The department-position pairs that a measure names against those of its duty rows."""
        open_kind = p.get("unresolved_kind", "limitation")
        aliases = {norm_literal(k): norm_literal(v) for k, v in p.get("confirmed_aliases", {}).items()}

        def canonical(x: Column) -> Column:
            out = x
            for k, v in aliases.items():
                out = F.when(x == k, v).otherwise(out)
            return out

        own = with_key(wide(lines_as_items(rows, "responsibility"), ["measure_id", "applicability", "responsibility"])).withColumn("_items", responsible(F.col("responsibility")))
        if version >= 5:
            own = answered(ctx, own, "_said").withColumn("_decision", F.col("_said.decision")).drop("_said")
        else:
            own = own.withColumn("_decision", facts.plain_answer(F.col("applicability")))
        undecided = None
        if version == 8 and p.get("responsibility_applicability"):
            own = restricted_groups(ctx, own, p["responsibility_applicability"])
            undecided = own.where("_verdict IS NULL")
            # A wrong answer does not spare a measure that is known to hold for the unit.
            own = own.where("_verdict IS NULL OR _verdict = 'applicable'").withColumn("_decision", F.when(F.size("_restrictions") > 0, F.coalesce("_verdict", "_decision")).otherwise(F.col("_decision"))).drop("_verdict", "_restrictions", "_why")
        placeless = own.where(~scope_known())
        own = own.where(scope_known() & (F.coalesce("_decision", F.lit("")) != "not_applicable"))
        unclear = own.where("_decision IS NULL")
        own = own.where("_decision = 'applicable'")
        nameless = own.where("coalesce(measure_id, '') = ''")
        own = own.where("key IS NOT NULL")

        listed = _pairs_of_duties(ctx, canonical, version >= 3)
        duties = listed.where("key IS NOT NULL")
        have = duties.select(*SCOPE, "key").distinct().withColumn("_some", F.lit(True))
        own = own.join(have, [*SCOPE, "key"], "left")
        silent = own.where("_some IS NULL")

        # Each item wants pairs: those of its confirmed mapping, else the one it names.
        items = own.where("_some").select("*", F.explode_outer("_items").alias("_item")).withColumn("_parts", segments(F.col("_item")))
        size = F.size("_parts")
        items = items.withColumn("_raw_d", F.when(size > 1, F.get("_parts", size - 2))).withColumn("_raw_p", F.when(size > 1, F.get("_parts", size - 1)))
        wanted = F.when(size > 1, F.array(F.struct(canonical(F.col("_raw_d")).alias("d"), canonical(F.col("_raw_p")).alias("p"))))
        mapped = F.lit(False)
        for text, pairs in p.get("confirmed_mappings", {}).items():
            this = F.coalesce(F.col("_item") == norm_literal(text), F.lit(False))
            of_this = F.array(*(F.struct(canonical(F.lit(norm_literal(x["department"]))).alias("d"), canonical(F.lit(norm_literal(x["position"]))).alias("p")) for x in pairs))
            mapped, wanted = mapped | this, F.when(this, of_this).otherwise(wanted)
        items = items.withColumn("_mapped", mapped).select("*", F.explode_outer(wanted).alias("_w")).withColumn("_d", F.col("_w.d")).withColumn("_p", F.col("_w.p"))
        missed = items.join(duties, [*SCOPE, "key", "_d", "_p"], "left_anti")

        # A bare grade stands for the one position of the department that carries it in brackets.
        graded = duties.withColumn("_grade", facts.grade_of_title(F.col("_p"))).where("_grade IS NOT NULL")
        graded = graded.groupBy(*SCOPE, "key", "_d", "_grade").agg(F.count_distinct(facts.title_before_grade(F.col("_p"))).alias("_titles"), F.array_sort(F.collect_set("_p")).alias("_titled"))
        missed = missed.withColumn("_grade", F.when(~F.col("_mapped"), facts.bare_grade(F.col("_p")))).join(graded, [*SCOPE, "key", "_d", "_grade"], "left")
        missed = missed.where("_titles IS NULL OR _titles > 1")

        known_d = listed.select(*SCOPE, "_d").distinct().withColumn("_known_d", F.lit(True))
        known_p = listed.select(*SCOPE, "_p").distinct().withColumn("_known_p", F.lit(True))
        generic = F.arrays_overlap("_parts", F.array(*(F.lit(x) for x in literals(p.get("generic_responsibilities", [])))).cast("array<string>")) | F.col("_raw_d").endswith("部门")
        known = F.coalesce(F.col("_known_d") & F.col("_known_p") & ~generic, F.lit(False))
        state = F.when(F.col("_titles") > 1, "ambiguous").when(F.col("_mapped") | known, "missing").otherwise("uncertain")
        missed = missed.join(known_d, [*SCOPE, "_d"], "left").join(known_p, [*SCOPE, "_p"], "left").withColumn("_state", state)

        # What the measure's duty rows say of the department, or else of the position, of an uncertain item.
        in_d = duties.groupBy(*SCOPE, "key", "_d").agg(F.array_sort(F.collect_set("_p")).alias("_positions"))
        of_p = duties.groupBy(*SCOPE, "key", "_p").agg(F.array_sort(F.collect_set("_d")).alias("_departments"))
        detailed = (size >= 3) & (F.col("_state") == "uncertain") & F.lit(version >= 2)
        if version in (2, 3):
            detailed = detailed & F.arrays_overlap(unit_segments(F.col("_parts")), F.array(*(F.lit(x) for x in literals(p.get("generic_unit_names", [])))).cast("array<string>"))
        nothing = F.array().cast("array<string>")
        others = F.when(F.col("_positions").isNull() & F.lit(version >= 4), F.coalesce("_departments", nothing)).otherwise(nothing)
        detail = F.struct(F.col("_item").alias("responsibility"), F.col("_raw_d").alias("matrix_department"), F.col("_raw_p").alias("matrix_position"), F.coalesce("_positions", nothing).alias("duty_positions"), others.alias("department_candidates"))
        missed = missed.join(in_d, [*SCOPE, "key", "_d"], "left").join(of_p, [*SCOPE, "key", "_p"], "left")
        missed = missed.withColumn("_detail", F.when(detailed, detail)).withColumn("_ambiguous", F.when(F.col("_state") == "ambiguous", F.struct(F.col("_item").alias("responsibility"), F.col("_d").alias("department"), F.col("_p").alias("grade"), F.col("_titled").alias("positions"))))
        kept = ["record_type", *SCOPE, "business_id", *PLACE, "record_id", "measure_id", "responsibility_state", "responsibility"]
        grouped = missed.groupBy(*kept, "_state").agg(F.array_sort(F.collect_set("_item")).alias("_items"), F.array_sort(F.collect_set("_detail")).alias("_details"), F.array_sort(F.collect_set("_ambiguous")).alias("_ambiguities"))
        unsure = grouped.where("_state = 'uncertain'")
        found = [
            issues(placeless, open_kind, "coverage_scope_unconfirmed"),
            issues(unclear, open_kind, "coverage_applicability_unknown", "applicability"),
            issues(nameless, "review", "coverage_measure_id_missing", "measure_id"),
            issues(silent, "violation", "duty_record_missing", None, ["measure_id"], measure_id=F.col("measure_id")),
            issues(grouped.where("_state = 'missing'"), "review", "specific_responsibility_missing", None, ["measure_id"], measure_id=F.col("measure_id"), missing_responsibilities=F.col("_items")),
            issues(grouped.where("_state = 'ambiguous'"), open_kind, "coverage_position_ambiguous", None, ["measure_id"], measure_id=F.col("measure_id"), ambiguous_positions=F.col("_ambiguities")),
        ]
        if version >= 7:
            found.append(issues(unavailable(unsure, "responsibility"), "review", "responsibility_unit_unavailable", "responsibility"))
            found.append(issues(unsure.where("responsibility_state = 'empty'"), "violation", "responsibility_empty", "responsibility"))
            unsure = unsure.where("responsibility_state = 'value'")
        found.append(issues(unsure, open_kind, "coverage_mapping_unconfirmed", None, ["measure_id"], measure_id=F.col("measure_id"), responsibility_items=F.col("_items"), mapping_details=F.col("_details")))
        if undecided is not None:
            found.append(issues(undecided, "limitation", "responsibility_applicability_unresolved", "responsibility", ["reason"], reason=F.col("_why")))
        return union(found)

    return run


for _v in range(1, 9):
    CHECKS["responsibility_coverage", _v] = _coverage(_v)
CHECKS["coverage", 1] = _coverage(1)


@check("ordered_records", 1, 2, 3, 4)
def ordered_records(ctx: Context, rows: DataFrame, p: dict[str, Any]) -> DataFrame:
    """Blocks of equal measure numbers in a sheet: out of order, or split by other numbers."""
    f = p["field"]
    own = with_key(wide(rows.where(has_detail(F.col("fields"))), [f]), f).where((F.col(f) != "") & ~F.col(f).rlike("^(?:填表说明|填报说明|说明[:：]|注[:：]|合计)"))
    sheet = ["file_path", "sheet"]
    own = own.withColumn("_key", F.coalesce("key", F.array(F.lit(2**62))))
    w = Window.partitionBy(*sheet).orderBy("row")
    own = own.withColumn("_turn", F.when(F.lag("_key").over(w).eqNullSafe(F.col("_key")), 0).otherwise(1)).withColumn("_block", F.sum("_turn").over(w))
    scope = ["business_id", "variant_id"]
    unresolved: list[DataFrame] = []
    rank = F.col("_key")
    if ctx.baseline_order is not None:
        # baseline_order: business_id, variant_id, key, rank
        order = ctx.baseline_order.select(*scope, F.col("key").alias("_key"), F.col("rank").alias("_rank"))
        ranked = order.select(*scope).distinct().withColumn("_has", F.lit(True))
        own = own.join(order, [*scope, "_key"], "left").join(ranked, scope, "left")
        unresolved.append(issues(own.where("_has AND _rank IS NULL"), "review", "order_reference_unresolved", f, ["measure_id"], measure_id=F.col(f)))
        rank = F.when(F.col("_has"), F.array(F.col("_rank").cast("bigint"))).otherwise(F.col("_key"))
        own = own.where("_has IS NULL OR _rank IS NOT NULL")
    own = own.withColumn("_order", rank)
    found = own.groupBy(*sheet, "_block", "_key", "_order").agg(F.min("row").alias("_first"))
    b = Window.partitionBy(*sheet).orderBy("_block")
    same = Window.partitionBy(*sheet, "_key").orderBy("_block")
    found = (
        found.withColumn("_before", F.lag("_order").over(b) > F.col("_order"))
        .withColumn("_after", F.col("_order") > F.lead("_order").over(b))
        .withColumn("_down", F.coalesce("_before", F.lit(False)) | F.coalesce("_after", F.lit(False)))
        .withColumn("_counterpart", F.when(F.col("_before"), F.lag("_first").over(b)).otherwise(F.lead("_first").over(b)))
        .withColumn("_again", F.coalesce(F.lead("_first").over(same), F.first("_first").over(same)))
        .withColumn("_parts", F.count(F.lit(1)).over(Window.partitionBy(*sheet, "_key")))
    )
    joined = own.join(found.select(*sheet, "_block", "_down", "_counterpart", "_again", "_parts"), [*sheet, "_block"])
    down = issues(joined.where("_down"), "violation", "measure_order", f, ["reason", "measure_id"], reason=F.lit("措施顺序倒置"), measure_id=F.col(f), related_row=F.col("_counterpart"))
    split = issues(joined.where("_parts > 1"), "violation", "measure_order", f, ["reason", "measure_id"], reason=F.lit("同一措施记录不连续"), measure_id=F.col(f), related_row=F.col("_again"))
    return union([*unresolved, down, split])


@check("system_type_preprocessing_notice", 1)
def system_type_preprocessing_notice(ctx: Context, rows: DataFrame, p: dict[str, Any]) -> DataFrame:
    own = wide(rows, ["system_owner", "system_type"])
    kinds = (facts.FIRST_LEVEL, facts.SECOND_LEVEL, facts.THIRD_LEVEL)
    bad = own.where(~F.coalesce(F.col("system_type"), F.lit("")).isin(*kinds) & facts.system_level(F.coalesce("system_owner", F.lit(""))).isNull())
    return issues(bad, "violation", "system_type_preprocessing_unresolved", "system_type")


LISTS = ("position_duty", "incompatible_position", "system_rule")


def _categories() -> Column:
    kinds = F.transform("sheets", lambda s: F.when(s["sheet_type"] == "matrix", "matrix").when(s["sheet_type"].isin(*LISTS), "three_lists"))
    named = F.when(F.col("material_type").isin("matrix", "three_lists"), F.array("material_type")).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.array_compact(F.concat(kinds, named)))


@check("sheet_exists", 1)
def sheet_exists(ctx: Context, rows: DataFrame, p: dict[str, Any]) -> DataFrame:
    wanted = list(p["sheet_types"])
    key = ["entity_code", "business_id", "variant_id"]
    files = ctx.files.withColumn("business_id", F.coalesce("business_id", "business_code"))
    scopes = ctx.scopes()
    if set(wanted) <= set(LISTS):
        scopes = scopes.join(files.where(F.array_contains(_categories(), "three_lists")).select(*key).distinct(), key, "left_semi")
    present = files.select(*key, F.explode("sheets.sheet_type").alias("_type")).distinct()
    gone = scopes.withColumn("_type", F.explode(F.array(*(F.lit(w) for w in wanted)))).join(present, [*key, "_type"], "left_anti")
    return issues(gone, "violation", "sheet_missing", None, ["missing_sheet"], missing_sheet=F.col("_type"))


@check("required_documents", 1, 2, 3, 4)
def required_documents(ctx: Context, rows: DataFrame, p: dict[str, Any]) -> DataFrame:
    key = ["entity_code", "business_id", "variant_id"]
    files = ctx.files.withColumn("business_id", F.coalesce("business_id", "business_code")).withColumn("file_path", F.col("relative_path"))
    wanted = list(p.get("material_types", []))
    out = [issues(files.where("entity_conflict"), "review", "entity_conflict")]
    if wanted:
        out.append(issues(files.where(F.size("parse_errors") > 0), "violation", "parse_error", None, None, unavailable_reason=F.array_join("parse_errors", "；")))
        required = [b for b in ctx.scope_businesses if b.get("required", True)]
        scopes = Context(ctx.records, ctx.files, ctx.entities, None, ctx.scope_entities, required).scopes()
        have = files.select(*key, F.explode(_categories()).alias("_category"), "sha256", "sheets", "relative_path")
        present = have.select(*key, "_category").distinct()
        gone = scopes.withColumn("_category", F.explode(F.array(*(F.lit(w) for w in wanted)))).join(present, [*key, "_category"], "left_anti")
        if set(wanted) == {"matrix", "three_lists"}:
            gone = gone.join(present.select(*key).distinct(), key, "left_anti")
        out.append(issues(gone, "violation", "material_missing", None, ["missing_material"], missing_material=F.col("_category")))
        sheets = have.where(F.col("_category").isin(wanted)).select(*key, "_category", "sha256", F.explode("sheets.sheet_type").alias("_type"))
        sheets = sheets.where((F.col("_type") == "matrix") == (F.col("_category") == "matrix"))
        several = sheets.groupBy(*key, "_category", "_type").agg(F.count_distinct("sha256").alias("_n")).where("_n > 1").select(*key, "_category").distinct()
        several = several.join(scopes, key, "left_semi")
        out.append(issues(several, "review", "material_versions", None, ["missing_material"], missing_material=F.col("_category")))
    if p.get("naming_mode"):
        # Words that a file name of either material holds.
        words = {"matrix": ["矩阵", "取证"], "three_lists": ["三清单"], **p.get("naming_keywords", {})}
        name = F.element_at(F.split("relative_path", "/"), -1)
        for kind in ("matrix", "three_lists"):
            named = files.where(F.col("material_type") == kind)
            out.append(issues(named.where(~contains_any(name, words[kind])), "violation", "naming_keyword_missing", None, ["naming_issue"], naming_issue=F.lit("/".join(words[kind]))))
        if p.get("require_entity_name", True):
            roster = ctx.entities.select("entity_code", norm_text(F.col("name")).alias("_name"))
            named = files.where(F.col("material_type").isin("matrix", "three_lists")).join(roster, "entity_code", "left")
            out.append(issues(named.where(~F.coalesce(F.contains(norm_text(name), F.col("_name")), F.lit(False))), "violation", "naming_entity_missing", None, ["naming_issue"], naming_issue=F.lit("entity")))
    if p.get("explanation_mode"):
        scope = ctx.spark.createDataFrame([(e,) for e in ctx.scope_entities], "entity_code string").withColumn("_a", F.lit(True))
        sent = files.where(F.size(_categories()) > 0).select("entity_code").where("entity_code IS NOT NULL").distinct().withColumn("_b", F.lit(True))
        told = files.where("material_type = 'explanation' AND true_format IN ('doc', 'docx', 'pdf') AND NOT coalesce(entity_conflict, false)").where(F.size("parse_errors") == 0)
        differ = scope.join(sent, "entity_code", "full_outer").where("_a IS NULL OR _b IS NULL").join(told.select("entity_code").distinct(), "entity_code", "left_anti")
        out.append(issues(differ, "violation", "explanation_missing", None, ["missing_material"], missing_material=F.lit("主体差异说明")))
    return union(out)


@check("schema_contains", 1, 2, 3)
def schema_contains(ctx: Context, rows: DataFrame, p: dict[str, Any]) -> DataFrame:
    """Logical fields that a sheet lacks, and headers it has less often than the expected bag."""
    sheets = ctx.files.withColumn("file_path", F.col("relative_path")).select("entity_code", "business_code", F.coalesce("business_id", "business_code").alias("business_id"), "variant_id", "file_path", F.explode("sheets").alias("_s"))
    sheets = sheets.where(F.col("_s.sheet_type").isin(list(p.get("sheet_types", [])))).withColumn("sheet", F.col("_s.title"))
    lacking = F.array_sort(F.array_except(F.array(*(F.lit(x) for x in p.get("required_fields", []))).cast("array<string>"), F.col("_s.columns")))
    out = [issues(sheets.withColumn("_m", lacking).where(F.size("_m") > 0), "review", "schema_field_mapping", None, ["missing_fields"], missing_fields=F.col("_m"))]
    if p.get("expected_headers"):
        want: dict[str, int] = {}
        for h in literals(p["expected_headers"]):
            want[h] = want.get(h, 0) + 1
        heads = F.transform("_s.headers", lambda h: strip_blanks(h))
        short = F.array_compact(F.array(*(F.when(F.size(F.filter(heads, _equal(h))) < n, F.lit(h)) for h, n in sorted(want.items()))))
        out.append(issues(sheets.withColumn("_m", short).where(F.size("_m") > 0), "review", "schema_header_missing", None, ["missing_fields"], missing_fields=F.col("_m")))
    return union(out)


#: Checks over the submission as a whole, not over rows of a record type.
PACKAGE_CHECKS = {"required_documents", "sheet_exists", "schema_contains"}
