import json

import pytest
from pyspark.sql import functions as F

from rulespark.functions.items import numbered_items
from rulespark.operators.checks import CHECKS, answered
from rulespark.plans.records import wide, with_record_id
from tests.records_fixture import cell, context, duty, file, matrix, record


def run(spark, name, version, records, params=None, types=None, files=None, **more):
    ctx = context(spark, records, files, **more)
    ctx.records = with_record_id(ctx.records)
    rows = ctx.records if types is None else ctx.records.where(ctx.records.record_type.isin(types))
    found = CHECKS[name, version](ctx, rows, params or {}).collect()
    return sorted((r["row"] or 0, r["kind"], r["issue_type"]) for r in found)


def test_required_fields_tells_absent_unreadable_blank_and_placeholder_apart(spark):
    rows = [duty(1, department=None), duty(2, department=cell("", "formula_no_cache")), duty(3, department=""), duty(4, department="待 定"), duty(5)]
    assert run(spark, "required_fields", 1, rows, {"fields": ["department"]}) == [(1, "review", "field_unavailable"), (2, "review", "field_unavailable"), (3, "violation", "field_missing"), (4, "violation", "field_missing")]


def test_required_fields_when(spark):
    rows = [duty(1, department="", role="经办"), duty(2, department="", role="审核")]
    assert [x[0] for x in run(spark, "required_fields", 1, rows, {"fields": ["department"], "when": {"field": "role", "in": ["审核"]}})] == [2]


def test_field_constraints_exceptions_and_splitting(spark):
    rows = [duty(1, department="财务部-相关部门"), duty(2, department="财务部"), duty(3, department="甲部、乙部"), duty(4, department="综合组"), duty(5, department="")]
    p = {"field": "department", "placeholders": ["综合组"], "separators": ["、"], "exact_exceptions": ["综合组"]}
    assert run(spark, "field_constraints", 6, rows, p) == [(1, "violation", "field_not_concrete"), (3, "violation", "field_not_split"), (5, "violation", "field_not_concrete")]
    assert (4, "violation", "field_not_concrete") in run(spark, "field_constraints", 4, rows, p)


def test_field_constraints_checks_only_the_positions_a_list_has(spark):
    rows = [record("incompatible_position", 1, position_a="相关人员", position_b="出纳"), record("incompatible_position", 2, position_a="无", position_b="")]
    assert run(spark, "field_constraints", 6, rows, {"field": "position", "placeholders": ["相关人员"]}) == [(1, "violation", "field_not_concrete")]


def test_duplicate_duties_by_sheet(spark):
    rows = [duty(1), duty(2, duty="对真实性承担主体责任"), duty(3, sheet="other"), duty(4, entity="300A"), duty(5, variant="unknown")]
    assert [x[0] for x in run(spark, "duplicate_duties", 2, rows)] == [1, 2]
    assert [x[0] for x in run(spark, "duplicate_duties", 1, rows)] == [1, 2, 3]


def test_missing_duty_measures_stay_within_their_scope(spark):
    rows = [matrix(1), matrix(2, measure_id="X-2-控制措施1"), matrix(3, entity="300A"), duty(9), duty(10, measure_id="Y-2-控制措施1", entity="300A")]
    assert run(spark, "missing_duty_measures", 1, rows, types=["matrix"]) == [(2, "review", "missing_duty_measure"), (3, "review", "missing_duty_measure")]


@pytest.mark.parametrize(("answer", "present", "found"), [("适用", True, False), ("不适用,无此业务", True, True), ("", True, False), ("适用", False, True), ("不适用,无", False, False), ("", False, False), ("待确认", True, True)])
def test_alignment(spark, answer, present, found):
    rows = [matrix(1, applicability=answer)] + ([duty(2)] if present else [])
    assert bool(run(spark, "measure_applicability_alignment", 3, rows, types=["matrix"])) == found


def test_reference_exists(spark):
    rows = [matrix(1), matrix(2, measure_id="X-2-控制措施1", applicability="不适用,无"), duty(3), duty(4, measure_id="X-9-控制措施1"), duty(5, measure_id="X-2-控制措施1"), duty(6, measure_id=""), duty(7, variant="unknown")]
    p = {"source_field": "measure_id", "target_record_type": "matrix", "target_field": "measure_id"}
    assert run(spark, "reference_exists", 2, rows, p, ["position_duty"]) == [
        (4, "violation", "reference_not_found"),
        (5, "violation", "reference_not_applicable"),
        (6, "violation", "reference_missing"),
        (7, "review", "reference_field_unavailable"),
    ]


def test_roles_same_duty_needs_equal_department_and_names(spark):
    rows = [duty(1), duty(2, role="审核", duty="对真实性负审核责任"), duty(3, role="审核", duty="对真实性负审核责任", department="审计部"), duty(4, role="审核", duty="对真实性负审核责任", measure_id="X-2-控制措施1")]
    assert run(spark, "roles_same_duty", 4, rows) == [(1, "violation", "same_duty_person_overlap")]


def test_roles_same_duty_falls_back_to_the_text_of_the_measure(spark):
    text = "付款前核对合同"
    rows = [matrix(9, control_measure=text), duty(1, measure_id="", control_measure=text), duty(2, role="审核", duty="对真实性负审核责任", control_measure=text)]
    assert run(spark, "roles_same_duty", 4, rows, types=["position_duty"]) == [(1, "violation", "same_duty_person_overlap")]


def test_roles_disjoint(spark):
    rows = [duty(1, people=[("甲", "7")]), duty(2, role="审核", people=[("甲", "7")]), duty(3, measure_id="X-2-控制措施1", role="审核", people=[("甲", "7")])]
    p = {"group_by": ["entity_code", "business_code", "variant_id", "measure_id"], "role_field": "role", "person_field": "person_names", "role_pairs": [["经办", "审核"]]}
    assert run(spark, "roles_disjoint", 1, rows, p) == [(1, "violation", "role_overlap"), (2, "violation", "role_overlap")]


def test_set_subset_by_version(spark):
    rows = [
        matrix(1, carrier="《付款单》、合同（正本、副本）"), duty(2, carrier="付款单、验收单"), duty(3, duty="核对《合同（正本、副本）》和《台账》"),
        duty(4, measure_id=""), duty(5, measure_id="X-9-控制措施1"), duty(6, variant="unknown"), duty(7, carrier=cell("", "formula_no_cache"), duty="对付款单的准确性负主体责任"),
        duty(8, duty="对合同的准确性负审核责任"), duty(9, carrier="付款单", duty="对付款单准确匹配情况负审核责任"), matrix(10, measure_id="X-2-控制措施1", carrier=cell("", "formula_no_cache")), duty(11, measure_id="X-2-控制措施1"),
        matrix(12, measure_id="X-3-控制措施1", carrier="甲单"), matrix(13, measure_id="X-3-控制措施1", carrier="乙单"), duty(14, measure_id="X-3-控制措施1"), duty(15, carrier="合同"),
    ]
    p = {"source_field": "carrier", "target_record_type": "matrix", "target_field": "carrier", "fallback_explicit_field": "duty"}
    always = [
        (2, "review", "carrier_reference_unmatched"), (3, "review", "carrier_reference_unmatched"), (4, "review", "carrier_measure_id_missing"), (5, "review", "matrix_ambiguous"), (6, "review", "carrier_scope_unconfirmed"),
        (11, "review", "carrier_target_unavailable"), (14, "review", "matrix_ambiguous"),
    ]
    wrong, unread, gone = ("review", "carrier_reference_unmatched"), ("review", "carrier_parse_unavailable"), ("review", "carrier_source_unavailable")
    assert run(spark, "set_subset", 1, rows, p, ["position_duty"]) == sorted([*always, (8, *wrong), (15, *wrong)])
    assert run(spark, "set_subset", 2, rows, p, ["position_duty"]) == sorted([*always, (7, *gone), (8, *wrong), (9, *unread), (15, *wrong)])
    for version in (3, 4, 5):  # 合同 is the short name of the one carrier with a bracket
        assert run(spark, "set_subset", version, rows, p, ["position_duty"]) == sorted([*always, (7, *gone), (9, *unread)])


def test_deleted_text_reappears(spark):
    rows = [matrix(1, control_measure=cell("核对合同", deleted=["逐笔登记台账"])), duty(2, duty="逐笔 登记台账并核对合同"), duty(3, duty="核对合同"), duty(4, duty="逐笔登记台账", measure_id="X-7-控制措施1")]
    p = {"source_fields": ["control_measure"], "target_field": "duty"}
    assert run(spark, "deleted_text_reappears", 3, rows, p, ["position_duty"]) == [(2, "violation", "deleted_matrix_text_reappeared")]
    kept = [*rows, matrix(5, control_measure="逐笔登记台账")]
    assert run(spark, "deleted_text_reappears", 3, kept, p, ["position_duty"]) == [(2, "review", "deletion_current_conflict")]


def test_deleted_text_by_version(spark):
    listed = "1.逐笔登记台账；2.核对(含1.明细)合同；3.归档"
    rows = [
        matrix(1, control_measure=cell("", deleted=[listed], raw=listed)),
        matrix(2, measure_id="X-2-控制措施1", control_measure=cell("1.；2.核对", deleted=["逐笔登记台账"], raw="1.逐笔登记台账；2.核对")), matrix(3, measure_id="X-2-控制措施1", control_measure="逐笔登记台账"),
        record("deleted_matrix", 4, measure_id=cell("", deleted=["X-3-控制措施1"], raw="X-3-控制措施1"), control_measure=cell("", deleted=["盘点现金"], raw="盘点现金")),
        matrix(5, measure_id="X-4-控制措施1", control_measure=cell("1.新登记；2.新核对", deleted=["1.新核对；2.新登记"], raw="1.新核对；2.新登记；1.新登记；2.新核对")),
        duty(6, duty="应核对(含1.明细)合同，再归档"), duty(7, duty="逐笔登记台账", measure_id="X-2-控制措施1"), duty(8, duty="盘点现金", measure_id="X-3-控制措施1"), duty(9, duty="1.新核对；2.新登记", measure_id="X-4-控制措施1"),
        duty(10, duty="盘点现金", measure_id=""), duty(11, duty="盘点现金", variant="unknown"), duty(12, duty=cell("", "formula_no_cache")), duty(13, duty="盘点现金", measure_id="X-9-控制措施1", sheet="t"),
        matrix(14, measure_id="X-5-控制措施1", control_measure=None), duty(15, measure_id="X-5-控制措施1", sheet="u"),
    ]
    p = {"source_fields": ["control_measure"], "target_field": "duty"}
    hit, review = ("violation", "deleted_matrix_text_reappeared"), "review"
    always = [(8, *hit), (12, review, "deletion_duty_unavailable"), (15, review, "deletion_source_unavailable")]
    missing = [(10, review, "deletion_measure_missing"), (13, review, "deletion_matrix_missing")]
    unknown = [(11, review, "deletion_scope_unknown")]
    two = [(6, *hit), (7, review, "deletion_current_conflict")]
    assert run(spark, "deleted_text_reappears", 1, rows, p, ["position_duty"]) == sorted([*always, *missing, *unknown, (7, *hit), (9, *hit)])
    assert run(spark, "deleted_text_reappears", 2, rows, p, ["position_duty"]) == sorted([*always, *missing, *unknown, *two])
    assert run(spark, "deleted_text_reappears", 3, rows, p, ["position_duty"]) == sorted([*always, *unknown, *two])
    wide_open = run(spark, "deleted_text_reappears", 1, rows, p | {"match_scope": "scope"}, ["position_duty"])
    assert {x[0] for x in wide_open if x[1] == "violation"} == {7, 8, 9, 10, 13}


def test_numbered_items_equal_python(spark):
    texts = ["1.甲；2.乙", "（1）甲。 （2）乙；", "说明：1.甲", "1.甲(a；2.b)；3.丙", "", "1、", "1．甲\n２．乙 \n", "前；1.甲】；2.乙"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("i", numbered_items(F.col("t"))).collect()
    assert [[(x["text"], x["start"], x["end"]) for x in r["i"]] for r in rows] == [
        [("甲", 2, 3), ("乙", 6, 7)], [("甲", 3, 4), ("乙", 9, 10)], [], [("甲(a；2.b)", 2, 10), ("丙", 13, 14)], [], [], [("甲", 2, 3), ("乙", 6, 7)], [("甲】", 4, 6), ("乙", 9, 10)],
    ]


def test_responsibility_phrase_and_mapping(spark):
    rows = [duty(1), duty(2, duty="负责报销"), duty(3, duty="对真实性不承担主体责任"), duty(4, role="审核", duty="对真实性负主体责任")]
    assert run(spark, "responsibility_phrase", 9, rows, {"attributes": ["真实性"]}) == [(2, "violation", "responsibility_phrase_missing")]
    assert [x[0] for x in run(spark, "responsibility_phrase", 8, rows, {"attributes": ["真实性"]})] == [2, 3]
    mapping = {"source_field": "role", "text_field": "duty", "mapping": {"经办": ["主体责任"], "审核": ["审核责任"]}}
    assert [x[0] for x in run(spark, "value_mapping", 5, rows, mapping)] == [2, 3, 4]


def test_coverage(spark):
    rows = [matrix(1, responsibility="财务部-会计、财务部-出纳、相关部门-主管"), matrix(2, measure_id="X-2-控制措施1"), matrix(3, applicability="不适用,无"), duty(4), duty(5, measure_id="X-3-控制措施1", position="出纳")]
    assert run(spark, "responsibility_coverage", 8, rows, {}, ["matrix"]) == [(1, "limitation", "coverage_mapping_unconfirmed"), (1, "review", "specific_responsibility_missing"), (2, "violation", "duty_record_missing")]


def test_coverage_by_version(spark):
    rows = [
        matrix(1, responsibility="财务部-会计\n财务部-三级职员、审计部-二级职员"),
        matrix(2, measure_id="X-2-控制措施1", responsibility="管理单位-财务部-主办、归口办"),
        matrix(3, measure_id="X-2-控制措施1", responsibility=""),
        matrix(4, measure_id="X-2-控制措施1", responsibility=cell("", "formula_no_cache")),
        matrix(5, measure_id="X-2-控制措施1", responsibility="财务部-会计", applicability="适用但待核实"),
        duty(6, department="甲县供电公司财务部"), duty(7, department="财务部", position="专责(3级职员)"),
        duty(8, department="审计部", position="主审(二级职员)"), duty(9, department="审计部", position="助审(二级职员)"),
        duty(10, department="财务部", position="会计", measure_id="X-2-控制措施1"),
    ]
    names = lambda version, p=None: run(spark, "responsibility_coverage", version, rows, p, ["matrix"])
    unread = [(5, "limitation", "coverage_applicability_unknown")]
    ambiguous = (1, "limitation", "coverage_position_ambiguous")
    unsure = [(k, "limitation", "coverage_mapping_unconfirmed") for k in (2, 3, 4)]
    assert names(1) == sorted([ambiguous, (1, "review", "specific_responsibility_missing"), *unsure, *unread])
    assert names(3) == sorted([ambiguous, *unsure, *unread])
    assert names(7) == sorted([ambiguous, unsure[0], (3, "violation", "responsibility_empty"), (4, "review", "responsibility_unit_unavailable"), *unread])
    assert names(7, {"confirmed_mappings": {"归口办": [{"department": "财务部", "position": "会计"}]}, "confirmed_aliases": {"主办": "会计"}})[1:] == names(7)[2:]
    assert {x[1] for x in names(7, {"unresolved_kind": "review"})} == {"review", "violation"}
    rule = {"responsibility_applicability": {"restrictions": [{"id": "r", "patterns": [".*(?:职员|会计)"], "entity_patterns": ["乙.*"]}], "known_entity_patterns": ["甲.*"]}}
    assert [x for x in names(8, rule) if x[0] in (1, 5)] == []
    assert {x[0] for x in names(8, rule) if x[2] == "responsibility_applicability_unresolved"} == {2, 3, 4}


def test_coverage_details_name_the_positions_of_a_department(spark):
    rows = [matrix(1, responsibility="某单位-财务部-主办、某单位-资金部-会计"), duty(2)]
    ctx = context(spark, rows)
    ctx.records = with_record_id(ctx.records)
    found = CHECKS["responsibility_coverage", 7](ctx, ctx.of_type("matrix"), {}).collect()
    details = json.loads(found[0]["evidence"])["mapping_details"]
    assert [(d["responsibility"], d["duty_positions"], d["department_candidates"]) for d in details] == [("某单位-财务部-主办", ["会计"], []), ("某单位-资金部-会计", [], ["财务部"])]


def test_ordered_records(spark):
    ids = ["X-1-控制措施1", "X-3-控制措施1", "X-2-控制措施1", "X-1-控制措施1"]
    found = run(spark, "ordered_records", 4, [duty(k + 1, measure_id=m) for k, m in enumerate(ids)], {"field": "measure_id"})
    assert [x[0] for x in found] == [1, 2, 3, 4, 4]


def test_records_unique_names_the_first(spark):
    rows = [duty(1), duty(2), duty(3, position="出纳")]
    assert run(spark, "records_unique", 1, rows, {"key_fields": ["entity_code", "measure_id", "position"]}) == [(2, "violation", "record_repeated")]


def test_applicability_values(spark):
    rows = [matrix(1, applicability=""), matrix(2, applicability="不适用"), matrix(3, applicability="不适用,本单位无此业务"), matrix(4, applicability="是否适用待定"), matrix(5), matrix(6, applicability="适用但部分不适用")]
    assert run(spark, "applicability_values", 2, rows, {"placeholders": ["无"]}) == [(1, "violation", "applicability_empty"), (2, "violation", "not_applicable_reason_empty"), (4, "limitation", "applicability_meaning_unresolved"), (6, "limitation", "applicability_meaning_unresolved")]


def test_other_row_checks(spark):
    rows = [matrix(1, responsibility="业务部门-会计", control_measure="登录旧平台"), duty(2, department="财务部")]
    assert run(spark, "responsibility_unit_specific", 1, rows, {"field": "responsibility", "generic_unit_names": ["业务部门"]}, ["matrix"]) == [(1, "violation", "responsibility_unit_not_concrete")]
    assert run(spark, "forbidden_reference", 1, rows, {"terms": ["旧平台"], "fields": ["control_measure"]}, ["matrix"]) == [(1, "violation", "forbidden_reference")]
    assert run(spark, "text_pattern", 1, rows, {"field": "responsibility", "patterns": ["部-"]}, ["matrix"]) == [(1, "violation", "pattern_missing")]
    assert run(spark, "responsibility_department_alignment", 1, rows, {"keyword_mappings": {"业务": ["营销"], "会计": ["财务"]}}, ["matrix"]) == [(1, "review", "responsibility_department_mismatch")]
    assert run(spark, "responsibility_applicability", 1, rows, {"restrictions": [{"id": "r", "patterns": [".*业务部门.*"], "entity_patterns": ["乙.*"]}], "known_entity_patterns": ["甲.*"]}, ["matrix"]) == [(1, "violation", "responsibility_applicability_conflict")]
    systems = [record("system_rule", 1, system_owner="国网总部", system_type=""), record("system_rule", 2, system_owner="某某分公司", system_type=""), record("system_rule", 3, system_owner="", system_type="三级部署系统")]
    assert run(spark, "system_type_preprocessing_notice", 1, systems) == [(2, "violation", "system_type_preprocessing_unresolved")]


def test_package_checks(spark):
    only_lists = [file(sheets=["position_duty"], material_type="three_lists")]
    assert run(spark, "sheet_exists", 1, [], {"sheet_types": ["incompatible_position"]}, files=only_lists) == [(0, "violation", "sheet_missing")]
    assert run(spark, "sheet_exists", 1, [], {"sheet_types": ["incompatible_position"]}, files=[file(sheets=["matrix"])]) == []
    wanted = {"material_types": ["matrix", "three_lists"]}
    assert run(spark, "required_documents", 4, [], wanted, files=only_lists) == []
    assert [x[2] for x in run(spark, "required_documents", 4, [], wanted, files=[])] == ["material_missing"] * 2
    versions = [file("a.xlsx", ["matrix"]), file("b.xlsx", ["matrix"])]
    assert [x[2] for x in run(spark, "required_documents", 4, [], wanted, files=versions)] == ["material_versions"]
    assert [x[2] for x in run(spark, "required_documents", 4, [], {"explanation_mode": True}, files=[])] == ["explanation_missing"]
    p = {"sheet_types": ["matrix"], "required_fields": ["measure_id", "carrier"], "expected_headers": ["编号", "编 号", "载体"]}
    assert [x[2] for x in run(spark, "schema_contains", 2, [], p, files=[file(sheets=["matrix"])])] == ["schema_field_mapping", "schema_header_missing"]


def test_every_version_plans(spark):
    params = {
        "fields": ["duty"], "field": "duty", "patterns": ["x"], "terms": ["x"], "key_fields": ["measure_id"], "source_field": "measure_id", "target_field": "measure_id", "target_record_type": "matrix", "group_by": ["measure_id"],
        "role_pairs": [["经办", "审核"]], "source_fields": ["carrier"], "placeholders": [], "restrictions": [], "generic_unit_names": [], "text_field": "duty", "mapping": {"经办": ["主体责任"]}, "attributes": ["x"], "sheet_types": ["matrix"],
    }
    ctx = context(spark, [], [])
    for f in {*CHECKS.values()}:
        assert f(ctx, ctx.records, params).schema.names[:3] == ["record_id", "kind", "issue_type"]


UNIT = "国网湖南省电力有限公司"
COUNTY = f"{UNIT}凤凰县供电分公司"
RULES = {
    "restrictions": [
        {"id": "province", "patterns": [r"省公司[-/][^-/,;、]+部(?:[-/][^-/,;、]+)?", r"省公司物资部(?:[-/][^-/,;、]+)?", r"国网[^-/;,、]+部(?:[-/][^-/,;、]+)?"], "entity_patterns": [UNIT]},
        {"id": "trading", "patterns": [r"北京电力交易中心(?:[-/][^-/,;、]+){0,2}"], "entity_patterns": []},
        {"id": "both", "patterns": ["省公司", "物资公司"], "required_patterns": ["省公司", "物资公司"], "entity_patterns": [UNIT, f"{UNIT}物资公司"]},
    ],
    "known_entity_patterns": [UNIT + ".+供电分公司(?:本部)?", "国网湖南省电力公司长沙培训服务部"],
}


def verdicts(spark, cases, config=RULES):
    """What a check makes of (unit, group, answer)."""
    rows = [matrix(k, entity=e, responsibility=text, applicability=answer) for k, (e, text, answer) in enumerate(cases)]
    ctx = context(spark, rows)
    ctx.records = with_record_id(ctx.records)
    units = {"P": UNIT, "C": COUNTY, "M": f"{UNIT}物资公司", "U": "尚未确认归属的中心", "T": "国网湖南省电力公司长沙培训服务部"}
    ctx.entities = spark.createDataFrame([(k, v, None, None, True) for k, v in units.items()], ctx.entities.schema)
    found = {r["row"]: r["kind"] for r in CHECKS["responsibility_applicability", 1](ctx, ctx.records, config).collect()}
    return [found.get(k) for k in range(len(cases))]


def test_restrictions_of_whole_groups(spark):
    no, yes = "否", "适用"
    own = f"{COUNTY}-财务部-主任"
    cases = [
        ("P", "省公司-财务部-主任", no, "violation"), ("P", "省公司/财务部/部门负责人", yes, None), ("C", "省公司-物资部", yes, "violation"), ("C", "国网财务部", "否", None), ("U", "北京电力交易中心-财务部", yes, "violation"), ("P", "省公司、物资公司", yes, None),
        ("M", "省公司\n物资公司", no, "violation"), ("C", "省公司；物资公司", no, None), ("C", "省公司；省公司", no, "limitation"), ("C", f"省公司-财务部；{own}", no, None), ("C", own, no, None), ("P", own, no, "limitation"),
        ("C", "省公司-财务部；未知公司-财务部", yes, "limitation"), ("C", "省公司-财务部；待确认", yes, "limitation"), ("C", "仅省公司-财务部", yes, "limitation"), ("C", "省公司-财务部-", yes, "limitation"), ("C", "", yes, "limitation"), ("U", "省公司-财务部", yes, "limitation"), ("X", "省公司-财务部", yes, "limitation"),
        ("C", "省公司-财务部", "可能适用", "limitation"), ("C", "省公司-财务部", "", "limitation"), ("C", "省公司-财务部", cell("", "formula_no_cache"), "limitation"), ("C", cell("", "formula_no_cache"), yes, "limitation"),
        ("T", "国网湖南省电力公司长沙培训服务部/财务部/主任", no, None), ("C", "县公司-财务部-主任", no, None), ("C", "县公司二号-财务部-主任", no, "limitation"), ("C", "两处-财务部", no, "limitation"),
    ]
    aliases = {"县公司": {"entity_code": "C", "confirmed": True}, "两处": {"entity_code": "C", "confirmed": True}, "两 处": {"entity_code": "P", "confirmed": True}, "未知公司": {"entity_code": "C", "confirmed": False}}
    got = verdicts(spark, [c[:3] for c in cases], RULES | {"entity_aliases": aliases})
    assert [(c[:2], g) for c, g in zip(cases, got) if g != c[3]] == []


def test_restrictions_that_conflict_or_cannot_be_read_decide_nothing(spark):
    case = [("P", "省公司-财务部-主任", "否")]
    more = RULES | {"restrictions": [*RULES["restrictions"], {"id": "other", "patterns": ["省公司-财务部-主任"], "entity_patterns": [COUNTY]}]}
    broken = [{"id": "a", "patterns": ["x"]}, {"id": "a", "patterns": ["x"], "entity_patterns": "y"}, {"id": "a", "patterns": "x", "entity_patterns": []}, {"id": "a", "patterns": ["["], "entity_patterns": []}, {"patterns": ["x"], "entity_patterns": []}, {"id": "a", "patterns": ["x"], "entity_patterns": [], "required_patterns": [1]}]
    assert [verdicts(spark, case, c) for c in (more, *({"restrictions": [r]} for r in broken), {"restrictions": []}, {})] == [["limitation"]] * 9


def test_answers_by_unit_and_header(spark):
    city = f"{UNIT}湘西供电分公司本部"
    cases = [
        (COUNTY, None, "市公司集中管控，县公司不适用", "not_applicable"), (city, None, "市公司集中管控，县公司不适用", None), (COUNTY, None, "可能市公司集中管控，县公司不适用", None), (COUNTY, None, "市公司集中管控，县公司不适用，但本单位仍适用", None),
        (COUNTY, None, "此条不适用县、支公司。", "not_applicable"), (None, None, "此条不适用县、支公司", None), (COUNTY, "适用层级", "地市及区县", "applicable"), (city, "适用 主体", "地市及区县", "applicable"), (COUNTY, None, "地市及区县", None), (UNIT, "适用层级", "地市及区县", None),
        (city, "适用层级", "地市本部、变电检修公司、输电检修公司、吉首支公司", "applicable"), (COUNTY, "适用层级", "地市本部、变电检修公司、输电检修公司、吉首支公司", None), (COUNTY, None, "否", "not_applicable"), (None, None, "适用", "applicable"), (COUNTY, None, "", None), (COUNTY, None, "直接引用", None),
    ]
    units = {name: f"U{k}" for k, name in enumerate(sorted({c[0] for c in cases if c[0]}))}
    ctx = context(spark, [matrix(k, entity=units.get(c[0], "none"), sheet=f"s{k}", applicability=c[2]) for k, c in enumerate(cases)])
    ctx.entities = spark.createDataFrame([(code, name, None, None, True) for name, code in units.items()], ctx.entities.schema)
    ctx.answer_headers = spark.createDataFrame([("f.xlsx", f"s{k}", c[1]) for k, c in enumerate(cases) if c[1]], "file_path string, sheet string, header string")
    got = {r["row"]: r["_a"]["decision"] for r in answered(ctx, wide(ctx.records, ["applicability"])).collect()}
    assert [c for k, c in enumerate(cases) if got[k] != c[3]] == []
