import copy

import pytest

from rulespark.plans import rollups
from rulespark.plans.engine import ordered, run_engine
from rulespark.plans.pack import PackError, activate, content_hash, difference, load_active, publish, select_rules, validate
from tests.records_fixture import cell, context, duty, file, matrix

MESSAGE = {"violation": "行{measure_id}：{issue_type}/{unknown}", "review": "请核实{issue_type}"}


def rule(code, operator, version, record_type, params=None, **more):
    check = {"check_id": f"c_{operator}", "operator": operator, "operator_version": version, "params": params or {}, "message": MESSAGE} | more
    return {"rule_id": f"r.{code}", "display_code": code, "enabled": True, "scope": {"record_type": record_type, "entity_codes": "*", "business_codes": "*"}, "checks": [check]}


def pack(*rules, **more):
    return {"submission_scope": {"entity_codes": ["205H"], "businesses": [{"business_code": "06"}]}, "rules": list(rules), "result_policy": {"version": 2}} | more


PACK = pack(
    rule("R05", "required_fields", 1, "position_duty", {"fields": ["department", "position"]}),
    rule("R15", "duplicate_duties", 2, "position_duty"),
    rule("R16", "measure_applicability_alignment", 3, "matrix"),
    rule("R06", "sheet_exists", 1, "package", {"sheet_types": ["incompatible_position"]}),
    rule("R99", "text_pattern", 1, "system_rule", {"field": "system_rule_name", "patterns": ["x"]}),
)


def test_findings_statuses_and_limitations(spark):
    rows = [duty(1), duty(2), duty(3, department="", position=cell("", "formula_no_cache")), matrix(4, applicability="不适用,无")]
    result = run_engine(PACK, context(spark, rows))
    found = [(r["display_code"], r["row"], r["severity"]) for r in ordered(result.findings).collect()]
    assert found == [("R06", None, "violation"), ("R15", 1, "violation"), ("R15", 2, "violation"), ("R05", 3, "violation"), ("R16", 4, "review")]
    status = {r["rule_id"]: (r["status"], r["records_considered"], r["findings"], r["limitations"]) for r in result.statuses.collect()}
    assert status == {"r.R05": ("partial", 3, 1, 1), "r.R15": ("executed", 3, 2, 0), "r.R16": ("executed", 1, 1, 0), "r.R06": ("executed", 1, 1, 0), "r.R99": ("scope_excluded", 0, 0, 0)}
    assert result.limitations.count() == 1 and not result.plan_errors
    assert "{unknown}" in result.findings.where("display_code = 'R15'").first()["message"]


def test_keys_are_stable_under_order_and_new_scopes(spark):
    rows = [duty(1), duty(2), matrix(4, applicability="不适用,无")]
    keys = lambda r: {x["finding_key"] for x in run_engine(PACK, context(spark, r)).findings.collect()}
    assert keys(rows) == keys(rows[::-1])
    assert keys(rows) <= keys([*rows, *(duty(k, entity="300A") for k in (7, 8))])


def test_overlay_switches_a_rule_off_in_one_scope(spark):
    rows = [duty(1), duty(2), duty(3, business="07"), duty(4, business="07")]
    off = pack(PACK["rules"][1], overlays=[{"path": "r.R15.enabled", "value": False, "scope": {"business_codes": ["06"]}, "priority": 1}])
    assert {r["row"] for r in run_engine(off, context(spark, rows)).findings.collect()} == {3, 4}


def test_overlay_changes_a_parameter(spark):
    base = pack(rule("R1", "text_pattern", 1, "position_duty", {"field": "duty", "patterns": ["主体"]}), overlays=[{"path": "r.R1:c_text_pattern.params.patterns", "value": ["没有"], "scope": {"entity_codes": ["300A"]}}])
    rows = [duty(1), duty(2, entity="300A")]
    assert {r["row"] for r in run_engine(base, context(spark, rows)).findings.collect()} == {2}


def test_on_unavailable_and_bad_parameters(spark):
    rows = [duty(1, department=None)]
    skip = pack(rule("A", "required_fields", 1, "position_duty", {"fields": ["department"]}, on_unavailable="skip"), result_policy=None)
    assert run_engine(skip, context(spark, rows)).findings.count() == 0
    fail = pack(rule("A", "required_fields", 1, "position_duty", {"fields": ["department"]}, on_unavailable="fail"), rule("B", "required_fields", 1, "position_duty", {}), result_policy=None)
    result = run_engine(fail, context(spark, rows))
    assert {r["rule_id"]: r["status"] for r in result.statuses.collect()} == {"r.A": "failed", "r.B": "failed"}
    assert [e[0] for e in result.plan_errors] == ["r.B"]


def test_deletion_explains_a_carrier(spark):
    rows = [matrix(1, carrier="付款单", control_measure=cell("核对", deleted=["台账"])), duty(2, duty="登记《台账》、《付款单》"), duty(3, duty="登记《名册》")]
    both = pack(
        rule("R12", "set_subset", 5, "position_duty", {"source_field": "carrier", "target_record_type": "matrix", "target_field": "carrier", "fallback_explicit_field": "duty"}),
        rule("R13", "deleted_text_reappears", 3, "position_duty", {"source_fields": ["control_measure"], "target_field": "duty"}),
    )
    found = run_engine(both, context(spark, rows)).findings.collect()
    assert sorted((r["row"], r["display_code"]) for r in found) == [(2, "R13"), (3, "R12")]


def test_rollups(spark):
    rows = [duty(1), duty(2), duty(3, department="", position=cell("", "formula_no_cache")), matrix(4, applicability="不适用,无")]
    ctx = context(spark, rows, [file(), file("bad.xlsx", parse_errors=["x"], entity="999Z")])
    result = run_engine(PACK, ctx)
    total = rollups.statistics(result.findings).where("entity_name IS NULL").first()
    assert total["opinions"] == 5
    assert {r["row"]: r["opinion"] for r in rollups.cell_opinions(result.findings).collect()}.keys() == {1, 2, 3, 4}
    assert rollups.review_tasks(result.findings).count() == 1
    assert rollups.root_causes(result.limitations).first()["cause"] == "field_source_unavailable"
    assert rollups.incomplete_items(ctx.files, result.statuses).count() == 1
    assert [r["reason"] for r in rollups.entity_alerts(ctx.files, ctx.entities).collect()] == ["not_on_roster"]
    assert rollups.capability_report(result.statuses, result.limitations).where("source > 0").count() == 1
    assert rollups.submission_scope(ctx.files).count() == 2
    assert rollups.snapshot(ctx.files, "h").first()["files"] == 2
    later = run_engine(select_rules(PACK, disable=["R15"]), ctx)
    assert {r["change"] for r in rollups.changes(result.findings, later.findings).collect()} == {"removed"}


def test_pack_store(tmp_path):
    publish(PACK, tmp_path, "1")
    publish(select_rules(PACK, disable=["R15"]), tmp_path, "2")
    assert [d["path"] for d in difference(PACK, select_rules(PACK, disable=["R15"]))] == ["rules[1].enabled"]
    assert sorted(r["display_code"] for r in load_active(tmp_path)["rules"] if not r["enabled"]) == ["R15"]
    activate(tmp_path, "1")
    assert all(r["enabled"] for r in load_active(tmp_path)["rules"])
    with pytest.raises(PackError, match="exists"):
        publish(PACK, tmp_path, "2")
    assert content_hash(PACK) == content_hash(copy.deepcopy(PACK)) != content_hash(select_rules(PACK, disable=["R15"]))


def test_validation_lists_every_fault():
    bad = pack(rule("A", "no_such", 1, "matrix"), rule("B", "text_pattern", 1, "package", {"patterns": ["("]}))
    with pytest.raises(PackError) as e:
        validate(bad)
    assert "no_such" in str(e.value) and "don't go together" in str(e.value) and "pattern" in str(e.value)
