"""The rule set in force, end to end over a small submission."""

from rulespark.operators.checks import CHECKS
from rulespark.plans.active_rules import active_pack, specific_departments, specific_positions
from rulespark.plans.engine import run_engine
from rulespark.plans.pack import load_active, publish
from tests.records_fixture import cell, context, duty, file, matrix, record

PHRASE = "对真实性负主体责任"


def test_rules_in_force(spark, tmp_path):
    pack = active_pack(["205H"], [{"business_code": "06"}])
    publish(pack, tmp_path, "1")
    assert sorted(r["rule_id"] for r in load_active(tmp_path)["rules"]) == sorted(r["rule_id"] for r in pack["rules"])
    rows = [
        matrix(1, control_measure=cell("核对", deleted=["旧台账"])),
        matrix(2, measure_id="X-1-控制措施2", applicability="不适用,无"),
        duty(3, duty=f"依据旧台账{PHRASE}"),
        duty(4, person_names="乙", department="归口管理部门", position="变电班长"),
        duty(5, person_names="乙等", measure_id="X-1-控制措施2"),
        duty(6, person_names="丙", measure_id="X-1-控制措施9", duty="做账", role="审批"),
        record("system_rule", 7, system_owner="", system_type=""),
    ]
    files = [file("矩阵.xlsx", ("matrix",)), file("三清单.xlsx", ("position_duty",), material_type="three_lists")]
    result = run_engine(pack, context(spark, rows, files))
    assert not result.plan_errors
    found = {(r["display_code"], r["check_id"], r["row"]) for r in result.findings.collect()}
    assert found >= {
        ("R05", "department_specific", 4), ("R05", "person_required", 5), ("R06", "incompatible_sheet_exists", None), ("P01", "system_type_preprocessing_notice", 7),
        ("R09", "deleted_text_in_duty_0916", 3), ("R09", "measure_in_matrix", 6), ("R10", "broad_responsibility_pattern", 6), ("R11", "explicit_role_responsibility", 6), ("R16", "measure_applicability_alignment", 2),
    }
    assert not {x for x in found if x[0] in ("R01", "R02", "R08", "R15") or x[1] == "position_specific"}


def test_vague_words_within_longer_names(spark):
    cells = {
        "department": [("物资采购部", False), ("合同归口管理部门", True), ("财务管理部门", True), ("归口管理部门（党委办公室）", False), ("其他福利实施部门（党委组织部）", False), ("外包归口管理部门（党委办公室）", True), ("甲公司-财务部", False), ("/", True)],
        "position": [("物资采购人员", True), ("营销部管理人员", True), ("项目建设人员（兼岗）", True), ("现场查勘人员", False), ("采购人员专责", False), ("部门负责人-综合管理人员", False), ("运行班长（管理人员）", False), ("通信值长人员", False), ("会计", False)],
    }
    for name, params in (("department", specific_departments()), ("position", specific_positions())):
        rows = [duty(k, **{name: text}) for k, (text, _) in enumerate(cells[name])]
        ctx = context(spark, rows)
        found = {r["row"] for r in CHECKS["field_constraints", 6](ctx, ctx.records, params).collect()}
        assert found == {k for k, (_, vague) in enumerate(cells[name]) if vague}
