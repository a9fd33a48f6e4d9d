"""The rule set in force, as a pack: the rules that are on, with their operators, versions and parameters.

Messages name the rule and say what to look at.  Rules of the set that are
switched off are left out; ``select_rules`` switches those that are here.
"""

from __future__ import annotations

import re
from typing import Any

from rulespark.functions.keys import norm_literal
from rulespark.plans.pack import Pack, validate

# Words that name no concrete department.
DEPARTMENTS = """
各级单位、管理部门、实施部门、各部门、需求部门、用工部门、归口管理部门、会签部门、实物资产、资产使用、委托、
项目管理部门、项目建设部门、待定、项目承担部门、项目需求部门、各级单位-项目管理部门/建设单位、牵头部门、
牵头管理部门、实物资产管理部门、建设管理部门、使用保管部门、专业管理部门、用工管理部门、食堂经费管理部门、
职工教育经费管理部门、职工体检实施部门、资金发起部门、会议承办部门、接待承办部门、办公用品管理部门、公务车辆管理部门
""".replace("\n", "").split("、")

# Words that name no concrete position.
POSITIONS = """
某某、待定、人员、管理人员、实施人员、需求人员、用工人员、归口管理人员、会签人员、实物资产、资产使用、委托、
项目管理人员、项目建设人员、项目承担人员、项目需求人员、相关人员、采购人员、资产使用保管人员、保管人员、接待人员、
承接人员、出差人员、报账人员、部门负责人、需求审核人员、合同签订人员、合同经办人员、合同管理人员、合同审核人员、
合同结算人员、往来管理人员、使用保管人员、收货人员、需求提报人、负责人、监督人员、领料人员、审批人员、复核人员、
审核人员、柜收人员、签订人员、监控人员、装表人员、勘查人员、办理人员、核算人员、受理人员、收费人员、收取人员、
结算人员、财务人员、技经人员、规划人员、合规人员、计划人员、前期人员、招标人员、需求提报人员、物资上架人员、
履约人员、物资调拨人员、经办人员、匹配人员、项目负责人、出差报销审核人
""".replace("\n", "").split("、")

# Names that are concrete although they hold such a word.
DEPARTMENT_PREFIXES = ["归口管理部门（党委", "其他福利实施部门（党委组织"]
POSITION_PARTS = ["查勘人员", "专责", "负责人-", "班长", "值长", "计量工作负责人"]

# What fills a cell without saying anything.
FILLERS = ["无", "-", "/"]
PERSON_PATTERN = r"等|…|\.{3}|待定"

# The qualities for which a duty answers, and the responsibility of each role.
QUALITIES = ["一致性", "准确性", "真实性", "完整性", "有效性", "及时性", "合规性"]
RESPONSIBILITIES = {"经办": ["主体责任"], "审核": ["审核责任"], "审批": ["审批责任"]}


def _holding(words: list[str]) -> str:
    """A pattern of cells that hold one of the words, alone or within a longer name."""
    return f"(?:{'|'.join(re.escape(norm_literal(w)) for w in dict.fromkeys(words) if w)})"


def _rule(code: str, rule_id: str, record_type: str, *checks: tuple[str, str, int, dict[str, Any], str]) -> dict[str, Any]:
    listed = [
        {"check_id": check_id, "operator": operator, "operator_version": version, "params": params, "on_unavailable": "review", "message": {"violation": text, "review": text}}
        for check_id, operator, version, params, text in checks
    ]
    return {"rule_id": rule_id, "display_code": code, "enabled": True, "scope": {"record_type": record_type, "entity_codes": "*", "business_codes": "*"}, "checks": listed}


def _constraint(field: str, words: list[str], pattern: str, **exceptions: list[str]) -> dict[str, Any]:
    return {"field": field, "placeholders": [*words, *FILLERS], "placeholder_patterns": [pattern], "separators": [], **exceptions}


def specific_departments() -> dict[str, Any]:
    """Parameters of the check that departments are concrete."""
    return _constraint("department", DEPARTMENTS, _holding(DEPARTMENTS), prefix_exceptions=DEPARTMENT_PREFIXES, contains_exceptions=[])


def specific_positions() -> dict[str, Any]:
    """Parameters of the check that positions are concrete."""
    return _constraint("position", POSITIONS, _holding(POSITIONS), prefix_exceptions=[], contains_exceptions=POSITION_PARTS)


def active_pack(entity_codes: list[str], businesses: list[dict[str, Any]]) -> Pack:
    """The rules in force for a submission of these entities and businesses (see ``submission_scope`` of a pack)."""
    deleted = {"source_fields": ["control_measure", "carrier"], "target_field": "duty", "match_scope": "measure"}
    gone = "【第9条】矩阵中对应的措施或载体已删除，请核对岗位职责描述是否规范。"
    # Codes, ids and message texts of the rules.
    rules = [
        _rule(
            "R01", "documents.completeness", "package",
            ("material_complete", "required_documents", 3, {"material_types": ["matrix", "three_lists"]}, "【第1条】请核对材料：{missing_material}"),
            ("file_naming", "required_documents", 4, {"naming_mode": True, "require_entity_name": False}, "【第1条】请核对文件名称：{naming_issue}"),
        ),
        _rule("R02", "entities.explanation", "package", ("entity_difference_explanation", "required_documents", 1, {"material_types": [], "explanation_mode": True}, "【第2条】主体差异缺少可归属的Word说明。")),
        _rule(
            "R05", "duties.completeness", "position_duty",
            ("department_specific", "field_constraints", 6, specific_departments(), "【第5条】部门应具体。"),
            ("position_specific", "field_constraints", 6, specific_positions(), "【第5条】岗位名称应具体。"),
            ("person_required", "field_constraints", 4, _constraint("person_names", [], PERSON_PATTERN), "【第5条】应具体到人员。"),
        ),
        _rule("R06", "lists.incompatible_exists", "package", ("incompatible_sheet_exists", "sheet_exists", 1, {"sheet_types": ["incompatible_position"]}, "【第6条】三清单缺少不相容岗位清单。")),
        _rule("P01", "preprocessing.system_type_notice", "system_rule", ("system_type_preprocessing_notice", "system_type_preprocessing_notice", 1, {}, "【预处理】请补充系统类型，该列填报枚举值：一级部署系统、二级部署系统、三级部署系统，请根据系统的实际情况填报。")),
        _rule("R08", "duties.separation", "position_duty", ("handler_reviewer_overlap_0916", "roles_same_duty", 4, {}, "【第8条】经办与审核应由不同人员承担：{conflict_people}")),
        _rule(
            "R09", "references.duty", "position_duty",
            ("measure_in_matrix", "reference_exists", 2, {"source_field": "measure_id", "target_record_type": "matrix", "target_field": "measure_id"}, "【第9条】请核对矩阵中的措施：{reference}"),
            ("deleted_text_in_duty_0916", "deleted_text_reappears", 3, deleted, gone),
        ),
        _rule("R09", "references.deleted_in_incompatible_duty", "incompatible_position", ("deleted_text_in_duty_0916", "deleted_text_reappears", 3, deleted, gone)),
        _rule("R10", "duties.responsibility_phrase", "position_duty", ("broad_responsibility_pattern", "responsibility_phrase", 9, {"attributes": QUALITIES}, "【第10条】岗位职责请按照国网标准句式编制。")),
        _rule("R11", "duties.role_mapping", "position_duty", ("explicit_role_responsibility", "value_mapping", 5, {"source_field": "role", "text_field": "duty", "mapping": RESPONSIBILITIES}, "【第11条】经办对应主体责任、审核对应审核责任、审批对应审批责任。")),
        _rule("R15", "duties.duplicate_rows", "position_duty", ("duplicate_duties", "duplicate_duties", 2, {}, "【第15条】重复项保留一个即可。")),
        _rule("R16", "matrices.measure_applicability", "matrix", ("measure_applicability_alignment", "measure_applicability_alignment", 3, {}, "【第16条】请结合业务实际再次核实适用性。")),
    ]
    return validate({"submission_scope": {"entity_codes": entity_codes, "businesses": businesses}, "rules": rules, "result_policy": {"version": 2}})
