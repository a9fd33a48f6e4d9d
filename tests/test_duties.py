"""Responsibility facts: what each version of the two checks makes of a text."""

import re

import pytest
from pyspark.sql import functions as F

from rulespark.functions import duties
from rulespark.operators.checks import CHECKS
from rulespark.plans.records import with_record_id
from tests.records_fixture import cell, context, duty

ATTRIBUTES = ["准确性", "完整性", "真实性", "一致性", "合规性", "匹配性", "规范性"]
MAPPING = {"source_field": "role", "text_field": "duty", "mapping": {"经办": ["主体责任"], "审核": ["审核责任"], "审批": ["审批责任"]}}


def outcomes(spark, name, version, cases, attributes=ATTRIBUTES):
    """(kind, issue type) or None of each (role, text)."""
    rows = [duty(k + 1, role=role, duty=text) for k, (role, text) in enumerate(cases)]
    ctx = context(spark, rows)
    ctx.records = with_record_id(ctx.records)
    found = CHECKS[name, version](ctx, ctx.records, MAPPING if name == "value_mapping" else {"attributes": attributes})
    said = {r["row"]: (r["kind"], r["issue_type"].removeprefix("responsibility_")) for r in found.collect()}
    return [said.get(k + 1) for k in range(len(cases))]


V, R = "violation", "review"

PHRASE = {
    1: [("对资料的真实性负主体责任", None), ("对资料的真实性不负主体责任", (V, "phrase_missing")), ("对材料完整性负责。", (V, "phrase_missing")), ("不对资料的真实性负主体责任", (V, "phrase_missing")), ("对资料齐全情况负主体责任", (V, "phrase_missing"))],
    2: [("对材料完整性负责。", None), ("不需要对材料完整性负责", (V, "phrase_missing")), ("对完整性、真实性负责", (V, "phrase_missing")), ("对材料完整负责", (V, "phrase_missing")), ("核对比完整性负责", (V, "phrase_missing"))],
    3: [("对材料完整负责", None), ("不对材料完整负责", (V, "phrase_missing"))],
    4: [("国网商城上架商品与物流信息一致性具有审核责任。", None), ("对发票开具的完整性、合规性具有审核责任。", None), ("对部门员工出差内容具有审核责任。", (V, "phrase_missing")), ("对合同的准确性不具有审核责任。", (V, "phrase_missing")),
        ("对合同的完整性没有审核责任。", (V, "phrase_missing")), ("本岗位无需对合同准确性承担审核责任。", (V, "phrase_missing")), ("负责审核合同。", (V, "phrase_missing"))],
    5: [("对按照财务业务流程要求，做好报销审核、检查材料完备负有审核责任。", None), ("发票提交人负有落实发票验真的主体责任。", None), ("对落实发票验真负主体责任。", None), ("对合同真实性、对台账准确性负审核责任。", None),
        ("对核对合同与发票一致性负审核责任。", None), ("对材料完整性负责。", None), ("对技术规范书的完整性负有审核责任。", None), ("对合同准确性没有审核责任。", (V, "assertion_missing")), ("本岗位无需对合同准确性承担审核责任。", (V, "assertion_missing")),
        ("负责审核合同。", (V, "assertion_missing")), ("发票验真。", (V, "assertion_missing")), ("对赴异地挂职发起出差申请，按照规定选择成本中心负有主体责任。", (V, "quality_missing")),
        ("参与验收，核对实物性能、技术规范，对接收设备的质量和资料负责。", (V, "quality_missing")), ("对合同的准确性承担未知句式审核责任。", (R, "structure_unresolved")), ("对附件完整性负有审核在责任。", (R, "structure_unresolved"))],
    6: [("供应商对报告的准确性负有主体责任，本岗位负责转交材料。", (V, "other_actor")), ("对报告的准确性负有主体责任，但本岗位不承担上述责任。", (V, "self_contradiction")), ("对报告的准确性负有主体责任。本岗位不承担主体责任。", (V, "self_contradiction")),
        ("本岗位对报告的准确性负有审核责任。", None), ("供应商对报告的准确性负有主体责任，本岗位对资料完整性负有审核责任。", None), ("对供应商提供资料的准确性负有审核责任。", None), ("对报告准确性负有审核责任，但本岗位不承担审批责任。", None),
        ("参照“供应商对准确性负有主体责任”的说明，本岗位对资料完整性负有审核责任。", None), ("参照“本岗位不承担上述责任”的历史说明，本岗位对资料完整性负有审核责任。", None), ("监督其他部门承担审批责任，对合同真实性承担审核责任。", None),
        ("负责按业票审核批次发起付款申请，准确匹配授权审批流程。对匹配准确性负有主体责任。", None), ("对准确性负有主体责任。", (R, "structure_unresolved")), ("负责对分包管理要求落实情况负有审核责任。", (V, "quality_missing")),
        ("对附件完整性负有审核在责任。", (V, "expression_malformed")), ("对做好报销审核。按照财务业务流程要求，做好报销审核、检查材料完备审核责任。", (V, "expression_malformed")), ("对需求论证项目情况主体责任", (V, "expression_malformed")),
        ("对合同的准确性承担未知句式审核责任。", (R, "structure_unresolved")),
        ("对本单位采抄管理，对采集结果真实性、准确性，对采集异常结果进行核实；对异常数据进行补抄或拟合负有主体责任。", None), ("对及时办理履约单据，确保项目进度与开票进度一致；配合物资管理部门进行长期挂账款项的原因核实，出具相关证明材料负有主体责任。", None),
        ("对确认领料需求单的准确性、真实性。负有审核责任。", None), ("对合同条款负有审核责任，确保条款合规。", None), ("对合同条款负有审核责任，确保合同不准确。", (R, "structure_unresolved")), ("对合同条款负有审核责任。其他部门确保条款合规。", (V, "quality_missing")),
        ("对合同条款负有审核责任，确保条款合规、收益不流失。", None), ("对合同条款负有审核责任，确保合同是否真实、准确。", (R, "structure_unresolved")), ("“合同签订时明确知识产权权属”的要求（如审核合同中权属条款、专利技术归属约定）负有审核责任，确保“转化条款合规、收益不流失。", None),
        ("对做好会议过程管控负有主体责任。①做好会议筹备。②规范会议组织。③规范会议报销。", (V, "quality_missing")), ("对物业管理费用的数量、质量具有审核责任评价，对计费周期、收费标准一致性复核。", (V, "quality_missing")),
        ("对规范管理咨询费列支间接费用；最后一笔经费支出不得低于合同总额的10%负有主体责任。", (V, "quality_missing")), ("对车辆费用准确性负进行复核；对保险费归口负有审核责任。", (V, "expression_malformed")),
        ("盘点过程中要复核设备资产管理责任落实情况，及时更新资产使用保管人、运维单位等信息。", (V, "assertion_missing")), ("建设单位安全费归口管理部门负责人对安全费管控付全面责任，把关安全费支付的及时性。", (V, "expression_malformed")),
        ("对虚列成本费用、套取资金私设“小金库”的违规行为承担全部责任，并依规接受追责处理。", (V, "quality_missing"))],
    7: [(t, None) for t in ("负主体责任", "本岗位负审核责任", "对资料负审批责任", "对资料完整负责", "对资料完整性承担审核责任", "其他人员负主体责任而由本岗位负审核责任", "参照“并非本岗位”说明，本岗位负审核责任", "本岗位不承担主体责任，而本岗位负审核责任",
                            "供应商不承担审核责任，本岗位负主体责任", "并非本岗位负主体责任；本岗位负审核责任", "本岗位未曾承担审核责任，但本岗位负主体责任", "本部门对资料完整性负审核责任")]
       + [(t, (V, "phrase_missing")) for t in ("不负主体责任", "由供应商负主体责任", "负责审核资料", "负主体责任；本岗位不承担主体责任", "本岗位不应负主体责任", "本岗位不应该承担审核责任", "负主体责任，本岗位不应承担主体责任", "其他相关方对资料完整性负审核责任",
                                               "其他公司对资料完整性负主体责任", "相关方对资料完整性负审核责任", "本岗位不承担主体责任，而由供应商负审核责任", "其他人员负主体责任", "并非本岗位负主体责任")]
       + [(t, (R, "phrase_missing")) for t in ("并非只有本岗位负主体责任", "本岗位是否负主体责任", "责任承担方负主体责任", "并非本岗位不负主体责任", "本岗位并非不承担主体责任", "建设部负主体责任", "建设部对资料完整性负主体责任")],
    8: [("负主体责任", (V, "phrase_missing")), ("负责采购", (V, "phrase_missing")), ("价格管理人员对智慧共享财务平台中发电机组状态的调整的准确性、及时性负有主体责任。", None), ("本岗位是否对资料完整性负主体责任", (V, "phrase_missing"))],
    9: [("真实性，主体责任", None), ("真实性", (V, "phrase_missing"))],
}

ROLE = {
    1: [("经办", "负主体责任", None), ("审核", "不负审核责任", None), ("审核", "负主体责任", (V, "role_missing")), ("审核", "主体责任和审核责任", (R, "multiple_types")), ("督办", "负主体责任", (R, "role_unresolved"))],
    2: [("经办", "发票提交人负有落实发票验真的主体责任。", None), ("审核", "对费用准确性負审核责任。", (R, "role_unresolved")), ("审核", "对附件完整性负有审核在责任。", (R, "role_unresolved")), ("审批", "对营销退费管理，明确分级分类审批标准及系统建设负有审核责任。", (V, "role_conflict")),
        ("经办", "对出差申请单人员地点的真实性负责。", (V, "role_missing")), ("审核", "本岗位不承担审批责任，对合同真实性承担审核责任。", None), ("审核", "参照“承担审批责任”的说明，对合同真实性承担审核责任。", None), ("审核", "监督其他部门承担审批责任，对合同真实性承担审核责任。", (R, "role_unresolved")),
        ("审核", "对合同承担主体责任，对台账承担审核责任。", (R, "multiple_types")), ("审核", "对合同真实性没有审核责任。", (V, "role_missing")), ("审核", "对发票真实性具有复核责任，对购物清单负有审核责任。", None), ("审核", "负责对分包管理要求落实情况负有审核责任。", (R, "role_unresolved"))],
    3: [("审核", "负责对分包管理要求落实情况负有审核责任。", None), ("审核", "本岗位要求供应商落实审核责任。", (R, "role_unresolved")), ("经办", "其他部门对报告的准确性负有主体责任，本岗位负责转交材料。", (V, "other_actor")), ("经办", "对报告的准确性负有主体责任。本岗位不承担主体责任。", (V, "self_contradiction")),
        ("审核", "对附件完整性负有审核在责任。", (V, "expression_malformed")), ("审核", "监督其他部门承担审批责任，对合同真实性承担审核责任。", None)],
    4: [("经办", "负主体责任", None), ("审批", "本岗位承担未知句式审批责任", (R, "role_unresolved")), ("审核", "负主体责任", (V, "role_conflict")), ("审核", "负审核责任并承担主体责任", (R, "multiple_types")), ("", "负主体责任", None), ("审核", "不负审核责任", (V, "role_missing")),
        ("审核", "由供应商承担审核责任", (V, "other_actor")), ("审核", "负责审核资料", (V, "role_missing")), ("审核", "由其他岗位负审核责任", (V, "other_actor")), ("审核", "由建设部承担审核责任", (R, "role_unresolved")), ("审核", "本岗位不承担主体责任，而由供应商负审核责任", (V, "other_actor")),
        ("经办", "并非本岗位负主体责任", (V, "role_missing")), ("审核", "本岗位不承担主体责任，而本岗位负审核责任", None), ("经办", "并非本岗位不负主体责任", (R, "role_unresolved")), ("经办", "建设部对资料完整性负主体责任", (R, "role_unresolved")), ("经办", "对资料真实性负主体责任和审核责任", (R, "role_unresolved"))],
    5: [("经办", "对资料真实性负主体责任和审核责任", None), ("经办", "对资料真实性负主体责任；对台账负审核责任", None), ("审批", "对资料真实性负主体责任；对台账负审核责任", (R, "multiple_types")), ("经办", "负主体责任；本岗位不承担主体责任", (V, "self_contradiction"))],
}


@pytest.mark.parametrize("version", PHRASE)
def test_phrase_by_version(spark, version):
    texts, expected = zip(*PHRASE[version])
    got = outcomes(spark, "responsibility_phrase", version, [("经办", t) for t in texts])
    assert [x for x in zip(texts, got, expected) if x[1] != x[2]] == []


@pytest.mark.parametrize("version", ROLE)
def test_role_by_version(spark, version):
    got = outcomes(spark, "value_mapping", version, [x[:2] for x in ROLE[version]])
    assert [(*x, y) for x, y in zip(ROLE[version], got) if x[2] != y] == []


def test_cells_without_a_readable_duty(spark):
    for version in (1, 5, 7, 9):
        rows = [("经办", None), ("经办", cell("", "formula_no_cache")), ("经办", "")]
        assert outcomes(spark, "responsibility_phrase", version, rows) == [(R, "unavailable")] * 2 + [(V, "phrase_missing") if version == 1 else None]
    for version in (2, 3, 4, 5):
        assert outcomes(spark, "value_mapping", version, [("经办", None), ("", "负主体责任"), (None, "负主体责任"), ("经办", "")]) == [(R, "unavailable"), *[(R, "role_unresolved") if version < 4 else None] * 2, None]


def test_occurrences_equal_finditer(spark):
    texts = ["对甲负责，负主体责任。承担审核责任", "", "无", "😀负责😀负有审核责任", "负责负责负责"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", duties.occurrences(F.col("t"), duties.PREDICATE).alias("found")).collect()
    for r in rows:
        assert [(m["start"], m["end"], m["text"]) for m in r["found"]] == [(m.start(), m.end(), m[0]) for m in re.finditer(duties.PREDICATE, r["t"])]
