"""Units, names, headers and candidates: the cases in which the evidence does not decide."""

import pytest
from pyspark.sql import functions as F

from rulespark.operators import evidence

ROSTER = "entity_code string, name string"


def test_units_are_voted_by_maximal_names(spark):
    roster = spark.createDataFrame([("A", "国网甲县供电公司"), ("B", "国网甲县供电公司物资分部"), ("C", "国网乙县供电公司"), ("D", "短名"), (None, "国网无码供电公司")], ROSTER)
    aliases = spark.createDataFrame([("甲供", "A"), ("乙供", "C"), ("", "C")], "alias string, entity_code string")
    texts = [
        (1, "材料/国网甲县 供电公司物资分部/a"), (2, "国网甲县供电公司物资分部"), (2, "由国网甲县供电公司报送"), (3, "国网甲县供电公司与国网乙县供电公司"), (4, "甲供材料"), (5, "甲供和乙供"), (6, "Ａ"), (7, "AB"), (8, None), (8, ""),
        (9, "国网甲县供电公司"), (9, "乙供"), (10, "国网甲县供电公司"), (10, "国网甲县供电公司"), (11, "短名"),
    ]
    out = evidence.voted_units(spark.createDataFrame(texts, "f int, t string"), "f", "t", roster, aliases).collect()
    got = {r["f"]: (r["entity_code"], len(r["evidence"]), r["conflict"]) for r in out}
    assert got == {1: ("B", 1, False), 2: (None, 2, True), 3: (None, 2, True), 4: ("A", 1, False), 5: (None, 2, True), 6: ("A", 1, False), 7: (None, 0, False), 8: (None, 0, False), 9: ("A", 1, False), 10: ("A", 1, False), 11: (None, 0, False)}
    assert evidence.voted_units(spark.createDataFrame([], "f int, t string"), "f", "t", roster, aliases).collect() == []


def test_terms_are_names_with_their_sources(spark):
    rows = [
        ("carrier", "1.《付款单》；2.合同（正本、副本）；无；对资料负主体责任；x", "U1", "06", "f1", True), ("carrier", "付 款单", "U2", "06", "f2", True), ("carrier", "台账", "U2", "07", "f3", True), ("carrier", "名册", "U1", "06", "f1", False),
        ("department", "财务部、审计部", "U1", "06", "f1", True), ("department", "请填写部门", "U1", "06", "f1", True), ("department", "=A1", "U1", "06", "f1", True), ("carrier", None, "U1", "06", "f1", True), ("carrier", "审核意见", None, "06", "f4", True), ("carrier", "付款单", None, None, "f5", True),
    ]
    cells = spark.createDataFrame(rows, "field string, text string, entity_code string, business_code string, source string, eligible boolean")
    got = {(r["field"], r["term"]): (r["spellings"], r["occurrences"], r["holdout_occurrences"], r["eligible_occurrences"], r["units"], r["first_sources"], r["status"]) for r in evidence.term_catalog(cells, ["U2"]).collect()}
    assert got == {
        ("carrier", "付款单"): (["付 款单", "付款单"], 3, 1, 2, 2, ["f1", "f2", "f5"], "recognition_only"), ("carrier", "合同(正本、副本)"): (["合同（正本、副本）"], 1, 0, 1, 1, ["f1"], "recognition_only"),
        ("carrier", "台账"): (["台账"], 1, 1, 0, 1, ["f3"], "candidate_only"), ("carrier", "名册"): (["名册"], 1, 0, 0, 1, ["f1"], "candidate_only"), ("department", "财务部、审计部"): (["财务部、审计部"], 1, 0, 1, 1, ["f1"], "recognition_only"),
    }


def test_headers_that_a_template_has_otherwise(spark):
    columns = "relative_path string, sheet string, t int, coordinate string, path array<string>"
    actual = spark.createDataFrame([("f", "s", 1, "A1", ["组", "编 号"]), ("f", "s", 1, "B1", ["名称"]), ("f", "s", 1, "D1", ["多出"]), ("g", "s", 2, "A1", [])], columns)
    expected = spark.createDataFrame([(1, "A1", ["组", "编号"]), (1, "B1", ["组", "名称"]), (1, "C1", ["备注"]), (3, "A1", ["无"])], "t int, coordinate string, path array<string>")
    got = sorted((r["sheet"], r["coordinate"], r["expected_path"], r["actual_path"]) for r in evidence.header_changes(actual, expected, ["t"]).collect())
    assert got == [("s", "B1", ["组", "名称"], ["名称"]), ("s", "C1", ["备注"], None)]


@pytest.mark.parametrize(
    "a, b, reasons",
    [
        ("三级职员", "3级职员", []), ("三级职员", "四级职员", ["grade"]), ("十一级职员", "11级职员", []), ("二十级职员", "20级职员", []), ("副主任", "主任", ["deputy"]), ("副主任", "副经理", []), ("经办会计", "审核会计", ["role"]),
        ("会计", "不负责会计", ["denial"]), ("资金专责", "预算专责", ["function"]), ("资金预算专责", "预算专责", []), ("会计", "出纳", []),
    ],
)
def test_positions_that_cannot_be_one(spark, a, b, reasons):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(evidence.position_conflicts(F.col("a"), F.col("b")).alias("x"), evidence.position_conflicts(F.col("b"), F.col("a")).alias("y")).first()
    assert list(row["x"]) == list(row["y"]) == reasons


def test_candidates_are_rejected_before_they_are_scored(spark):
    vector = {"会计": [1.0, 0.0], "核算会计": [0.8, 0.6], "出纳": [0.0, 1.0], "财务部": [1.0, 0.0], "财会室": [0.6, 0.8], "审计部": [0.6, 0.8]}
    asked = [(1, "财务部-会计", "m"), (2, "甲公司-会计", "m"), (3, "甲公司-财务部-会计", "m"), (4, "乙公司-财务部-会计", "m"), (5, "财务部-会计、出纳", "m"), (6, "财务部", "m"), (7, "财务部-会计", ""), (8, "财务部-会计", "n")]
    queries = spark.createDataFrame([(k, t, s, vector["会计"], vector["财务部"]) for k, t, s in asked], "query long, text string, m string, position_vector array<double>, department_vector array<double>")
    listed = [(10, "财务部", "会计"), (11, "财会室", "会计"), (12, "审计部", "会计"), (13, "财务部", "核算会计"), (14, "财务部", "出纳"), (15, "", "会计"), (16, "甲公司-财务部", "会计"), (17, "乙公司-财务部", "会计"), (18, "财务部、审计部", "会计")]
    rows = [(c, d, p, "m", vector.get(d, [1.0, 0.0]), vector[p]) for c, d, p in listed]
    candidates = spark.createDataFrame(rows, "candidate long, department string, position string, m string, department_vector array<double>, position_vector array<double>")
    out = evidence.structured_candidates(queries, candidates, ["m"], names=["甲公司"]).collect()
    found = sorted((r["query"], r["rank"], r["candidate"], r["score"], r["ambiguous"]) for r in out if r["reason"] is None)
    first = [(1, 10, 1.0, True), (2, 16, 1.0, False), (3, 11, 0.88, False)]
    assert found == [(q, *x) for q in (1, 3) for x in first]
    assert {r["query"]: r["reason"] for r in out if r["reason"]} == {2: "no_department", 4: "foreign_unit", 5: "several", 6: "structure", 7: "scope", 8: "no_candidate"}
