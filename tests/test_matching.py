import io
import zipfile

from pyspark.sql import functions as F

from rulespark.functions.keys import measure_key
from rulespark.operators.checks import CHECKS
from rulespark.operators.matching import rejected_candidates, split_labels
from rulespark.plans.records import with_record_id
from rulespark.sources import sheets
from tests.records_fixture import context, duty

CELLS = "relative_path string, sheet string, hidden boolean, row int, col int, current string, state string, error string"
HEADERS = "relative_path string, sheet string, header_row int, record_type string, columns map<string,int>"


def test_sheets(spark):
    body = ["适用", "不适用,无此业务", "待定"]
    rows = [("a", "岗位", False, 1, 1, "编号", "value", None)] + [("a", "岗位", False, k + 2, 3, t, "value", None) for k, t in enumerate(body)]
    rows += [("a", "岗位", False, k + 2, 4, n, "value", None) for k, n in enumerate(["甲公司", "甲公司", "乙公司"])] + [("a", "旧岗位", True, 1, 1, "x", "value", None), ("b", None, None, 0, 0, None, None, "broken")]
    cells = spark.createDataFrame(rows, CELLS)
    headers = spark.createDataFrame([("a", "岗位", 1, "position_duty", {"measure_id": 1}), ("a", "旧岗位", 1, "position_duty", {"measure_id": 1})], HEADERS)
    assert [(r["col"], r["answers"]) for r in sheets.answer_columns(cells, headers).collect()] == [(3, 2)]
    roster = spark.createDataFrame([("1", "甲公司"), ("2", "乙公司")], "entity_code string, name string")
    assert sheets.owner_evidence(cells, roster).collect() == []
    assert [r["entity_code"] for r in sheets.owner_evidence(cells, roster, least_share=0.6).collect()] == ["1"]
    assert [r["sheet"] for r in sheets.hidden_sheets(cells).collect()] == ["旧岗位"]
    assert [r["error"] for r in sheets.unread_files(cells).collect()] == ["broken"]
    assert [r["sheet"] for r in sheets.current_sheets(headers, cells).collect()] == ["岗位"]
    files = spark.createDataFrame([("a", "d1")], "relative_path string, sha256 string")
    fixed = spark.createDataFrame([("d1", "岗位", "duty", 7), ("d9", "岗位", "role", 8)], "sha256 string, sheet string, field string, col int")
    assert {r["sheet"]: r["columns"] for r in sheets.with_overrides(headers, fixed, files).collect()} == {"岗位": {"measure_id": 1, "duty": 7}, "旧岗位": {"measure_id": 1}}


def test_explanations(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", '<d xmlns="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><p><t>一</t><t>二</t></p><p><t>三</t></p><p><t>四</t></p></d>')
    files = spark.createDataFrame([("a", "docx", bytearray(out.getvalue())), ("b", "docx", bytearray(b"no"))], "relative_path string, true_format string, content binary")
    assert {r["relative_path"]: r["text"] for r in sheets.explanation_texts(files, 2).collect()} == {"a": "一二\n三", "b": None}


def test_baseline_decides_the_order(spark):
    order = sheets.baseline_order(spark, [{"business_id": "06", "measure_order": ["X-2-控制措施1", "X-1-控制措施1"]}])
    ctx = context(spark, [duty(1, measure_id="X-2-控制措施1"), duty(2, measure_id="X-1-控制措施1"), duty(3, measure_id="X-9-控制措施1")])
    ctx.records = with_record_id(ctx.records)
    free = CHECKS["ordered_records", 4](ctx, ctx.records, {"field": "measure_id"})
    assert sorted(r["row"] for r in free.collect()) == [1, 2]
    ctx.baseline_order = order
    ranked = CHECKS["ordered_records", 4](ctx, ctx.records, {"field": "measure_id"})
    assert [(r["row"], r["issue_type"]) for r in ranked.collect()] == [(3, "order_reference_unresolved")]


def test_labels_and_conflicts(spark):
    rows = spark.createDataFrame([("1、编号缺失；2、职责重复。",), ("其他",), (None,)], "t string")
    assert sorted((r["item"], r["label"]) for r in split_labels(rows, "t", {"missing": "缺失", "repeat": "重复"}).collect()) == [("其他", "other"), ("编号缺失", "missing"), ("职责重复。", "repeat")]
    pairs = spark.createDataFrame([("副主任", "主任"), ("会计", "出纳")], "a string, b string")
    assert [r["conflicts"] for r in rejected_candidates(pairs, "a", "b", {"deputy": ("^副", "^[^副]")}).collect()] == [["deputy"], []]


def test_measure_keys_are_equal_by_number_only(spark):
    keys = spark.createDataFrame([("ABC-3甲-控制措施12",), ("Z-3-控制措施12",)], "m string").select(measure_key(F.col("m")).alias("k")).collect()
    assert keys[0]["k"] == keys[1]["k"] == [3, 12]
