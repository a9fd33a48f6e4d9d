import io
import re
import subprocess
import sys
import zipfile
from pathlib import Path

from pyspark.sql import functions as F

from rulespark.functions.keys import display_text, measure_key, natural_key, norm_text
from rulespark.plans.engine import run_engine
from rulespark.plans.records import FILES, Context
from rulespark.sources import sinks
from rulespark.sources.tables import named_headers, resolved_columns, with_regions
from rulespark.sources.workbooks import CELLS, classify_material, header_rows, longest_alias, read_cells, read_files, records_from_cells, with_system_types
from rulespark.streaming.intake import audit_stream, latest_findings, watch_records
from tests.records_fixture import context, duty
from tests.test_engine import PACK

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook(sheets):
    """A tiny package: sheets is name -> (state, {reference: xml of the cell's content}, merges)."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}" state="{s[0]}"/>' for k, (n, s) in enumerate(sheets.items())) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x">' + "".join(f'<Relationship Id="r{k}" Target="worksheets/s{k}.xml"/>' for k in range(len(sheets))) + "</Relationships>")
        for k, (_, cells, merges) in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{k}.xml", f'<worksheet xmlns="{MAIN}"><sheetData><row>' + "".join(f'<c r="{r}" {x}</c>' for r, x in cells.items()) + "</row></sheetData><mergeCells>" + "".join(f'<mergeCell ref="{m}"/>' for m in merges) + "</mergeCells></worksheet>")
    return out.getvalue()


def text(s):
    return f't="inlineStr"><is><t>{s}</t></is>'


STRUCK = 't="inlineStr"><is><r><rPr><strike/></rPr><t>旧</t></r><r><t>新</t></r></is>'
ALIASES = {"position_duty": {"measure_id": ["控制措施编号"], "department": ["部门"], "duty": ["岗位职责"], "person_names": ["人员姓名"]}, "system_rule": {"system_owner": ["管理主体"], "system_type": ["系统类型"]}}
CORE = {"position_duty": ["measure_id", "department", "duty"], "system_rule": ["system_owner"]}


def test_workbooks_become_records(spark, tmp_path):
    duty_sheet = ("visible", {"A1": text("岗位清单"), "A2": text("控制措施 编号"), "B2": text("部门"), "C2": text("岗位职责"), "D2": text("人员姓名"), "A3": text("X-1-控制措施1"), "B3": text("财务部"), "C3": STRUCK, "D3": text("甲、乙"), "B4": ">" + "<f>A1</f>", "C4": text("审核")}, ["A3:A4"])
    hidden = ("hidden", {"A1": text("控制措施编号"), "B1": text("部门"), "C1": text("岗位职责"), "A2": text("9")}, [])
    rules = ("visible", {"A1": text("管理主体"), "B1": text("系统类型"), "A2": text("国网总部")}, [])
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "三清单.xlsx").write_bytes(workbook({"岗位": duty_sheet, "旧": hidden, "规则": rules}))
    (tmp_path / "in" / "坏.xlsx").write_bytes(b"PK\x03\x04broken")
    (tmp_path / "in" / "~$lock.xlsx").write_bytes(b"PK\x03\x04")
    files = read_files(spark, str(tmp_path / "in"))
    assert files.count() == 2
    cells = read_cells(files).cache()
    assert cells.where("error IS NOT NULL").count() == 1
    scope = files.select("relative_path", F.lit("205H").alias("entity_code"), F.lit("06").alias("business_code"), F.lit(None).cast("string").alias("business_id"), F.lit(None).cast("string").alias("variant_id"))
    rows = with_system_types(records_from_cells(cells, header_rows(cells, ALIASES, CORE), scope)).collect()
    got = {(r["sheet"], r["row"]): {k: (v["current"], v["state"]) for k, v in r["fields"].items()} for r in rows}
    assert got == {
        ("岗位", 3): {"measure_id": ("X-1-控制措施1", "value"), "department": ("财务部", "value"), "duty": ("新", "value"), "person_names": ("甲、乙", "value")},
        ("岗位", 4): {"measure_id": ("X-1-控制措施1", "value"), "department": ("", "formula_no_cache"), "duty": ("审核", "value"), "person_names": ("", "empty")},
        ("规则", 2): {"system_owner": ("国网总部", "value"), "system_type": ("一级部署系统", "value")},
    }
    struck = next(r for r in rows if r["row"] == 3)
    assert [s["text"] for s in struck["fields"]["duty"]["deleted_spans"]] == ["旧"] and len(struck["person_keys"]) == 2


def test_keys(spark):
    rows = [("Ａ１　b　c", "X-2x-控制措施13", "a10b"), ("\tq\n", "3.1.4", "a9b"), (None, "none", "a")]
    df = spark.createDataFrame(rows, "t string, m string, n string")
    got = df.select(norm_text(F.col("t")).alias("t"), measure_key(F.col("m")).alias("m"), natural_key(F.col("n")).alias("n"), display_text(F.col("t")).alias("d")).collect()
    assert [r["t"] for r in got] == ["A1bc", "q", None]
    assert [r["m"] for r in got] == [[2, 13], [3, 1, 4], []]
    assert sorted(r["n"] for r in got)[1] == got[1]["n"] and got[1]["d"] == "q"


def test_identity_of_material_and_business(spark):
    df = spark.createDataFrame([("a/矩阵.xlsx",), ("a/三清单.xlsx",), ("a/矩阵说明.docx",), ("x",)], "p string")
    assert [r[0] for r in df.select(classify_material(F.col("p"))).collect()] == ["matrix", "three_lists", "explanation", None]
    names = spark.createDataFrame([("采购", "1"), ("物资采购", "2"), ("资金", "3"), ("费用", "4")], "alias string, business string")
    rows = spark.createDataFrame([("物资采购业务",), ("资金费用",), ("无",)], "t string")
    assert {r["t"]: r["business"] for r in longest_alias(rows, "t", names, "alias", "business").collect()} == {"物资采购业务": "2", "资金费用": None, "无": None}


def test_sinks(spark, tmp_path):
    result = run_engine(PACK, context(spark, [duty(1), duty(2)]))
    sinks.write_result(result.findings, result.statuses, result.limitations, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/findings")).count() == 3
    sinks.write_csv(result.statuses.withColumn("a", F.array(F.lit(1))), str(tmp_path / "csv"))
    assert "a" in spark.read.option("header", "true").csv(str(tmp_path / "csv")).columns
    names = spark.createDataFrame([("A.xlsx",), ("a.xlsx",), ("b.xlsx",)], "relative_path string")
    assert [r["files"] for r in sinks.target_collisions(names).collect()] == [2]
    assert sinks.without_columns(names.withColumn("x", F.lit(1)), ["x"]).columns == ["relative_path"]


def test_stream_equals_batch(spark, tmp_path):
    whole = context(spark, [duty(1), duty(2), duty(3, department="")])
    whole.records.write.parquet(str(tmp_path / "in"))
    files, roster = spark.createDataFrame([], FILES), whole.entities

    def make(batch):
        return Context(batch, files, roster, None, ["205H"], [{"business_code": "06"}])

    for _ in range(2):
        audit_stream(watch_records(spark, str(tmp_path / "in")), PACK, make, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    streamed = {r["finding_key"] for r in latest_findings(spark, str(tmp_path / "out")).collect()}
    assert streamed == {r["finding_key"] for r in run_engine(PACK, make(whole.records)).findings.collect()}


def cells_frame(spark, sheets, path="f.xlsx"):
    """Cells from sheet -> {reference: text, or (text, area)}; the state is by the text."""
    rows = []
    for sheet, cells in sheets.items():
        for reference, said in cells.items():
            said, area, first = said if isinstance(said, tuple) else (said, None, reference)
            letters, number = re.match(r"([A-Z]+)(\d+)", reference).groups()
            col = 0
            for c in letters:
                col = col * 26 + ord(c) - 64
            rows.append((path, sheet, False, int(number), col, first, said, said, None, "value" if said else "empty", [], [], area, False, None))
    return spark.createDataFrame(rows, CELLS)


def scope_of(spark, path="f.xlsx"):
    return spark.createDataFrame([(path, "205H", "06", None, None)], "relative_path string, entity_code string, business_code string, business_id string, variant_id string")


FULL = {
    "position_duty": {"measure_id": ["控制措施编号"], "department": ["部门"], "position": ["岗位名称"], "duty": ["岗位职责"], "person_names": ["人员"]},
    "system_rule": {"measure_id": ["控制措施编号"], "system_rule_name": ["规则名称"], "system_rule_content": ["规则内容"]},
    "matrix": {"measure_id": ["控制措施编号"], "control_measure": ["控制措施"], "responsibility": ["责任主体"], "applicability": ["是否适用"], "carrier": ["控制载体"]},
}
NEEDED = {"position_duty": ["measure_id", "department", "position", "duty"], "system_rule": ["measure_id", "system_rule_name", "system_rule_content"], "matrix": ["measure_id", "control_measure", "responsibility"]}


def test_two_tables_of_a_sheet_are_two_sets_of_records(spark):
    duties = {"A2": "控制措施编号", "B2": "部门", "C2": "岗位名称", "D2": "岗位职责", "A3": "1-1", "B3": "财务部", "C3": "会计", "D3": "做账", "A4": ("合并", "A4:A8", "A4"), "B4": "审计部", "A6": ("合并", "A4:A8", "A4")}
    rules = {"A7": "控制措施编号", "B7": "规则名称", "C7": "规则内容", "A8": "1-2", "B8": "校验", "C8": "不得为空"}
    below = {"A1": "一、岗位职责清单", "C1": "填报单位：甲", "A6": "二、系统控制规则清单（填报）"} | duties | rules
    below["A6"] = "二、系统控制规则清单（填报）"
    beside = {"A1": "岗位职责清单", "F1": "系统规则清单"} | {k: v for k, v in duties.items() if k[1:] in "23"} | {f"{chr(ord(k[0]) + 5)}{int(k[1:]) - 5}": v for k, v in rules.items()}
    none = {"A1": "不相容岗位清单所列", "A2": "控制措施编号", "B2": "规则名称", "C2": "规则内容", "A3": "2", "B3": "x", "C3": "y"}
    cells = with_regions(cells_frame(spark, {"竖": below, "横": beside, "无": none, "填报说明": below}))
    heads = {(r["sheet"], r["region"], r["header_row"], r["record_type"]) for r in header_rows(cells, FULL, NEEDED).collect()}
    assert heads == {("竖", 1, 2, "position_duty"), ("竖", 2, 7, "system_rule"), ("横", 1, 2, "position_duty"), ("横", 2, 2, "system_rule"), ("无", 0, 2, "system_rule"), ("填报说明", 0, 2, "position_duty")}
    rows = records_from_cells(cells.where("sheet != '填报说明'"), header_rows(cells, FULL, NEEDED), scope_of(spark)).collect()
    got = {(r["sheet"], r["row"], r["record_type"]): r["fields"]["measure_id"]["current"] for r in rows}
    # The merged cell reaches into the second table, so it stays in its first row.
    assert got == {("竖", 3, "position_duty"): "1-1", ("竖", 4, "position_duty"): "合并", ("竖", 8, "system_rule"): "1-2", ("横", 3, "position_duty"): "1-1", ("横", 3, "system_rule"): "1-2", ("无", 3, "system_rule"): "2"}


def test_headers_with_notes_remarks_and_qualifiers(spark):
    sheets = {
        "注": {"A1": "控制措施编号（必填）", "B1": "部门\n（全称）", "C1": "岗位名称：按名册", "D1": "岗位职责(可多行(至少一行))", "E1": "人员姓名/工号"},
        "两": {"A1": "控制措施编号", "B1": "部门\n岗位名称", "C1": "岗位名称", "D1": "岗位职责"},
        "矩": {"A1": "控制措施编号", "B1": "控制措施", "C1": "甲县公司责任主体", "D1": "本部是否适用（及原因）", "E1": "责任主体"},
        "近": {"A1": "序", "A2": "对应控制措施编号", "B2": "所在部门", "C2": "现岗位名称", "D2": "主要岗位职责"},
        "远": {f"A{k}": "行" for k in range(1, 7)} | {"A7": "对应控制措施编号", "B7": "所在部门", "C7": "现岗位名称", "D7": "主要岗位职责"},
        "缺": {"A1": "对应控制措施编号", "B1": "所在部门", "C1": "现岗位名称"},
    }
    cells = cells_frame(spark, sheets)
    found = {r["sheet"]: (r["header_row"], r["record_type"], r["columns"]) for r in header_rows(cells, FULL, NEEDED).collect()}
    assert found == {
        "注": (1, "position_duty", {"measure_id": 1, "department": 2, "position": 3, "duty": 4, "person_names": 5}),
        "矩": (1, "matrix", {"measure_id": 1, "control_measure": 2, "responsibility": 3, "applicability": 4}),
        "近": (2, "position_duty", {"measure_id": 1, "department": 2, "position": 3, "duty": 4}),
    }
    owners = {(r["sheet"], r["col"]): r["owner"] for r in named_headers(with_regions(cells), FULL).where("record_type = 'matrix' AND owner != ''").collect()}
    assert owners == {("矩", 3): "甲县公司", ("矩", 4): "本部"}


def test_large_sheets_pass_in_bounded_memory(tmp_path):
    script = """
import io, resource, sys, zipfile
sys.path.insert(0, sys.argv[1])
from tests.test_sources import MAIN, REL
from rulespark.sources.workbooks import workbook_cells
out = io.BytesIO()
with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
    z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets><sheet name="s" sheetId="1" r:id="r0"/></sheets></workbook>')
    z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r0" Target="worksheets/s0.xml"/></Relationships>')
    with z.open("xl/worksheets/s0.xml", "w", force_zip64=True) as f:
        f.write(f'<worksheet xmlns="{MAIN}"><sheetData>'.encode())
        for r in range(1, 300001):
            said = "x" * 180 if r <= 250000 else ""
            f.write(f'<row r="{r}"><c r="A{r}" t="inlineStr"><is><t>{said}</t></is></c><c r="XFD{r}" s="1"/></row>'.encode())
        f.write(b'</sheetData><mergeCells><mergeCell ref="A249999:B260000"/><mergeCell ref="XEZ270000:XFA280000"/></mergeCells></worksheet>')
book = out.getvalue()
size = zipfile.ZipFile(io.BytesIO(book)).getinfo("xl/worksheets/s0.xml").file_size
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
count, last = 0, 0
for c in workbook_cells(book):
    count, last = count + 1, max(last, c["row"])
print(size, count, last, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""
    root = str(Path(__file__).resolve().parent.parent)
    done = subprocess.run([sys.executable, "-c", script, root], capture_output=True, text=True, cwd=root)
    size, count, last, grown = map(int, done.stdout.split())
    # 250,000 texts, and three copies of the merged one within the rows that have content.
    assert size > 64 << 20 and count == 250_000 + 2 and last == 250_000 and grown < 60_000


def test_columns_are_told_by_owner_visibility_and_content(spark):
    head = {"A1": "控制措施编号", "B1": "控制措施", "C1": "责任主体"}
    body = {f"{c}{r}": t for r in (2, 3) for c, t in (("A", f"1-{r}"), ("B", "核对"), ("C", "财务部-会计"))}

    def sheet(**more):
        return head | body | {k.upper(): v for k, v in more.items()}

    sheets = {
        "本": sheet(d1="乙公司是否适用", d2="适用", e1="甲公司是否适用", e2="不适用"),
        "清": sheet(d1="是否适用", d2="适用", d3="不适用", e1="适用情况", e2="修改了", e3="不适用"),
        "争": sheet(d1="是否适用", d2="适用", e1="适用情况", e2="不适用"),
        "同": sheet(d1="是否适用", d2="适用", e1="适用情况", e2="适用"),
        "邻": sheet(d1="不适用原因", d2="x", e1="是否适用", e2="适用", f1="不适用理由", f2="y"),
        "外": sheet(c1="乙公司责任主体"),
        "名": sheet(d1="责任主体（甲公司）", d2="甲公司-财务部-会计"),
        "隐": sheet(d1="是否适用", d2="适用", e1="适用情况", e2="不适用"),
        "藏": sheet(d1="是否适用", d2="适用"),
    }
    cells = cells_frame(spark, sheets).withColumn("column_hidden", F.expr("col = 4 AND sheet IN ('隐', '藏')"))
    names = spark.createDataFrame([("f.xlsx", "甲公司"), ("f.xlsx", None)], "relative_path string, name string")
    heads = header_rows(cells, FULL, NEEDED | {"matrix": ["measure_id", "control_measure"]})
    got = {r["sheet"]: (r["columns"], r["reasons"]) for r in resolved_columns(cells, heads, FULL, names).collect()}
    pick = lambda s, f: (got[s][0].get(f), got[s][1][f])
    assert {s: pick(s, "applicability") for s in "本清争同邻隐藏"} == {
        "本": (5, "current_unit_header"), "清": (4, "answer_values"), "争": (None, "column_conflict"), "同": (5, "equivalent_columns"), "邻": (5, "single_field"), "隐": (5, "visible_equivalent_preferred"), "藏": (4, "hidden_field_required"),
    }
    assert pick("邻", "applicability_reason") == (6, "paired") and pick("外", "responsibility") == (None, "owner_unconfirmed") and pick("名", "responsibility") == (4, "current_unit_values")
    assert pick("本", "measure_id") == (1, "single_field")
