"""Sheets of one file and of many rows: how their cells are dealt, and that nothing depends on it."""

import json

import pytest

from rulespark.sources import workbooks
from rulespark.sources.stored import stored
from rulespark.sources.tables import named_headers, title_regions, with_regions
from rulespark.sources.workbooks import header_rows, records_from_cells
from tests.test_sources import FULL, NEEDED, cells_frame, scope_of

DUTY, RULE = ["控制措施编号", "部门", "岗位名称", "岗位职责"], ["控制措施编号", "规则名称", "规则内容"]


def line(row, texts, col="A"):
    return {f"{chr(ord(col) + k)}{row}": t for k, t in enumerate(texts)}


def sheet(n):
    """``n`` duties below a title, ``n`` rules below the next, and a merged cell that reaches into it."""
    duties = {k: v for r in range(n) for k, v in line(r + 3, [f"1-{r}", "财务部", "会计", "做账"]).items()}
    rules = {k: v for r in range(n) for k, v in line(r + n + 5, [f"2-{r}", "校验", "不得为空"]).items()}
    reaches = {f"A{r}": ("合并", f"A{n + 2}:A{n + 6}", f"A{n + 2}") for r in (n + 2, n + 6)}
    return {"B1": "岗位职责清单"} | line(2, DUTY) | duties | {f"A{n + 3}": "系统规则清单"} | line(n + 4, RULE) | rules | reaches


def read(spark, cells, parted):
    if parted:
        cells = with_regions(cells)
        heads, rows = header_rows(cells, FULL, NEEDED), records_from_cells(cells, header_rows(cells, FULL, NEEDED), scope_of(spark))
    else:
        regions = stored(title_regions(cells))
        heads = header_rows(cells, FULL, NEEDED, regions)
        rows = records_from_cells(cells, heads, scope_of(spark), regions=regions)
    plain = lambda df: sorted(json.dumps(r.asDict(recursive=True), sort_keys=True) for r in df.collect())
    return plain(heads), plain(rows)


@pytest.mark.parametrize("block", [3, 1 << 14])
def test_blocks_and_late_regions_change_nothing(spark, monkeypatch, block):
    plain = {k: v for k, v in sheet(9).items() if int(k[1:]) < 12 and v != "岗位职责清单"}
    beside = {"A1": ("岗位职责清单", "A1:D1", "A1"), "C1": ("岗位职责清单", "A1:D1", "A1"), "F1": ("系统规则清单", "F1:G1", "F1"), "G1": ("系统规则清单", "F1:G1", "F1"), "E1": ""}
    beside |= line(2, DUTY) | line(3, ["1-1", "财务部", "会计", "做账"]) | line(2, RULE, "F") | line(3, ["1-2", "校验", "x y"], "F")
    before = {f"{k[0]}{int(k[1:]) + 2}": v for k, v in sheet(1).items() if not isinstance(v, tuple)} | line(1, DUTY) | line(2, ["0", "a", "b", "c"])
    spoiled = {"A1": "岗位职责清单", "B1": "x"} | line(2, DUTY) | line(3, ["1-1", "a", "b", "c"])
    cells = cells_frame(spark, {"长": sheet(9), "无": plain, "横": beside, "前": before, "非": spoiled})
    known = read(spark, cells, parted=True)
    monkeypatch.setattr(workbooks, "BLOCK_ROWS", block)
    late = read(spark, cells, parted=False)
    assert late == known == read(spark, cells, parted=True)
    found = {(r["sheet"], r["region"], r["header_row"]) for r in header_rows(cells, FULL, NEEDED, stored(title_regions(cells))).collect()}
    assert found == {("长", 1, 2), ("长", 2, 13), ("无", 0, 2), ("横", 1, 2), ("横", 2, 2), ("前", 1, 4), ("前", 2, 7), ("非", 0, 2)}
    assert len(known[1]) == (9 + 9) + 9 + (1 + 1) + (1 + 1) + 1


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_one_file_are_not_one_task(spark):
    cells = cells_frame(spark, {"长": sheet(3)})
    rows = plan(records_from_cells(cells, header_rows(cells, FULL, NEEDED), scope_of(spark)))
    by_file = [x for x in rows.split("hashpartitioning(")[1:] if x.split("), ")[0].count("#") == 1 and x.startswith("relative_path")]
    assert not by_file


def test_texts_of_sheets_are_not_broadcast(spark):
    """Of the texts that name a field and what is known of them, the known ones are the short side, whatever the size of the stored files."""
    cells = stored(with_regions(cells_frame(spark, {"长": sheet(3)})))
    joins = [x for x in plan(named_headers(cells, FULL)).split("\n") if "Join [_raw" in x]
    assert joins and all("BuildLeft" not in x for x in joins)
