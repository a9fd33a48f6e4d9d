"""The registered checks and the engine as queries over the driver's tables, each with its SQL.

Orders become duty rows and parts become measures of a submission, with
blank, vague and contradicting values where certain numbers stand, so that
every query runs through records, ``CHECKS`` and, for the last two, the engine.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespark.operators.checks import CHECKS, PACKAGE_CHECKS
from rulespark.plans.active_rules import specific_departments, specific_positions
from rulespark.plans.engine import Result, run_engine
from rulespark.plans.records import CELL, ENTITIES, FILES, RECORDS, Context
from rulespark.sources.stored import spread, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# The same expressions make the records here and the views of the SQL.
DUTY = {
    "entity_code": "concat('E', o_custkey % 4)",
    "file_path": "concat('o', o_orderkey % 400)",
    "record_id": "concat('d', o_orderkey)",
    "measure_id": "CASE WHEN o_orderkey % 50 = 0 THEN '' ELSE concat('X-', o_custkey % 30, '-控制措施', o_orderkey % 7) END",
    "role": "CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN substr(o_orderpriority, 1, 1) = '1' THEN '经办' WHEN substr(o_orderpriority, 1, 1) = '2' THEN '审核' ELSE '审批' END",
    "department": "CASE WHEN o_orderkey % 23 = 1 THEN '' WHEN o_orderkey % 29 = 2 THEN '无' ELSE concat('dept', o_custkey % 9) END",
    "position": "CASE WHEN o_orderkey % 31 = 3 THEN '会计、出纳' WHEN o_orderkey % 37 = 4 THEN '相关岗位' ELSE concat('pos', o_custkey % 13) END",
    "person_names": "concat('p', o_custkey % 17)",
    "duty": "CASE WHEN o_orderkey % 13 = 5 THEN '核对台账' ELSE concat('对第', o_custkey % 3, '项资料的真实性负', CASE WHEN o_orderstatus = 'O' THEN '主体责任' ELSE '审核责任' END) END",
}
# Sentences that tell the grammars of responsibility apart: whose statement it is, denied or not, taken back, quoted, with a second one.
CLAUSE = {
    "entity_code": "concat('E', o_custkey % 4)",
    "file_path": "concat('o', o_orderkey % 400)",
    "record_id": "concat('c', o_orderkey)",
    "role": "CASE o_custkey % 4 WHEN 0 THEN '审核' WHEN 1 THEN '审批' ELSE '经办' END",
    "duty": "concat(CASE WHEN o_orderkey % 11 = 7 THEN '参照“供应商承担审批责任”的说明,' ELSE '' END,"
    " CASE o_orderkey % 7 WHEN 1 THEN '本岗位' WHEN 2 THEN '供应商' WHEN 3 THEN '其他部门' WHEN 4 THEN '建设部' WHEN 5 THEN '由供应商' WHEN 6 THEN '并非本岗位' ELSE '' END,"
    " '对第', o_custkey % 3, '项资料的', CASE WHEN o_custkey % 5 < 3 THEN '真实性' ELSE '内容' END, CASE o_orderkey % 5 WHEN 1 THEN '承担' WHEN 2 THEN '负有' WHEN 3 THEN '不负' WHEN 4 THEN '不应承担' ELSE '负' END,"
    " CASE WHEN o_orderstatus = 'O' THEN '主体责任' ELSE '审核责任' END,"
    " CASE o_orderkey % 11 WHEN 3 THEN '。本岗位不承担上述责任' WHEN 5 THEN ',但本岗位不承担审批责任' WHEN 9 THEN ';对台账承担审批责任' ELSE '' END)",
    "person_names": "'p'",
}
# Departments and positions that name a concrete one, a vague one, or a vague word within a longer name.
POST = {
    "entity_code": "concat('E', o_custkey % 4)",
    "file_path": "concat('o', o_orderkey % 400)",
    "record_id": "concat('p', o_orderkey)",
    "department": "CASE o_orderkey % 7 WHEN 0 THEN '财务部' WHEN 1 THEN '合同归口管理部门' WHEN 2 THEN '归口管理部门（党委办公室）' WHEN 3 THEN '外包归口管理部门（党委办公室）' WHEN 4 THEN '甲公司-财务管理部门' WHEN 5 THEN '委托代理部' ELSE concat('第', o_custkey % 9, '项目部') END",
    "position": "CASE o_orderkey % 8 WHEN 0 THEN '会计' WHEN 1 THEN '物资采购人员' WHEN 2 THEN '采购人员专责' WHEN 3 THEN '部门负责人-综合管理人员' WHEN 4 THEN '现场查勘人员' WHEN 5 THEN '营销部管理人员' WHEN 6 THEN '副负责人' ELSE concat('第', o_custkey % 9, '班') END",
    "person_names": "'p'",
}
MEASURE = {
    "entity_code": "concat('E', p_partkey % 5)",
    "file_path": "'m'",
    "record_id": "concat('m', p_partkey)",
    "measure_id": "concat('X-', p_partkey % 45, '-控制措施', p_size % 9)",
    "applicability": "CASE p_size % 3 WHEN 0 THEN '适用' WHEN 1 THEN '不适用' ELSE '' END",
    "applicability_reason": "CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '无此业务' END",
    "responsibility": "concat('dept', p_partkey % 12, '-会计')",
    "carrier": "CASE WHEN p_partkey % 45 = 7 AND p_partkey % 2 = 0 THEN '付款单' ELSE concat('付款单、第', p_partkey % 3, '号合同或协议') END",
}
# Rows that refer to carriers of their measure, in the column and in running text.
REFERENCE = {
    "entity_code": "concat('E', o_custkey % 5)",
    "file_path": "concat('o', o_orderkey % 400)",
    "record_id": "concat('r', o_orderkey)",
    "measure_id": "concat('X-', o_custkey % 45, '-控制措施', o_orderkey % 9)",
    "carrier": "CASE o_orderkey % 4 WHEN 0 THEN '付款单' WHEN 1 THEN '付款单、台账' ELSE '' END",
    "duty": "CASE o_orderkey % 6 WHEN 0 THEN '对付款单的准确性负主体责任' WHEN 1 THEN '对《台账》的完整性负主体责任' WHEN 2 THEN '对协议的准确性负审核责任' WHEN 3 THEN '对付款单准确匹配情况负审核责任' WHEN 4 THEN '对未知登记表的完整性负责' ELSE '对本岗位工作负责' END",
    "person_names": "'p'",
}


# Measures of two numbered entries, of which none, the second or both are struck out; and duties that use an entry.
STRUCK = {
    "entity_code": "concat('E', p_partkey % 5)",
    "file_path": "'k'",
    "record_id": "concat('k', p_partkey)",
    "measure_id": "concat('X-', p_partkey % 45, '-控制措施', p_size % 9)",
    "control_measure": "CASE p_size % 3 WHEN 0 THEN concat('1.核对第', p_partkey % 3, '号台账;2.登记', p_partkey % 4, '号凭证') WHEN 1 THEN concat('1.核对第', p_partkey % 3, '号台账;2.') ELSE '' END",
}
STRUCK_WHOLE = "concat('1.核对第', p_partkey % 3, '号台账;2.登记', p_partkey % 4, '号凭证')"
USING = REFERENCE | {"record_id": "concat('u', o_orderkey)", "duty": "concat('按规定登记', o_orderkey % 4, ' 号凭证并归档')"}


# Groups of responsible units: of the province, of nobody, of two together, open, with the row's own unit, unknown.
GROUP = {
    "entity_code": "concat('E', p_partkey % 5)",
    "file_path": "'g'",
    "record_id": "concat('g', p_partkey)",
    "responsibility": "CASE p_partkey % 7 WHEN 0 THEN '省公司-财务部-主任' WHEN 1 THEN '国网财务部；省公司-物资部' WHEN 2 THEN '北京电力交易中心' WHEN 3 THEN '省公司、物资公司' WHEN 4 THEN '省公司-财务部；待确认' WHEN 5 THEN '省公司-财务部；国网湖南省电力有限公司凤凰县供电分公司-财务部-主任' ELSE '外地公司-财务部' END",
    "applicability": "CASE p_size % 3 WHEN 0 THEN '适用' WHEN 1 THEN '不适用' ELSE '' END",
}
UNITS = ["国网湖南省电力有限公司", "国网湖南省电力有限公司物资公司", "国网湖南省电力有限公司凤凰县供电分公司", "国网湖南省电力有限公司龙山县供电分公司", "尚未确认归属的中心"]
RESTRICTIONS = {
    "restrictions": [
        {"id": "province", "patterns": ["省公司[-/][^-/,;、]+部(?:[-/][^-/,;、]+)?", "国网[^-/;,、]+部(?:[-/][^-/,;、]+)?"], "entity_patterns": ["国网湖南省电力有限公司"]},
        {"id": "nobody", "patterns": ["北京电力交易中心(?:[-/][^-/,;、]+){0,2}"], "entity_patterns": []},
        {"id": "both", "patterns": ["省公司", "物资公司"], "required_patterns": ["省公司", "物资公司"], "entity_patterns": ["国网湖南省电力有限公司", "国网湖南省电力有限公司物资公司"]},
    ],
    "known_entity_patterns": ["国网湖南省电力有限公司.+供电分公司(?:本部)?"],
}


def _view(names: dict[str, str], table: str, row: str) -> str:
    return f"SELECT {', '.join(f'{v} AS {k}' for k, v in names.items())}, CAST({row} AS INT) AS line FROM {table}"


WITH = f"WITH duties AS ({_view(DUTY, 'orders', 'o_orderkey')}), measures AS ({_view(MEASURE, 'part', 'p_partkey')}), clauses AS ({_view(CLAUSE, 'orders', 'o_orderkey')}), posts AS ({_view(POST, 'orders', 'o_orderkey')}), referring AS ({_view(REFERENCE, 'orders', 'o_orderkey')}), struck AS ({_view(STRUCK, 'part', 'p_partkey')}), using_rows AS ({_view(USING, 'orders', 'o_orderkey')}), groups_of AS ({_view(GROUP, 'part', 'p_partkey')})"


#: The kinds whose rows are measures.
MEASURES = ("matrix", "struck", "groups")


def _records(spark: SparkSession, d: str, kind: str) -> DataFrame:
    names, table, row = {"position_duty": (DUTY, "orders", "o_orderkey"), "clauses": (CLAUSE, "orders", "o_orderkey"), "posts": (POST, "orders", "o_orderkey"), "referring": (REFERENCE, "orders", "o_orderkey"), "using": (USING, "orders", "o_orderkey"), "struck": (STRUCK, "part", "p_partkey"), "groups": (GROUP, "part", "p_partkey"), "matrix": (MEASURE, "part", "p_partkey")}[kind]
    rows = spread(spark.read.parquet(f"{d}/{table}.parquet"), row).selectExpr(*(f"{v} AS {k}" for k, v in names.items()), f"CAST({row} AS INT) AS `row`", *([f"{STRUCK_WHOLE} AS _whole"] if kind == "struck" else []))

    def cell(name: str) -> Any:
        text = F.col(name)
        if (name, kind) == ("control_measure", "struck"):
            span = F.struct(F.expr("substring(_whole, greatest(length(control_measure), 0) + 1)").alias("text"), F.length(text).alias("start"), F.length("_whole").alias("end"))
            spans = F.when(F.length(text) < F.length("_whole"), F.array(span)).otherwise(F.array())
            return F.struct(F.col("_whole"), text, F.lit("A1"), F.lit(None), F.lit(None), F.when(text == "", "empty").otherwise("value"), spans, F.lit(False), F.array()).cast(CELL)
        values = {"raw": text, "current": text, "state": F.when(text == "", "empty").otherwise("value"), "deleted_unavailable": F.lit(False)}
        fields = ("raw", "current", "coordinate", "formula", "cached", "state", "deleted_spans", "deleted_unavailable", "red_spans")
        return F.struct(*(values.get(f, F.lit(None)).alias(f) for f in fields)).cast(CELL)

    own = [k for k in names if k not in ("entity_code", "file_path", "record_id")]
    people = F.array(F.struct(F.col("person_names").alias("name"), F.lit(None).cast("string").alias("person_id"), F.lit(False).alias("identity_reliable"))) if kind not in MEASURES else F.array()
    return rows.select(
        F.lit("matrix" if kind in MEASURES else "position_duty").alias("record_type"), "entity_code", F.lit("06").alias("business_code"), F.lit("06").alias("business_id"), F.lit("default").alias("variant_id"), "file_path", F.lit("s").alias("sheet"), "row",
        F.create_map(*(x for k in own for x in (F.lit(k), cell(k)))).alias("fields"), "record_id", people.cast("array<struct<name:string,person_id:string,identity_reliable:boolean>>").alias("person_keys"),
    )


def context(spark: SparkSession, d: str, kinds: tuple[str, ...] = ("position_duty", "matrix")) -> Context:
    """The submission: both kinds of records, a file of each nation, and the units that ought to submit."""
    records = None
    for kind in kinds:
        part = _records(spark, d, kind)
        records = part if records is None else records.unionByName(part)
    # Checks read the records again and again; as a table they are also a leaf of the plan, so that no expression of theirs is copied into it.
    records = stored(records) if records is not None else spark.createDataFrame([], RECORDS)
    sheet = lambda kind, columns: f"struct('{kind}' AS title, '{kind}' AS sheet_type, {columns} AS columns, array('编号') AS headers)"
    files = spark.read.parquet(f"{d}/nation.parquet").selectExpr(
        "concat('E', n_nationkey) AS entity_code", "'06' AS business_code", "'06' AS business_id", "'default' AS variant_id", "concat(n_name, '.xlsx') AS relative_path", "n_name AS sha256", "'xlsx' AS true_format",
        "CASE WHEN n_regionkey < 2 THEN 'matrix' WHEN n_regionkey = 2 THEN 'three_lists' END AS material_type", "n_nationkey = 7 AS entity_conflict", "CASE WHEN n_nationkey = 9 THEN array('坏文件') ELSE array() END AS parse_errors",
        "concat(CASE WHEN n_regionkey < 2 THEN array(" + sheet("matrix", "CASE WHEN n_nationkey % 2 = 0 THEN array('measure_id') ELSE array('measure_id', 'carrier') END") + ") ELSE array() END,"
        " CASE WHEN n_regionkey IN (1, 2) THEN array(" + sheet("position_duty", "array('measure_id')") + ") ELSE array() END) AS sheets",
    )
    files = files.select(*(F.col(c).cast(t) for c, t in ((f.name, f.dataType) for f in spark.createDataFrame([], FILES).schema.fields)))
    return Context(records, files, spark.createDataFrame([], ENTITIES), None, [f"E{k}" for k in range(25)], [{"business_code": "06"}])


def through_check(name: str, operator: str, version: int, kind: str | None, sql: str, params: dict[str, Any] | None = None, evidence: tuple[str, ...] = (), needs: tuple[str, ...] | None = None) -> None:
    """Register ``check_<name>``: (record_id or entity_code, kind, issue_type, evidence) of a check, and its SQL after WITH."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        ctx = context(spark, d, needs if needs is not None else (kind,) if kind else ())
        rows = ctx.of_type("matrix" if kind in MEASURES else "position_duty") if kind else ctx.records
        if kind == "groups":
            ctx.entities = spark.createDataFrame([(f"E{k}", n, None, None, True) for k, n in enumerate(UNITS)], ENTITIES)
        found = CHECKS[operator, version](ctx, rows, params or {})
        key = "entity_code" if operator in PACKAGE_CHECKS else "record_id"
        return found.select(key, "kind", "issue_type", *(F.get_json_object("evidence", f"$.{e}").alias(e) for e in evidence))

    query.__doc__ = f"{operator}@{version} over records."
    query.__name__ = f"check_{name}"
    QUERIES[query.__name__] = query
    SQL[query.__name__] = f"{WITH} {sql}"


BOTH = ("position_duty", "matrix")
HAVE = "EXISTS (SELECT 1 FROM duties d WHERE d.entity_code = m.entity_code AND d.measure_id = m.measure_id)"
SENT = "m.entity_code IN (SELECT entity_code FROM duties UNION SELECT concat('E', n_nationkey) FROM nation WHERE n_regionkey IN (1, 2))"

through_check(
    "required_fields", "required_fields", 1, "position_duty",
    """SELECT record_id, 'violation' AS kind, 'field_missing' AS issue_type, field, CASE v WHEN '' THEN '未填写' ELSE '内容不具体' END AS reason FROM (
      SELECT record_id, 'department' AS field, department AS v FROM duties UNION ALL SELECT record_id, 'measure_id', measure_id FROM duties) WHERE v IN ('', '无')""",
    {"fields": ["department", "measure_id"]}, ("field", "reason"),
)
through_check(
    "field_constraints", "field_constraints", 6, "position_duty",
    """SELECT record_id, 'violation' AS kind, CASE position WHEN '相关岗位' THEN 'field_not_concrete' ELSE 'field_not_split' END AS issue_type, position AS actual_text FROM duties WHERE position IN ('相关岗位', '会计、出纳')""",
    {"field": "position", "placeholders": ["相关岗位"], "separators": ["、"]}, ("actual_text",),
)
through_check("text_pattern", "text_pattern", 1, "position_duty", "SELECT record_id, 'violation' AS kind, 'pattern_missing' AS issue_type FROM duties WHERE NOT regexp_matches(duty, '真实性')", {"field": "duty", "patterns": ["真实性"]})
through_check(
    "forbidden_reference", "forbidden_reference", 1, "position_duty",
    "SELECT record_id, 'violation' AS kind, 'forbidden_reference' AS issue_type FROM duties WHERE contains(concat(duty, position), '台账') OR contains(concat(duty, position), '出纳')",
    {"fields": ["duty", "position"], "terms": ["台账", "出纳"]},
)
through_check(
    "records_unique", "records_unique", 1, "position_duty",
    """SELECT record_id, 'violation' AS kind, 'record_repeated' AS issue_type FROM duties
    QUALIFY row_number() OVER (PARTITION BY entity_code, measure_id, person_names, role ORDER BY file_path, line) > 1""",
    {"key_fields": ["entity_code", "measure_id", "person_names", "role"]},
)
through_check(
    "duplicate_duties", "duplicate_duties", 1, "position_duty",
    """SELECT record_id, 'violation' AS kind, 'duplicate_duty' AS issue_type, CAST(count(*) OVER w AS VARCHAR) AS repeats FROM duties WHERE measure_id <> '' AND department <> '' AND role <> ''
    WINDOW w AS (PARTITION BY entity_code, measure_id, duty, department, position, person_names, role) QUALIFY count(*) OVER w > 1""",
    None, ("repeats",),
)
through_check("missing_duty_measures", "missing_duty_measures", 1, "matrix", f"SELECT record_id, 'review' AS kind, 'missing_duty_measure' AS issue_type, measure_id FROM measures m WHERE NOT {HAVE} AND {SENT}", None, ("measure_id",), BOTH)
through_check(
    "measure_applicability_alignment", "measure_applicability_alignment", 3, "matrix",
    f"""SELECT record_id, 'review' AS kind, 'measure_applicability_mismatch' AS issue_type, CASE WHEN h THEN 'true' ELSE 'false' END AS measure_present
    FROM (SELECT *, {HAVE} AS h FROM measures m) WHERE applicability = CASE WHEN h THEN '不适用' ELSE '适用' END""",
    None, ("measure_present",), BOTH,
)
through_check(
    "applicability_values", "applicability_values", 2, "matrix",
    """SELECT record_id, 'violation' AS kind, CASE applicability WHEN '' THEN 'applicability_empty' ELSE 'not_applicable_reason_empty' END AS issue_type FROM measures
    WHERE applicability = '' OR (applicability = '不适用' AND applicability_reason = '')""",
)
through_check(
    "reference_exists", "reference_exists", 1, "position_duty",
    """SELECT record_id, 'violation' AS kind, CASE measure_id WHEN '' THEN 'reference_missing' ELSE 'reference_not_found' END AS issue_type FROM duties d
    WHERE measure_id = '' OR NOT EXISTS (SELECT 1 FROM measures m WHERE m.entity_code = d.entity_code AND m.measure_id = d.measure_id)""",
    {"source_field": "measure_id", "target_record_type": "matrix", "target_field": "measure_id"}, (), BOTH,
)
through_check(
    "roles_disjoint", "roles_disjoint", 1, "position_duty",
    """, seen AS (SELECT *, CASE WHEN role <> '' THEN role WHEN contains(duty, '主体责任') THEN '经办' WHEN contains(duty, '审核责任') THEN '审核' END AS r FROM duties)
    SELECT record_id, 'review' AS kind, CASE WHEN r IS NULL THEN 'role_unresolved' ELSE 'role_overlap' END AS issue_type FROM seen WHERE r IS NULL
    UNION ALL SELECT record_id, 'review', 'role_overlap' FROM (SELECT *, bool_or(r = '经办') OVER w AND bool_or(r = '审核') OVER w AS both_roles FROM seen WHERE r IS NOT NULL
      WINDOW w AS (PARTITION BY entity_code, measure_id, person_names)) WHERE both_roles AND r IN ('经办', '审核')""",
    {"group_by": ["entity_code", "measure_id"], "role_pairs": [["经办", "审核"]]},
)
through_check(
    "value_mapping", "value_mapping", 5, "position_duty",
    """SELECT record_id, 'violation' AS kind, CASE WHEN duty = '核对台账' THEN 'responsibility_role_missing' ELSE 'responsibility_role_conflict' END AS issue_type FROM duties
    WHERE role <> '' AND NOT contains(duty, CASE role WHEN '经办' THEN '主体责任' WHEN '审核' THEN '审核责任' ELSE '审批责任' END)""",
    {"source_field": "role", "text_field": "duty", "mapping": {"经办": ["主体责任"], "审核": ["审核责任"], "审批": ["审批责任"]}},
)
through_check("responsibility_phrase", "responsibility_phrase", 9, "position_duty", "SELECT record_id, 'violation' AS kind, 'responsibility_phrase_missing' AS issue_type FROM duties WHERE NOT contains(duty, '真实性')", {"attributes": ["真实性"]})
through_check(
    "responsibility_applicability", "responsibility_applicability", 1, "groups",
    """, said AS (SELECT record_id, applicability AS answer, p_partkey % 7 AS g, p_partkey % 5 AS e FROM groups_of JOIN part ON record_id = concat('g', p_partkey)),
    judged AS (SELECT *, g < 4 AS bound, CASE WHEN g IN (0, 1) AND e < 4 THEN CASE WHEN e = 0 THEN '适用' ELSE '不适用' END WHEN g = 2 THEN '不适用' WHEN g = 3 AND e < 4 THEN CASE WHEN e < 2 THEN '适用' ELSE '不适用' END WHEN g = 5 AND e = 2 THEN '适用' END AS verdict FROM said)
    SELECT record_id, CASE WHEN verdict IS NULL OR answer = '' THEN 'limitation' ELSE 'violation' END AS kind, CASE WHEN verdict IS NULL OR answer = '' THEN 'responsibility_applicability_unresolved' ELSE 'responsibility_applicability_conflict' END AS issue_type,
      CASE WHEN verdict IS NOT NULL AND answer <> '' THEN NULL WHEN verdict IS NOT NULL THEN 'no_clear_answer' WHEN g < 4 THEN 'unit_class_unknown' WHEN g = 4 THEN 'open_scope' ELSE 'unknown_units' END AS reason
    FROM judged WHERE verdict IS NULL OR bound AND answer <> verdict""",
    RESTRICTIONS, ("reason",), ("groups",),
)
REAPPEARS = """, gone AS (SELECT s.*, p_partkey % 4 AS entry, p_size % 3 AS style FROM struck s JOIN part ON record_id = concat('k', p_partkey)),
    texts AS (SELECT entity_code, measure_id, entry, {kept} AS kept, (SELECT count(*) FROM gone n WHERE n.entity_code = g.entity_code AND n.measure_id = g.measure_id) AS n FROM gone g WHERE style IN ({styles}) GROUP BY ALL),
    used AS (SELECT u.*, o_orderkey % 4 AS entry FROM using_rows u JOIN orders ON record_id = concat('u', o_orderkey))
    SELECT record_id, CASE WHEN kept = 0 THEN 'violation' ELSE 'review' END AS kind, CASE WHEN kept = 0 THEN 'deleted_matrix_text_reappeared' ELSE 'deletion_current_conflict' END AS issue_type
    FROM used JOIN texts USING (entity_code, measure_id, entry) WHERE kept < n"""
KEPT = "(SELECT count(*) FROM gone k WHERE k.entity_code = g.entity_code AND k.measure_id = g.measure_id AND k.entry = g.entry AND k.style = 0)"
FIRST_MISSING = """ UNION ALL SELECT record_id, 'review', 'deletion_matrix_missing' FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY line, record_id) AS place FROM used u
    WHERE NOT EXISTS (SELECT 1 FROM struck s WHERE s.entity_code = u.entity_code AND s.measure_id = u.measure_id)) WHERE place = 1"""
for _version, _sql in ((1, REAPPEARS.format(kept="0", styles="1") + FIRST_MISSING), (2, REAPPEARS.format(kept=KEPT, styles="1, 2") + FIRST_MISSING), (3, REAPPEARS.format(kept=KEPT, styles="1, 2"))):
    through_check(f"deleted_text_{_version}", "deleted_text_reappears", _version, "using", _sql, {"source_fields": ["control_measure"], "target_field": "duty"}, (), ("using", "struck"))
USED = """, allowed AS (SELECT entity_code, measure_id, min(carrier) AS low, max(carrier) AS high FROM measures GROUP BY ALL),
    seen AS (SELECT r.*, o_orderkey, low, high FROM referring r JOIN orders ON record_id = concat('r', o_orderkey) LEFT JOIN allowed USING (entity_code, measure_id)), usable AS (SELECT * FROM seen WHERE low = high)
    SELECT record_id, 'review' AS kind, 'matrix_ambiguous' AS issue_type, NULL AS source_kind, NULL AS missing_references FROM seen WHERE low IS NULL OR low <> high
    UNION ALL SELECT record_id, 'review', 'carrier_reference_unmatched', 'carrier_field', '["台账"]' FROM usable WHERE o_orderkey % 4 = 1
    UNION ALL SELECT record_id, 'review', 'carrier_parse_unavailable', NULL, NULL FROM usable WHERE o_orderkey % 6 = 3 AND {read}
    UNION ALL SELECT record_id, 'review', 'carrier_reference_unmatched', 'duty_text', concat('["', CASE o_orderkey % 6 WHEN 1 THEN '台账' WHEN 2 THEN '协议' ELSE '未知登记表' END, '"]') FROM usable
      WHERE (o_orderkey % 6 IN (1, 4) OR o_orderkey % 6 = 2 AND {named}) AND {read}"""
for _version, _read, _named in ((1, "carrier = ''", "true"), (2, "true", "true"), (5, "true", "NOT contains(low, '或协议')")):
    through_check(
        f"set_subset_{_version}", "set_subset", _version, "referring", USED.format(read=_read, named=_named),
        {"source_field": "carrier", "target_record_type": "matrix", "target_field": "carrier", "fallback_explicit_field": "duty"}, ("source_kind", "missing_references"), ("referring", "matrix"),
    )
VAGUE = "SELECT record_id, 'violation' AS kind, 'field_not_concrete' AS issue_type FROM posts JOIN orders ON record_id = concat('p', o_orderkey) WHERE o_orderkey % {n} IN ({some})"
through_check("department_specific", "field_constraints", 6, "posts", VAGUE.format(n=7, some="1, 3, 4, 5"), specific_departments())
through_check("position_specific", "field_constraints", 6, "posts", VAGUE.format(n=8, some="1, 5, 6"), specific_positions())
# What the generated sentences say, by grammar: 2 takes 不应 for no denial, a named unit and 并非 for the row itself.
SAID = """, said AS (SELECT *, CASE role WHEN '经办' THEN '主体责任' WHEN '审核' THEN '审核责任' ELSE '审批责任' END AS wanted,
      CASE WHEN o_orderstatus = 'O' THEN '主体责任' ELSE '审核责任' END AS type, contains(duty, '真实性') AS quality, o_orderkey % 7 IN (2, 3, 5) AS other, o_orderkey % 11 = 3 AS taken_back, o_orderkey % 11 = 7 AS quote, o_orderkey % 11 = 9 AS second,
      o_orderkey % 5 = 3 AS no2, o_orderkey % 5 IN (3, 4) OR o_orderkey % 7 = 6 AS no3, o_orderkey % 7 = 4 OR (o_orderkey % 7 = 6 AND o_orderkey % 5 IN (3, 4)) AS unclear
      FROM clauses JOIN orders ON record_id = concat('c', o_orderkey)),
    own AS (SELECT *, NOT (no2 OR other OR taken_back) AS own2, NOT (no3 OR other OR taken_back) AS own3, taken_back AND NOT no2 AND NOT other AS against2, taken_back AND NOT no3 AND NOT other AS against3 FROM said)"""
ONE_OF = "CASE WHEN {own} AND second THEN {both} WHEN {own} AND type = wanted OR second AND wanted = '审批责任' THEN NULL WHEN NOT {own} AND NOT second THEN 'responsibility_role_missing' ELSE 'responsibility_role_conflict' END"
OF_ROLE = """{said}, judged AS (SELECT record_id, {chain} ELSE {rest} END AS issue_type FROM own)
    SELECT record_id, CASE WHEN issue_type IN ('responsibility_role_unresolved', 'responsibility_multiple_types') THEN 'review' ELSE 'violation' END AS kind, issue_type FROM judged WHERE issue_type IS NOT NULL"""
CHAIN_2 = "CASE WHEN against2 THEN 'responsibility_self_contradiction' WHEN other AND NOT second THEN 'responsibility_other_actor'"
CHAIN_3 = "CASE WHEN against3 THEN 'responsibility_self_contradiction' WHEN unclear THEN 'responsibility_role_unresolved' WHEN other AND NOT second THEN 'responsibility_other_actor'"
EITHER = "CASE WHEN wanted IN (type, '审批责任') THEN NULL ELSE 'responsibility_multiple_types' END"
ROLE_PARAMS = {"source_field": "role", "text_field": "duty", "mapping": {"经办": ["主体责任"], "审核": ["审核责任"], "审批": ["审批责任"]}}
for _version, _chain, _own, _both in ((3, CHAIN_2, "own2", "'responsibility_multiple_types'"), (4, CHAIN_3, "own3", "'responsibility_multiple_types'"), (5, CHAIN_3, "own3", EITHER)):
    _sql = OF_ROLE.format(said=SAID, chain=_chain, rest=ONE_OF.format(own=_own, both=_both))
    if _version == 5:  # what the row assumes beyond doubt is enough, whatever else is unclear
        _sql = _sql.replace("SELECT record_id, CASE WHEN against3", "SELECT record_id, CASE WHEN NOT against3 AND (own3 AND NOT unclear AND type = wanted OR second AND wanted = '审批责任') THEN NULL WHEN against3")
    through_check(f"value_mapping_{_version}", "value_mapping", _version, "clauses", _sql, ROLE_PARAMS)
REASON_6 = """CASE WHEN against2 THEN 'responsibility_self_contradiction' WHEN own2 AND quality THEN NULL WHEN other AND NOT second THEN 'responsibility_other_actor'
      WHEN own2 OR second THEN 'responsibility_quality_missing' WHEN quality AND quote THEN 'responsibility_structure_unresolved' ELSE 'responsibility_assertion_missing' END"""
through_check(
    "responsibility_phrase_6", "responsibility_phrase", 6, "clauses",
    f"""{SAID}, judged AS (SELECT record_id, {REASON_6} AS issue_type FROM own)
    SELECT record_id, CASE WHEN issue_type = 'responsibility_structure_unresolved' THEN 'review' ELSE 'violation' END AS kind, issue_type FROM judged WHERE issue_type IS NOT NULL""",
    {"attributes": ["真实性"]},
)
through_check(
    "responsibility_phrase_7", "responsibility_phrase", 7, "clauses",
    f"""{SAID} SELECT record_id, CASE WHEN unclear OR coalesce({REASON_6} = 'responsibility_structure_unresolved', false) THEN 'review' ELSE 'violation' END AS kind, 'responsibility_phrase_missing' AS issue_type
    FROM own WHERE against3 OR NOT (own3 AND NOT unclear OR second)""",
    {"attributes": ["真实性"]},
)
through_check(
    "responsibility_phrase_8", "responsibility_phrase", 8, "clauses",
    f"{SAID} SELECT record_id, 'violation' AS kind, 'responsibility_phrase_missing' AS issue_type FROM own WHERE against3 OR NOT (own3 AND quality)",
    {"attributes": ["真实性"]},
)
through_check(
    "responsibility_department_alignment", "responsibility_department_alignment", 1, "matrix",
    f"""SELECT record_id, 'review' AS kind, 'responsibility_department_mismatch' AS issue_type FROM measures m
    WHERE contains(responsibility, 'dept3') AND {SENT} AND NOT EXISTS (SELECT 1 FROM duties d WHERE d.entity_code = m.entity_code AND d.measure_id = m.measure_id AND (contains(department, 'dept3') OR contains(department, 'dept7')))""",
    {"keyword_mappings": {"dept3": ["dept3", "dept7"]}}, (), BOTH,
)
through_check(
    "ordered_records", "ordered_records", 4, "position_duty",
    """, s AS (SELECT *, 1000 * CAST(regexp_extract(measure_id, 'X-(\\d+)-', 1) AS INT) + CAST(regexp_extract(measure_id, '(\\d+)$', 1) AS INT) AS k FROM duties WHERE measure_id <> ''),
    t AS (SELECT *, CASE WHEN k = lag(k) OVER (PARTITION BY file_path ORDER BY line) THEN 0 ELSE 1 END AS fresh FROM s),
    b AS (SELECT *, sum(fresh) OVER (PARTITION BY file_path ORDER BY line) AS block FROM t),
    g AS (SELECT file_path, block, k, coalesce(lag(k) OVER w > k, false) OR coalesce(k > lead(k) OVER w, false) AS down, count(*) OVER (PARTITION BY file_path, k) AS parts
      FROM (SELECT DISTINCT file_path, block, k FROM b) WINDOW w AS (PARTITION BY file_path ORDER BY block))
    SELECT record_id, 'violation' AS kind, 'measure_order' AS issue_type, '措施顺序倒置' AS reason FROM b JOIN g USING (file_path, block) WHERE down
    UNION ALL SELECT record_id, 'violation', 'measure_order', '同一措施记录不连续' FROM b JOIN g USING (file_path, block) WHERE parts > 1""",
    {"field": "measure_id"}, ("reason",),
)
through_check("sheet_exists", "sheet_exists", 1, None, "SELECT concat('E', n_nationkey) AS entity_code, 'violation' AS kind, 'sheet_missing' AS issue_type, 'matrix' AS missing_sheet FROM nation WHERE n_regionkey >= 2", {"sheet_types": ["matrix"]}, ("missing_sheet",))
through_check(
    "required_documents", "required_documents", 3, None,
    """SELECT concat('E', n_nationkey) AS entity_code, 'review' AS kind, 'entity_conflict' AS issue_type FROM nation WHERE n_nationkey = 7
    UNION ALL SELECT concat('E', n_nationkey), 'violation', 'parse_error' FROM nation WHERE n_nationkey = 9
    UNION ALL SELECT concat('E', n_nationkey), 'violation', 'material_missing' FROM nation, (VALUES (1), (2)) WHERE n_regionkey >= 3""",
    {"material_types": ["matrix", "three_lists"]},
)
through_check("schema_contains", "schema_contains", 3, None, "SELECT concat('E', n_nationkey) AS entity_code, 'review' AS kind, 'schema_field_mapping' AS issue_type FROM nation WHERE n_regionkey < 2 AND n_nationkey % 2 = 0", {"sheet_types": ["matrix"], "required_fields": ["measure_id", "carrier"]})


def _rule(code: str, operator: str, version: int, record_type: str, params: dict[str, Any] | None = None, **scope: Any) -> dict[str, Any]:
    check = {"check_id": operator, "operator": operator, "operator_version": version, "params": params or {}, "message": {"violation": "{issue_type}", "review": "请核实{issue_type}"}}
    return {"rule_id": f"r.{code}", "display_code": code, "enabled": True, "scope": {"record_type": record_type, "entity_codes": "*", "business_codes": "*", **scope}, "checks": [check]}


def submission(spark: SparkSession, d: str) -> Result:
    """A pack of four rules, one switched off for a unit by an overlay, through the engine."""
    pack = {
        "submission_scope": {"entity_codes": [], "businesses": [{"business_code": "06"}]},
        "result_policy": {"version": 2},
        "rules": [
            _rule("R05", "required_fields", 1, "position_duty", {"fields": ["department"]}),
            _rule("R10", "responsibility_phrase", 9, "position_duty", {"attributes": ["真实性"]}, entity_codes=["E1", "E2"]),
            _rule("R16", "measure_applicability_alignment", 3, "matrix"),
            _rule("R06", "sheet_exists", 1, "package", {"sheet_types": ["matrix"]}),
        ],
        "overlays": [{"path": "r.R05.enabled", "value": False, "scope": {"entity_codes": ["E3"]}}],
    }
    return run_engine(pack, context(spark, d))


FOUND = f"""SELECT 'R05' AS display_code, 'violation' AS severity, 'field_missing' AS issue_type, entity_code, file_path, line AS "row" FROM duties WHERE department IN ('', '无') AND entity_code <> 'E3'
    UNION ALL SELECT 'R10', 'violation', 'responsibility_phrase_missing', entity_code, file_path, line FROM duties WHERE NOT contains(duty, '真实性') AND entity_code IN ('E1', 'E2')
    UNION ALL SELECT 'R16', 'review', 'measure_applicability_mismatch', entity_code, file_path, line FROM (SELECT *, {HAVE} AS h FROM measures m) WHERE applicability = CASE WHEN h THEN '不适用' ELSE '适用' END
    UNION ALL SELECT 'R06', 'violation', 'sheet_missing', concat('E', n_nationkey), NULL, NULL FROM nation WHERE n_regionkey >= 2"""


def engine_findings(spark: SparkSession, d: str) -> DataFrame:
    """What the engine finds, by rule and place."""
    return submission(spark, d).findings.select("display_code", "severity", "issue_type", "entity_code", "file_path", "row")


def engine_statuses(spark: SparkSession, d: str) -> DataFrame:
    """The status of each rule, with counts."""
    return submission(spark, d).statuses.select("rule_id", "status", F.col("records_considered").cast("bigint"), F.col("findings").cast("bigint"), F.col("limitations").cast("bigint"))


QUERIES |= {"engine_findings": engine_findings, "engine_statuses": engine_statuses}
SQL |= {
    "engine_findings": f"{WITH} {FOUND}",
    "engine_statuses": f"""{WITH}, found AS ({FOUND}), looked AS (
      SELECT 'R05' AS display_code, count(*) AS n FROM duties WHERE entity_code <> 'E3' UNION ALL SELECT 'R10', count(*) FROM duties WHERE entity_code IN ('E1', 'E2')
      UNION ALL SELECT 'R16', count(*) FROM measures UNION ALL SELECT 'R06', count(*) FROM nation)
    SELECT concat('r.', display_code) AS rule_id, 'executed' AS status, n AS records_considered, (SELECT count(*) FROM found f WHERE f.display_code = l.display_code) AS findings, CAST(0 AS BIGINT) AS limitations FROM looked l""",
}
