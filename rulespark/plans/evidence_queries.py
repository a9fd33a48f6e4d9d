"""Evidence of units, names, headers and candidates over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespark.operators import evidence

Query = Callable[[SparkSession, str], DataFrame]


def unit_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The unit of each customer's folder, by the names in its path and in a note."""
    nations = spark.read.parquet(f"{d}/nation.parquet")
    roster = nations.selectExpr("concat('U', n_nationkey) AS entity_code", "concat('国网', n_name, '供电公司') AS name").unionByName(nations.selectExpr("concat('S', n_nationkey) AS entity_code", "concat('国网', n_name, '供电公司物资分部') AS name"))
    aliases = nations.selectExpr("concat(n_name, '电力') AS alias", "concat('U', n_nationkey) AS entity_code")
    customers = spark.read.parquet(f"{d}/customer.parquet").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    path = customers.selectExpr("c_custkey", "CASE c_custkey % 5 WHEN 0 THEN concat('材料/国网 ', n_name, ' 供电公司/') WHEN 1 THEN concat('国网', n_name, '供电公司物资分部/1') WHEN 2 THEN concat(n_name, '电力') WHEN 3 THEN concat('U', n_nationkey) ELSE '材料' END AS text")
    note = customers.where("c_custkey % 3 = 0").selectExpr("c_custkey", "concat('由国网', n_name, '供电公司报送') AS text")
    found = evidence.voted_units(path.unionByName(note), "c_custkey", "text", roster, aliases)
    return found.select("c_custkey", "entity_code", F.array_join("evidence", ";").alias("evidence"), "conflict")


UNIT_SQL = """WITH v AS (
  SELECT c_custkey, n_name, n_nationkey AS k, c_custkey % 5 AS p, c_custkey % 3 = 0 AS noted FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey,
  CASE WHEN p = 1 AND noted THEN NULL WHEN p = 1 THEN concat('S', k) WHEN p = 4 AND NOT noted THEN NULL ELSE concat('U', k) END AS entity_code,
  CASE WHEN p = 1 AND noted THEN concat('标准全称:国网', n_name, '供电公司;标准全称:国网', n_name, '供电公司物资分部') WHEN p = 1 THEN concat('标准全称:国网', n_name, '供电公司物资分部')
    WHEN noted OR p = 0 THEN concat('标准全称:国网', n_name, '供电公司') WHEN p = 2 THEN concat('确认简称:', n_name, '电力') WHEN p = 3 THEN concat('单位代码:U', k) ELSE '' END AS evidence,
  p = 1 AND noted AS conflict FROM v"""

HELD = ["src3", "src7"]


def term_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Names that listed cells and plain cells use, with where they come from; two sources held out."""
    orders = spark.read.parquet(f"{d}/orders.parquet")
    common = ["concat('src', o_custkey % 10) AS entity_code", "o_orderstatus AS business_code", "concat('f', o_custkey % 100) AS source", "o_orderkey % 4 <> 0 AS eligible"]
    lists = orders.selectExpr("'carrier' AS field", "concat('1.《单据', o_orderkey % 40, '》、表（', o_custkey % 3, '、续）；', CASE WHEN o_orderkey % 6 = 0 THEN '无' ELSE concat(' 凭证', o_custkey % 25) END) AS text", *common)
    plain = orders.selectExpr("'department' AS field", "CASE WHEN o_orderkey % 9 = 0 THEN '请填写部门' ELSE concat('第 ', o_custkey % 30, CASE WHEN o_orderkey % 2 = 0 THEN ' 部' ELSE '部' END) END AS text", *common)
    found = evidence.term_catalog(lists.unionByName(plain), HELD)
    return found.select("field", "term", F.array_join("spellings", "|").alias("spellings"), "occurrences", "holdout_occurrences", "eligible_occurrences", "units", "businesses", F.array_join("first_sources", "|").alias("first_sources"), "status")


TERM_SQL = """WITH c AS (SELECT *, concat('src', o_custkey % 10) AS unit, concat('f', o_custkey % 100) AS source, o_orderkey % 4 <> 0 AS eligible, o_custkey % 10 IN (3, 7) AS held FROM orders),
i AS (
  SELECT 'carrier' AS field, concat('单据', o_orderkey % 40) AS spelling, * FROM c UNION ALL SELECT 'carrier', concat('表（', o_custkey % 3, '、续）'), * FROM c
  UNION ALL SELECT 'carrier', concat('凭证', o_custkey % 25), * FROM c WHERE o_orderkey % 6 <> 0
  UNION ALL SELECT 'department', concat('第 ', o_custkey % 30, CASE WHEN o_orderkey % 2 = 0 THEN ' 部' ELSE '部' END), * FROM c WHERE o_orderkey % 9 <> 0),
t AS (SELECT *, replace(translate(spelling, '（）', '()'), ' ', '') AS term FROM i)
SELECT field, term, string_agg(DISTINCT spelling, '|' ORDER BY spelling) AS spellings, count(*) AS occurrences, count(*) FILTER (WHERE held) AS holdout_occurrences, count(*) FILTER (WHERE eligible AND NOT held) AS eligible_occurrences,
  count(DISTINCT unit) AS units, count(DISTINCT o_orderstatus) AS businesses, array_to_string(list_slice(list_sort(list(DISTINCT source)), 1, 3), '|') AS first_sources,
  CASE WHEN count(*) FILTER (WHERE eligible AND NOT held) > 0 THEN 'recognition_only' ELSE 'candidate_only' END AS status
FROM t GROUP BY field, term"""


def template_headers(spark: SparkSession, d: str) -> DataFrame:
    """Header trees of sheets (one a customer) against the template of their region."""
    customers = spark.read.parquet(f"{d}/customer.parquet").join(F.broadcast(spark.read.parquet(f"{d}/nation.parquet")), F.col("c_nationkey") == F.col("n_nationkey"))
    at = F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k")
    leaf = F.when((F.col("c_custkey") % 10 == 0) & (F.col("k") == 3), F.lit("改名")).otherwise(F.concat(F.lit("字 段"), "k"))
    group = F.when((F.col("c_custkey") % 7 == 0) & (F.col("k") == 2), F.lit("别组")).otherwise(F.lit("组"))
    actual = customers.select(F.col("n_name").alias("relative_path"), F.col("c_name").alias("sheet"), F.col("n_regionkey").alias("template"), "c_custkey", at).where("NOT (c_custkey % 11 = 0 AND k = 4)")
    actual = actual.select("relative_path", "sheet", "template", F.concat(F.char(F.col("k") + 64), F.lit("2")).alias("coordinate"), F.array(group, leaf).alias("path"))
    regions = spark.read.parquet(f"{d}/region.parquet").where("r_regionkey < 4").select(F.col("r_regionkey").alias("template"), at)
    expected = regions.select("template", F.concat(F.char(F.col("k") + 64), F.lit("2")).alias("coordinate"), F.array(F.lit("组"), F.concat(F.lit("字段"), "k")).alias("path"))
    found = evidence.header_changes(actual, expected, ["template"])
    return found.select("relative_path", "sheet", "coordinate", F.array_join("expected_path", "/").alias("expected_path"), F.array_join("actual_path", "/").alias("actual_path"))


HEADER_SQL = """SELECT n_name AS relative_path, c_name AS sheet, concat(chr(CAST(64 + k AS INT)), '2') AS coordinate, concat('组/字段', k) AS expected_path,
  CASE WHEN c_custkey % 11 = 0 AND k = 4 THEN NULL ELSE concat(CASE WHEN c_custkey % 7 = 0 AND k = 2 THEN '别组' ELSE '组' END, '/', CASE WHEN c_custkey % 10 = 0 AND k = 3 THEN '改名' ELSE concat('字 段', k) END) END AS actual_path
FROM customer JOIN nation ON c_nationkey = n_nationkey, range(1, 5) AS r(k)
WHERE n_regionkey < 4 AND (c_custkey % 11 = 0 AND k = 4 OR c_custkey % 7 = 0 AND k = 2 OR c_custkey % 10 = 0 AND k = 3)"""

POSITIONS = ["会计", "副主任", "主任", "资金管理", "三级职员", "一级职员", "审核会计"]
DEPARTMENTS = ["财务部", "审计部", "综合室", "物资部", "甲单位"]


def _chosen(names: list[str], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(names)) + " END"


DEPARTMENT, POSITION = _chosen(DEPARTMENTS, "(vec_id % 89 + vec_id) % 5"), _chosen(POSITIONS, "(vec_id % 83 + vec_id) % 7")
LIMITS = {"least_department": 0.05, "least_position": 0.05, "margin": 0.02}


def position_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Rows that the stated queries (ids divisible by 100) may mean, among all rows of their label."""
    rows = spark.read.parquet(f"{d}/embeddings.parquet").selectExpr("vec_id", "label", f"{DEPARTMENT} AS department", f"{POSITION} AS position", "embedding AS department_vector", "embedding AS position_vector")
    asked = rows.where("vec_id % 100 = 0").selectExpr("vec_id AS query", "label", "concat(department, '-', position) AS text", "department_vector", "position_vector")
    return evidence.structured_candidates(asked, rows.withColumnRenamed("vec_id", "candidate"), ["label"], **LIMITS)


CANDIDATE_SQL = f"""WITH e AS (SELECT vec_id, label, embedding, {DEPARTMENT} AS d, {POSITION} AS p FROM embeddings),
pairs AS (
  SELECT q.vec_id AS query, c.vec_id AS candidate, q.p = c.p AS exact, round(CASE WHEN q.d = c.d THEN 1 ELSE list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) END, 6) AS department_score,
    round(CASE WHEN q.p = c.p THEN 1 ELSE list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) END, 6) AS position_score
  FROM e q JOIN e c ON q.label = c.label WHERE q.vec_id % 100 = 0 AND q.d <> '甲单位'
    AND NOT (q.p IN ('主任', '副主任') AND c.p IN ('主任', '副主任') AND q.p <> c.p) AND NOT (q.p IN ('三级职员', '一级职员') AND c.p IN ('三级职员', '一级职员') AND q.p <> c.p)
    AND NOT (q.d IN ('财务部', '审计部', '物资部') AND c.d IN ('财务部', '审计部', '物资部') AND q.d <> c.d)),
scored AS (SELECT *, round(0.3 * department_score + 0.7 * position_score, 6) AS score FROM pairs WHERE department_score >= 0.05 AND position_score >= 0.05),
ranked AS (SELECT *, row_number() OVER w AS rank, lead(exact) OVER w AS next_exact, lead(score) OVER w AS next_score FROM scored WINDOW w AS (PARTITION BY query ORDER BY exact DESC, score DESC, candidate))
SELECT query, candidate, department_score, position_score, score, exact, rank::INT AS rank, rank = 1 AND coalesce(next_exact = exact AND round(score - next_score, 6) < 0.02, false) AS ambiguous, NULL AS reason FROM ranked WHERE rank <= 3
UNION ALL SELECT vec_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN d = '甲单位' THEN 'no_department' ELSE 'no_candidate' END FROM e WHERE vec_id % 100 = 0 AND vec_id NOT IN (SELECT query FROM scored)"""

QUERIES: dict[str, Query] = {"unit_evidence": unit_evidence, "term_provenance": term_provenance, "template_headers": template_headers, "position_candidates": position_candidates}
SQL = {"unit_evidence": UNIT_SQL, "term_provenance": TERM_SQL, "template_headers": HEADER_SQL, "position_candidates": CANDIDATE_SQL}
