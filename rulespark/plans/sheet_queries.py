"""The readers over sheets that are made of the driver's tables: two lists on each sheet, one a customer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rulespark.sources.stored import spread, stored
from rulespark.sources.tables import header_rows, resolved_columns, title_regions
from rulespark.sources.workbooks import CELLS, records_from_cells

ALIASES = {
    "position_duty": {"measure_id": ["控制措施编号"], "department": ["部门"], "position": ["岗位名称"], "duty": ["岗位职责"]},
    "system_rule": {"measure_id": ["控制措施编号"], "system_rule_name": ["规则名称"], "system_rule_content": ["规则内容"]},
}
CORE = {kind: list(fields) for kind, fields in ALIASES.items()}


def customer_sheets(spark: SparkSession, d: str) -> DataFrame:
    """CELLS: open orders as duties, below a title, and the other orders as rules below the next one.

    Headers are plain, carry notes, or hold the name within a longer one, by customer.
    """
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderpriority", (F.col("o_orderstatus") == "O").alias("open"), F.concat(F.lit("s"), "o_custkey").alias("sheet"))
    # Dealt by sheet once; the windows, and the cells that come of them, stay where they are.
    sheet, k, n = Window.partitionBy("sheet"), F.col("k"), F.col("n")
    orders = spread(orders, "sheet").withColumn("k", F.row_number().over(Window.partitionBy("sheet", "open").orderBy("o_orderkey")))
    orders = orders.withColumn("begins", F.row_number().over(sheet.orderBy("open", "o_orderkey")) == 1).withColumn("n", F.count_if("open").over(sheet))
    style = lambda name: F.when(F.col("o_custkey") % 3 == 0, name).when(F.col("o_custkey") % 3 == 1, f"{name}（必填）\n如实填写").otherwise(f"现{name}")

    def line(row: Column | int, texts: list) -> list[Column]:
        place = (F.lit(row) if isinstance(row, int) else row).cast("int").alias("row")
        return [F.struct(place, F.lit(col + 1).alias("col"), (t if not isinstance(t, str) else F.lit(t)).cast("string").alias("current")) for col, t in enumerate(texts)]

    said = [F.concat(F.lit("X-"), "o_orderkey"), F.concat(F.lit("d"), F.col("o_orderkey") % 7), F.concat(F.lit("p"), F.col("o_orderkey") % 5), F.col("o_orderpriority")]
    heads = [
        *line(1, ["一、岗位职责清单"]), *line(2, [style("控制措施编号"), style("部门"), style("岗位名称"), style("岗位职责")]),
        *line(n + 3, ["二、系统规则清单"]), *line(n + 4, [style("控制措施编号"), style("规则名称"), style("规则内容")]),
    ]
    own = F.when(F.col("open"), F.array(*line(k + 2, said))).when(~F.col("open"), F.array(*line(n + k + 4, [said[0], said[1], said[3]])))
    none = F.array().cast("array<struct<row:int,col:int,current:string>>")
    return as_cells(spark, orders.select(F.lit("f.xlsx").alias("relative_path"), "sheet", F.inline(F.concat(F.when(F.col("begins"), F.array(*heads)).otherwise(none), F.coalesce(own, none)))))


def as_cells(spark: SparkSession, said: DataFrame) -> DataFrame:
    """CELLS of (relative_path, sheet, row, col, current)."""
    whole = said.withColumn("state", F.lit("value")).withColumn("hidden", F.lit(False)).withColumn("column_hidden", F.lit(False))
    whole = whole.withColumn("raw", F.col("current")).withColumn("coordinate", F.concat(F.char(F.col("col") + 64), "row"))
    empty = spark.createDataFrame([], CELLS).schema
    return whole.select(*((F.col(f.name) if f.name in whole.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.fields))


def sheet_records(spark: SparkSession, d: str) -> DataFrame:
    """Records of both lists of every sheet, by their place and fields."""
    cells = stored(customer_sheets(spark, d))
    regions = stored(title_regions(cells))
    scope = spark.createDataFrame([("f.xlsx", "205H", "06", None, None)], "relative_path string, entity_code string, business_code string, business_id string, variant_id string")
    rows = records_from_cells(cells, stored(header_rows(cells, ALIASES, CORE, regions)), scope, regions=regions)
    text = lambda name: F.element_at("fields", name)["current"]
    return rows.select("sheet", "row", "record_type", text("measure_id").alias("measure_id"), F.coalesce(text("department"), text("system_rule_name")).alias("second"), F.coalesce(text("duty"), text("system_rule_content")).alias("last"))


MATRIX = {"matrix": {"measure_id": ["控制措施编号"], "control_measure": ["控制措施"], "responsibility": ["责任主体"], "applicability": ["是否适用"]}}
ANSWER = "CASE o_orderkey % 3 WHEN 0 THEN '适用' WHEN 1 THEN '不适用' ELSE '' END"
OTHER = f"CASE WHEN o_custkey % 5 = 0 THEN {ANSWER} WHEN o_custkey % 5 < 3 THEN '待核实' ELSE CASE o_orderkey % 3 WHEN 0 THEN '不适用' WHEN 1 THEN '适用' ELSE '' END END"


def answer_columns_chosen(spark: SparkSession, d: str) -> DataFrame:
    """Which of two columns of answers counts on each sheet (one a customer): by the unit in the header, by equal or by clear answers."""
    orders = spark.read.parquet(f"{d}/orders.parquet").withColumn("row", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) + 1)
    place = ["concat('f', o_custkey % 3) AS relative_path", "concat('s', o_custkey) AS sheet"]
    heads = orders.select("o_custkey").distinct().selectExpr(*place, "1 AS row", "posexplode(array('控制措施编号', '控制措施', '责任主体', '是否适用', concat('第', o_custkey % 4, '公司是否适用'))) AS (k, current)")
    body = orders.selectExpr(*place, "row", f"posexplode(array(concat('X-', o_orderkey), '核对', '财务部-会计', {ANSWER}, {OTHER})) AS (k, current)").where("current != ''")
    cells = stored(spread(as_cells(spark, heads.unionByName(body).withColumn("col", F.col("k") + 1)), "sheet"))
    names = spark.range(3).select(F.concat(F.lit("f"), "id").alias("relative_path"), F.concat(F.lit("第"), "id", F.lit("公司")).alias("name"))
    chosen = resolved_columns(cells, stored(header_rows(cells, MATRIX, {"matrix": ["measure_id", "control_measure", "responsibility"]})), MATRIX, names)
    return chosen.select("sheet", F.element_at("columns", "applicability").alias("col"), F.element_at("reasons", "applicability").alias("reason"), F.element_at("columns", "responsibility").alias("responsibility"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"sheet_records": sheet_records, "answer_columns_chosen": answer_columns_chosen}
SQL = {
    "sheet_records": """WITH o AS (SELECT *, concat('s', o_custkey) AS sheet, o_orderstatus = 'O' AS open, row_number() OVER (PARTITION BY o_custkey, o_orderstatus = 'O' ORDER BY o_orderkey) AS k FROM orders),
    n AS (SELECT sheet, count(*) FILTER (WHERE open) AS n FROM o GROUP BY sheet)
    SELECT sheet, CAST(CASE WHEN open THEN 2 + k ELSE 4 + n + k END AS INT) AS "row", CASE WHEN open THEN 'position_duty' ELSE 'system_rule' END AS record_type,
      concat('X-', o_orderkey) AS measure_id, concat('d', o_orderkey % 7) AS second, o_orderpriority AS last FROM o JOIN n USING (sheet)""",
    "answer_columns_chosen": """WITH c AS (SELECT o_custkey AS c, bool_or(o_orderkey % 3 < 2) AS answered FROM orders GROUP BY 1),
    r AS (SELECT c, CASE WHEN c % 4 = c % 3 THEN 'current_unit_header' WHEN c % 5 = 0 OR c % 5 > 2 AND NOT answered THEN 'equivalent_columns' WHEN c % 5 < 3 AND answered THEN 'answer_values' ELSE 'column_conflict' END AS reason FROM c)
    SELECT concat('s', c) AS sheet, CASE reason WHEN 'answer_values' THEN 4 WHEN 'column_conflict' THEN NULL ELSE 5 END::INT AS col, reason, 3::INT AS responsibility FROM r""",
}
