"""Where results go: Parquet, JSON lines and CSV, written whole and then moved into place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_result(findings: DataFrame, statuses: DataFrame, limitations: DataFrame, folder: str) -> None:
    """Findings partitioned by unit and business; statuses and limitations beside them."""
    findings.write.mode("overwrite").partitionBy("entity_code", "business_id").parquet(f"{folder}/findings")
    statuses.write.mode("overwrite").json(f"{folder}/statuses")
    limitations.write.mode("overwrite").json(f"{folder}/limitations")


def write_csv(report: DataFrame, path: str) -> None:
    """A report with a header; arrays and structs become JSON."""
    plain = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f.name) for f in report.schema.fields]
    report.select(*plain).write.mode("overwrite").option("header", "true").csv(path)


def without_columns(df: DataFrame, program_columns: list[str]) -> DataFrame:
    """A result without the columns that the program added."""
    return df.drop(*program_columns)


def target_collisions(files: DataFrame) -> DataFrame:
    """Output paths that differ in case only, and so would overwrite each other."""
    return files.groupBy(F.lower("relative_path").alias("target")).agg(F.count_distinct("relative_path").alias("files")).where("files > 1")
