"""New submissions as a stream: each micro-batch goes through the same engine.

Findings are keyed, so a batch that is delivered again adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rulespark.plans.engine import run_engine
from rulespark.plans.pack import Pack
from rulespark.plans.records import RECORDS, Context


def watch_records(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Record files (Parquet) as they arrive in a folder."""
    return spark.readStream.schema(RECORDS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def audit_stream(records: DataFrame, pack: Pack, context: Callable[[DataFrame], Context], out: str, checkpoint: str) -> StreamingQuery:
    """Run the engine on each batch and append findings of keys not seen before, in a folder per batch.

    A submission is a file, so rows that a check compares come in one batch.
    """

    def run(batch: DataFrame, number: int) -> None:
        findings = run_engine(pack, context(batch), run_id=str(number)).findings
        findings.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return records.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_findings(spark: SparkSession, out: str) -> DataFrame:
    """One row a finding over all batches, the latest batch first."""
    found = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    return found.groupBy("finding_key").agg(F.max_by(F.struct(*[c for c in found.columns if c != "finding_key"]), "batch").alias("row")).select("finding_key", "row.*")


def event_windows(events: DataFrame, time: str, kind: str, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Progress events by window and kind, late ones within a watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), kind).agg(F.count(F.lit(1)).alias("events"))
