"""Reports over the engine's results: statistics, tasks, patterns, causes, differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespark.operators.relational import merged_opinions, run_difference


def statistics(findings: DataFrame) -> DataFrame:
    """Distinct opinions and places by unit, business and rule, with totals of units and of all (null keys)."""
    place = F.struct("file_path", "sheet", "row")
    return findings.rollup("entity_name", "business_id", "display_code").agg(F.count_distinct(place, "message").alias("opinions"), F.count_distinct(place).alias("places"))


def cell_opinions(findings: DataFrame) -> DataFrame:
    """The text of each row's opinion cell: distinct messages in the order of rules."""
    return merged_opinions(findings.where("row IS NOT NULL"), ["entity_code", "business_id", "file_path", "sheet", "row"], "display_code", "message")


def review_tasks(findings: DataFrame) -> DataFrame:
    """Reviews by cause: what one decision would settle."""
    key = F.when(F.col("cause") == "business_difference", F.concat_ws("|", "check_id", "issue_type", "business_id")).otherwise(F.concat_ws("|", "check_id", "issue_type", "field", "file_path", "sheet"))
    return (
        findings.where("severity = 'review'")
        .groupBy(key.alias("task"), "issue_type")
        .agg(F.count(F.lit(1)).alias("findings"), F.count_distinct("entity_code").alias("entities"), F.min("finding_key").alias("first_finding"))
    )


def root_causes(limitations: DataFrame) -> DataFrame:
    """Limitations by cause; what a missing source blocks is counted once per sheet, the rest by check."""
    key = F.when(F.col("cause") == "field_source_unavailable", F.concat_ws("|", "file_path", "sheet", "field")).when(F.col("cause") == "scope_unconfirmed", F.concat_ws("|", "file_path")).otherwise(F.concat_ws("|", "check_id", "issue_type"))
    return limitations.groupBy("cause", key.alias("source")).agg(F.count(F.lit(1)).alias("limitations"), F.count_distinct("record_id").alias("records"), F.count_distinct("check_id").alias("checks"))


def responsibility_patterns(findings: DataFrame, duties: DataFrame) -> DataFrame:
    """Problem signatures of equal (role, duty) texts: rows and how many signatures they show."""
    signs = findings.groupBy("file_path", "sheet", "row").agg(F.array_join(F.array_sort(F.collect_set("issue_type")), "+").alias("signature"))
    joined = duties.join(signs, ["file_path", "sheet", "row"])
    return joined.groupBy("role", "duty", "signature").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("entity_code").alias("entities"))


def capability_report(statuses: DataFrame, limitations: DataFrame) -> DataFrame:
    """Each check with its limitations by category: material, grammar or source."""
    category = F.when(F.col("cause").isin("parser_incomplete", "interpretation_incomplete"), "grammar").when(F.col("cause").isin("field_source_unavailable", "matrix_source_unconfirmed", "scope_unconfirmed"), "source").otherwise("material")
    counted = limitations.groupBy("rule_id", "check_id").agg(*(F.count_if(category == c).alias(c) for c in ("material", "grammar", "source")))
    return statuses.join(counted, ["rule_id", "check_id"], "left").fillna(0, ["material", "grammar", "source"])


def incomplete_items(files: DataFrame, statuses: DataFrame) -> DataFrame:
    """Files that could not be read and checks that failed: (kind, item, reason)."""
    unread = files.where(F.size("parse_errors") > 0).select(F.lit("file").alias("kind"), F.col("relative_path").alias("item"), F.array_join("parse_errors", "；").alias("reason"))
    failed = statuses.where("status = 'failed'").select(F.lit("check"), F.concat_ws("/", "rule_id", "check_id"), F.col("status"))
    return unread.union(failed)


def entity_alerts(files: DataFrame, entities: DataFrame) -> DataFrame:
    """Files of units that are not on the roster, or whose unit is in doubt, by unit."""
    known = entities.select("entity_code").distinct().withColumn("_known", F.lit(True))
    joined = files.join(known, "entity_code", "left")
    reason = F.when(F.col("entity_code").isNull(), "unidentified").when(F.col("entity_conflict"), "conflict").when(F.col("_known").isNull(), "not_on_roster")
    return joined.withColumn("reason", reason).where("reason IS NOT NULL").groupBy("entity_code", "reason").agg(F.count(F.lit(1)).alias("files"), F.min("relative_path").alias("first_file"))


def submission_scope(files: DataFrame) -> DataFrame:
    """The businesses that each unit has uploaded."""
    return files.where("entity_code IS NOT NULL AND business_code IS NOT NULL").select("entity_code", "business_code", F.coalesce("business_id", "business_code").alias("business_id"), "variant_id").distinct()


def snapshot(files: DataFrame, pack_hash: str) -> DataFrame:
    """One row that names a run's inputs: the pack, the number of files and a digest of their digests."""
    return files.agg(F.count(F.lit(1)).alias("files"), F.sum(F.xxhash64("relative_path", "sha256").cast("decimal(38,0)")).cast("string").alias("inputs")).withColumn("pack", F.lit(pack_hash))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Findings added, removed, reworded or of another severity between two runs."""
    return run_difference(before, after, "finding_key", ["severity", "message"])


def vocabulary_relations(candidates: DataFrame) -> DataFrame:
    """Candidate pairs (left, right, score, entity_code) by pair: how often, and between which scores."""
    low, high = F.least("left", "right"), F.greatest("left", "right")
    return candidates.groupBy(low.alias("left"), high.alias("right")).agg(F.count(F.lit(1)).alias("seen"), F.min("score").alias("least"), F.max("score").alias("most"), F.count_distinct("entity_code").alias("entities"))
