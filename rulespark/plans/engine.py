"""The engine: a pack and records become findings, statuses and limitations.

Every check is planned on the same records, the issues are united, and one
plan routes, names, dedupes and renders them.  Catalyst sees the whole; nothing
is collected.  A check that can't be planned becomes a failed status.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulespark.functions.keys import identity
from rulespark.operators.checks import CHECKS, PACKAGE_CHECKS
from rulespark.plans.pack import Pack, scope_condition, validate, variants
from rulespark.plans.records import Context, with_record_id
from rulespark.sources.stored import stored

# Issue types that tell of the program or the source, not of the material: (cause, field).
INTERNAL = {
    "applicability_meaning_unresolved": ("interpretation_incomplete", "applicability"),
    "matrix_ambiguous": ("matrix_source_unconfirmed", "measure_id"),
    "coverage_scope_unconfirmed": ("scope_unconfirmed", ""),
    "coverage_applicability_unknown": ("dependency_incomplete", "applicability"),
    "coverage_measure_id_missing": ("dependency_incomplete", "measure_id"),
    "separation_scope_missing": ("dependency_incomplete", "measure_id"),
    "separation_field_unavailable": ("field_source_unavailable", ""),
    "field_unavailable": ("field_source_unavailable", ""),
    "responsibility_unit_unavailable": ("field_source_unavailable", "responsibility"),
    "schema_field_mapping": ("field_source_unavailable", ""),
    "applicability_cache_missing": ("field_source_unavailable", "applicability"),
    "reason_cache_missing": ("field_source_unavailable", "applicability_reason"),
    "person_missing": ("dependency_incomplete", "person_names"),
    "responsibility_unavailable": ("field_source_unavailable", "duty"),
    "carrier_parse_unavailable": ("parser_incomplete", "duty"),
    "carrier_source_unavailable": ("field_source_unavailable", "duty"),
    "carrier_target_unavailable": ("field_source_unavailable", "carrier"),
    "carrier_scope_unconfirmed": ("scope_unconfirmed", ""),
    "carrier_measure_id_missing": ("dependency_incomplete", "measure_id"),
    "responsibility_structure_unresolved": ("parser_incomplete", "duty"),
    "responsibility_role_unresolved": ("parser_incomplete", "duty"),
    "reference_field_unavailable": ("matrix_source_unconfirmed", "measure_id"),
    "reference_matrix_unavailable": ("matrix_source_unconfirmed", "measure_id"),
}

# Reviews that policy 2 shows to the unit if the column itself is missing.
SHOWN_IF_ABSENT = ["field_unavailable", "separation_field_unavailable", "responsibility_unavailable"]
SHOWN_ALWAYS = ["schema_field_mapping"]


@dataclass
class Result:
    findings: DataFrame
    statuses: DataFrame
    limitations: DataFrame
    plan_errors: list[tuple[str, str, str]]


def route(issues: DataFrame, policy: int) -> DataFrame:
    """``kind`` becomes limitation for what policy keeps internal; adds ``channel`` and ``cause``."""
    if policy not in (1, 2):
        return issues.withColumn("channel", F.lit("unit")).withColumn("cause", F.lit(None).cast("string"))
    table = F.create_map(*(x for k, (cause, _) in INTERNAL.items() for x in (F.lit(k), F.lit(cause))))
    shown = F.lit(False)
    if policy == 2:
        shown = F.col("issue_type").isin(SHOWN_ALWAYS) | (F.col("issue_type").isin(SHOWN_IF_ABSENT) & F.col("field_absent"))
    cause = F.when((F.col("kind") == "violation") | shown, "material_problem").otherwise(F.coalesce(F.element_at(table, F.col("issue_type")), F.lit("business_difference")))
    internal = (F.col("kind") == "limitation") | ((F.col("kind") == "review") & ~shown & F.col("issue_type").isin(list(INTERNAL)))
    return (
        issues.withColumn("cause", cause)
        .withColumn("channel", F.when(internal, "internal").otherwise("unit"))
        .withColumn("kind", F.when(internal, "limitation").otherwise(F.col("kind")))
    )


def rendered(template: str) -> Column:
    """A message with {names} filled from the evidence; a name without a value stays as it is."""
    out: list[Column] = []
    for k, part in enumerate(re.split(r"\{(\w+)\}", template)):
        out.append(F.coalesce(F.get_json_object("evidence", f"$.{part}"), F.lit("{" + part + "}")) if k % 2 else F.lit(part))
    return F.concat(*out)


def _planned(pack: Pack, ctx: Context) -> tuple[list[DataFrame], list[DataFrame], list[tuple[str, str, str]]]:
    found, considered, errors = [], [], []
    at = 0
    for rule in pack["rules"]:
        for check in rule["checks"]:
            at += 1
            names = [F.lit(at).alias("check_seq"), F.lit(rule["rule_id"]).alias("rule_id"), F.lit(check["check_id"]).alias("check_id"), F.lit(rule["display_code"]).alias("display_code")]
            enabled = [(v, c) for v, c in variants(pack, rule) if v["enabled"]]
            if not enabled:
                considered.append(ctx.spark.range(1).select(*names, F.lit(0).cast("bigint").alias("records"), F.lit("disabled").alias("state")))
                continue
            try:
                parts, counts = [], []
                for variant, condition in enabled:
                    own = next(c for c in variant["checks"] if c["check_id"] == check["check_id"])
                    run = CHECKS[own["operator"], own["operator_version"]]
                    package = own["operator"] in PACKAGE_CHECKS
                    rows = ctx.records.where(scope_condition(variant["scope"]) & condition)
                    issues = run(ctx, rows, own.get("params", {}))
                    if package:
                        issues = issues.where(F.coalesce(scope_condition(variant["scope"]) & condition, F.lit(True)))
                    message = F.when(F.col("kind") == "violation", rendered(own["message"]["violation"])).otherwise(rendered(own["message"]["review"]))
                    parts.append(issues.select(*names, F.lit(own.get("on_unavailable", "report")).alias("on_unavailable"), F.lit(at * 1000 + len(parts)).alias("part"), message.alias("message"), "*"))
                    counts.append(rows.select(F.lit(1).alias("one")) if not package else ctx.scopes().select(F.lit(1).alias("one")))
            except Exception as e:  # noqa: BLE001  a check that can't be planned must not stop the others
                errors.append((rule["rule_id"], check["check_id"], str(e).splitlines()[0]))
                considered.append(ctx.spark.range(1).select(*names, F.lit(0).cast("bigint").alias("records"), F.lit("failed").alias("state")))
                continue
            found += parts
            for c in counts:
                considered.append(c.agg(F.count(F.lit(1)).alias("records")).select(*names, "records", F.lit("planned").alias("state")))
    return found, considered, errors


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reconcile(findings: DataFrame) -> DataFrame:
    """Drop from a carrier finding the names that a deletion finding of the same row explains; drop it if none is left."""
    place = ["entity_code", "business_code", "variant_id", "file_path", "sheet", "row"]
    named = findings.where("issue_type = 'carrier_reference_unmatched'").select("finding_key", *place, F.explode(F.from_json(F.get_json_object("evidence", "$.missing_references"), "array<string>")).alias("name"))
    deleted = findings.where("kind = 'violation' AND issue_type = 'deleted_matrix_text_reappeared'").select(*place, F.explode(F.from_json(F.get_json_object("evidence", "$.all_texts"), "array<string>")).alias("name")).distinct()
    left = named.join(deleted, [*place, "name"], "left_anti").groupBy("finding_key").agg(F.array_sort(F.collect_set("name")).alias("left_names"))
    joined = findings.join(left, "finding_key", "left")
    carrier = F.col("issue_type") == "carrier_reference_unmatched"
    kept = joined.where(~carrier | F.col("left_names").isNotNull())
    fresh = F.to_json(F.map_concat(F.map_filter(F.from_json("evidence", "map<string,string>"), lambda k, _: k != "missing_references"), F.create_map(F.lit("missing_references"), F.to_json("left_names"))))
    return kept.withColumn("evidence", F.when(carrier, fresh).otherwise(F.col("evidence"))).drop("left_names")


def run_engine(pack: Pack, ctx: Context, run_id: str = "run") -> Result:
    """Plan all checks of a validated pack over the context's records."""
    validate(pack)
    ctx.records = with_record_id(ctx.records)
    parts, considered, errors = _planned(pack, ctx)
    counts = _united(considered).groupBy("check_seq", "rule_id", "check_id", "display_code").agg(F.sum("records").alias("records_considered"), F.max("state").alias("state"))
    if not parts:
        empty = ctx.spark.createDataFrame([], "finding_key string")
        return Result(empty, counts.select("rule_id", "check_id", F.col("state").alias("status"), "records_considered", F.lit(0).alias("findings"), F.lit(0).alias("limitations")), empty, errors)

    # Read six times below: the checks run once.
    routed = stored(route(_united(parts), (pack.get("result_policy") or {}).get("version", 0)))
    limitations = routed.where("kind = 'limitation'")
    stopped = routed.where("kind = 'review' AND on_unavailable = 'fail'")
    visible = routed.where("kind != 'limitation' AND NOT (kind = 'review' AND on_unavailable IN ('skip', 'fail'))")

    who = F.coalesce("record_id", F.concat_ws("|", F.coalesce("entity_code", F.lit("")), F.coalesce("business_id", "business_code", F.lit("")), F.coalesce("variant_id", F.lit("default")), F.coalesce("file_path", F.lit("")), F.coalesce("sheet", F.lit("")), F.lit("material")))
    keyed = visible.withColumn("finding_key", F.sha2(F.concat_ws("|", "rule_id", "check_id", who, "kind", "identity"), 256))
    first = Window.partitionBy("finding_key").orderBy("check_seq", "part", "message")
    findings = keyed.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    findings = reconcile(findings)
    names = ctx.entities.select("entity_code", F.col("name").alias("entity_name"))
    findings = findings.join(names, "entity_code", "left").select(
        "finding_key",
        identity(F.lit(run_id), F.col("finding_key")).alias("finding_id"),
        "rule_id",
        "check_id",
        "display_code",
        F.col("kind").alias("severity"),
        "issue_type",
        "entity_code",
        F.coalesce("entity_name", "entity_code").alias("entity_name"),
        "business_code",
        F.coalesce("business_id", "business_code").alias("business_id"),
        F.coalesce("variant_id", F.lit("default")).alias("variant_id"),
        "file_path",
        "sheet",
        "row",
        "field",
        "message",
        "evidence",
        "cause",
    )
    by = ["rule_id", "check_id"]
    shown = findings.groupBy(*by).agg(F.count(F.lit(1)).alias("findings"))
    kept = limitations.groupBy(*by).agg(F.count(F.lit(1)).alias("limitations"))
    failed = stopped.groupBy(*by).agg(F.count(F.lit(1)).alias("stops"))
    joined = counts.join(shown, by, "left").join(kept, by, "left").join(failed, by, "left").fillna(0, ["findings", "limitations", "stops"])
    status = (
        F.when(F.col("state") == "disabled", "disabled")
        .when((F.col("state") == "failed") | (F.col("stops") > 0), "failed")
        .when(F.col("records_considered") == 0, "scope_excluded")
        .when(F.col("limitations") > 0, "partial")
        .otherwise("executed")
    )
    statuses = joined.select(*by, "display_code", status.alias("status"), "records_considered", "findings", "limitations")
    return Result(findings, statuses, limitations.drop("part", "on_unavailable"), errors)


def ordered(findings: DataFrame) -> DataFrame:
    """The order of reports; only a sink needs it."""
    return findings.orderBy("entity_code", "business_id", "variant_id", "file_path", "sheet", F.coalesce("row", F.lit(0)), "display_code", "check_id")
