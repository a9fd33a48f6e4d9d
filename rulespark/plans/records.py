"""Business records: their schema, and the wide view that checks read."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespark.functions.keys import identity, measure_key, norm_text

SPAN = "array<struct<text:string,start:int,end:int>>"
CELL = f"struct<raw:string,current:string,coordinate:string,formula:string,cached:string,state:string,deleted_spans:{SPAN},deleted_unavailable:boolean,red_spans:{SPAN}>"

RECORDS = (
    "record_type string, entity_code string, business_code string, business_id string, variant_id string, file_path string, sheet string, `row` int, "
    f"fields map<string,{CELL}>, record_id string, person_keys array<struct<name:string,person_id:string,identity_reliable:boolean>>"
)
FILES = (
    "entity_code string, business_code string, business_id string, variant_id string, relative_path string, sha256 string, true_format string, material_type string, "
    "entity_conflict boolean, parse_errors array<string>, sheets array<struct<title:string,sheet_type:string,columns:array<string>,headers:array<string>>>"
)
ENTITIES = "entity_code string, name string, parent string, primary_owner string, active boolean"

SCOPE = ["entity_code", "business_code", "variant_id"]
PLACE = ["file_path", "sheet", "row"]
BASE = ["record_type", *SCOPE, "business_id", *PLACE, "record_id"]

ISSUES = (
    "record_id string, kind string, issue_type string, entity_code string, business_code string, business_id string, variant_id string, "
    "file_path string, sheet string, `row` int, field string, field_absent boolean, identity string, evidence string"
)


def scope_known() -> Column:
    known = F.lit(True)
    for c in SCOPE:
        known = known & (F.coalesce(F.col(c), F.lit("")) != "")
    return known & (F.col("variant_id") != "unknown")


def with_record_id(records: DataFrame) -> DataFrame:
    """Records with an id of their place where they have none."""
    made = identity(*(F.col(c) for c in [*SCOPE, *PLACE]))
    return records.withColumn("record_id", F.coalesce("record_id", made))


def wide(records: DataFrame, fields: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """BASE, and for each field its normalised text and its state.

    States: absent (no such column), unreadable (a formula without a cached
    value), empty, value.  The text of the first two is null, of the third ''.
    The normalising UDF runs once, over all fields of a row in one batch.
    """

    def cell(name: str) -> Column:
        return F.element_at("fields", name)

    texts, states = [], []
    for name in fields:
        readable = cell(name).isNotNull() & (F.coalesce(cell(name)["state"], F.lit("")) != "formula_no_cache")
        texts.append(norm_text(F.when(readable, F.coalesce(cell(name)["current"], F.lit("")))).alias(name))
        states.append(
            F.when(cell(name).isNull(), "absent")
            .when(cell(name)["state"] == "formula_no_cache", "unreadable")
            .when(F.trim(F.coalesce(cell(name)["current"], F.lit(""))) == "", "empty")
            .otherwise("value")
            .alias(f"{name}_state")
        )
    return records.select(*BASE, *keep, *texts, *states)


def with_key(rows: DataFrame, name: str = "measure_id") -> DataFrame:
    """``rows`` with ``key``: the measure numbers, null where there are none."""
    numbers = measure_key(F.col(name))
    return rows.withColumn("key", F.when(F.size(numbers) > 0, numbers))


@dataclass
class Context:
    """What checks look at: all records and files, the roster, baselines and the submitted scope.

    ``answer_headers``: file_path, sheet and the header of the column that the applicability of a sheet was read from.
    """

    records: DataFrame
    files: DataFrame
    entities: DataFrame
    baseline_order: DataFrame | None = None
    scope_entities: list[str] = field(default_factory=list)
    scope_businesses: list[dict[str, Any]] = field(default_factory=list)
    answer_headers: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.records.sparkSession

    def of_type(self, record_type: str) -> DataFrame:
        return self.records.where(F.col("record_type") == record_type)

    def submitted(self, record_type: str) -> DataFrame:
        """Scopes that submitted a sheet or a record of the type, one row each."""
        sheets = self.files.select(*SCOPE, F.explode("sheets.sheet_type").alias("t")).where(F.col("t") == record_type)
        return self.of_type(record_type).select(*SCOPE).unionByName(sheets.select(*SCOPE)).distinct()

    def scopes(self) -> DataFrame:
        """entity x business of the submission: a short list from the configuration."""
        rows = [
            (e, b["business_code"], b.get("business_id") or b["business_code"], b.get("variant_id", "default")) for e in self.scope_entities for b in self.scope_businesses
        ]
        return self.spark.createDataFrame(rows, "entity_code string, business_code string, business_id string, variant_id string")


def issues(rows: DataFrame, kind: Column | str, issue_type: Column | str, field: Column | str | None = None, identity_of: list[str] | None = None, **evidence: Column) -> DataFrame:
    """Rows as issues; columns that the rows lack become null."""

    def given(x: Column | str | None) -> Column:
        return x if isinstance(x, Column) else F.lit(x).cast("string")

    names = {f.name for f in rows.schema.fields}

    def own(name: str, kind: str = "string") -> Column:
        return F.col(name).cast(kind) if name in names else F.lit(None).cast(kind)

    content = F.to_json(F.struct(given(issue_type).alias("issue_type"), *(([given(field).alias("field")]) if field is not None else []), *(v.alias(k) for k, v in evidence.items())))
    which = [evidence[k].cast("string") for k in identity_of or []]
    absent = own("_absent", "boolean")
    return rows.select(
        own("record_id").alias("record_id"),
        given(kind).alias("kind"),
        given(issue_type).alias("issue_type"),
        *(own(c).alias(c) for c in ("entity_code", "business_code", "business_id", "variant_id", "file_path", "sheet")),
        own("row", "int").alias("row"),
        given(field).alias("field"),
        F.coalesce(absent, F.lit(False)).alias("field_absent"),
        identity(given(issue_type), given(field), *which).alias("identity"),
        content.alias("evidence"),
    )


def no_issues(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ISSUES)


