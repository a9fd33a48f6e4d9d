"""Work that is done once for equal texts, and tables that stay off the driver."""

import pytest
from pyspark.sql import functions as F

from rulespark.functions import carriers, duties
from rulespark.operators.checks import CHECKS
from rulespark.plans.audit_queries import ROLE_PARAMS, context
from rulespark.sources.stored import by_key, judged_once, stored

DATA = "/root/testdata/sf0.001"


def test_judged_once_keeps_rows_and_nulls(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "b")], "n int, t string")
    out = judged_once(rows, ["t"], lambda said: said.where("t IS NULL OR t != 'b'").withColumn("size", F.length("t")))
    assert sorted(map(tuple, out.select("n", "t", "size").collect())) == [(1, "a", 1), (2, "a", 1), (3, None, None)]


@pytest.mark.parametrize("name, version, kinds, params, module, judge", [
    ("value_mapping", 5, ("clauses",), ROLE_PARAMS, duties, "with_facts"),
    ("responsibility_phrase", 8, ("clauses",), {"attributes": ["真实性"]}, duties, "with_facts"),
    ("set_subset", 5, ("referring", "matrix"), {"source_field": "carrier", "target_record_type": "matrix", "target_field": "carrier", "fallback_explicit_field": "duty"}, carriers, "with_references"),
])
def test_equal_texts_are_read_once(spark, monkeypatch, name, version, kinds, params, module, judge):
    ctx, read, own = context(spark, DATA, kinds), [], getattr(module, judge)
    monkeypatch.setattr(module, judge, lambda rows, *a, **k: (read.append(rows.count()), own(rows, *a, **k))[1])
    rows = ctx.of_type("position_duty")
    CHECKS[name, version](ctx, rows, params)
    assert read and max(read) < rows.count()


def test_stored_tables_are_merged_by_key(spark):
    small = stored(spark.range(10).withColumn("v", F.col("id")))
    plan = spark.range(10).join(by_key(small), "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
