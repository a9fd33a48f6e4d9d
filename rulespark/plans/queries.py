"""The relational operators as queries over the driver's tables, each with its SQL.

Every query runs over whole tables.  Where a check of the rule packs works on
business records, the query applies the same operator to a table of the same
shape: a duty row is a line item, a measure an order, a person a supplier.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespark.functions.keys import identity
from rulespark.operators import matching
from rulespark.operators import relational as ops

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, count(*) OVER w AS repeats FROM lineitem
    WINDOW w AS (PARTITION BY l_partkey, l_suppkey, l_quantity, l_discount) QUALIFY count(*) OVER w > 1"""
)
def duplicate_rows(spark: SparkSession, d: str) -> DataFrame:
    """Line items with equal part, supplier, quantity and discount."""
    rows = load(spark, d, "lineitem").withColumn("at", F.struct("l_orderkey", "l_linenumber"))
    found = ops.equal_rows(rows, ["l_partkey", "l_suppkey", "l_quantity", "l_discount"], "at")
    return found.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "repeats")


@query(
    """SELECT c_custkey, field, problem FROM (
      SELECT c_custkey, 'c_mktsegment' AS field, CASE WHEN c_mktsegment IS NULL THEN 'missing' WHEN trim(c_mktsegment) = '' THEN 'blank' WHEN c_mktsegment IN ('BUILDING') THEN 'placeholder' END AS problem FROM customer WHERE c_acctbal < 0
      UNION ALL SELECT c_custkey, 'c_name', CASE WHEN c_name IS NULL THEN 'missing' WHEN trim(c_name) = '' THEN 'blank' END FROM customer WHERE c_acctbal < 0) WHERE problem IS NOT NULL"""
)
def required_fields(spark: SparkSession, d: str) -> DataFrame:
    found = ops.required_values(load(spark, d, "customer"), ["c_mktsegment", "c_name"], ["BUILDING"], F.col("c_acctbal") < 0)
    return found.select("c_custkey", "field", "problem")


@query("SELECT p_partkey, p_name FROM part WHERE p_name <> '' AND NOT regexp_matches(p_name, '^[a-m]')")
def text_pattern(spark: SparkSession, d: str) -> DataFrame:
    return ops.pattern_misses(load(spark, d, "part"), "p_name", ["^[a-m]"]).select("p_partkey", "p_name")


@query(
    """SELECT doc_id, CASE WHEN contains(text, 'GNU') OR contains(text, 'MIT') THEN 'review' ELSE 'violation' END AS kind FROM documents
    WHERE contains(text, 'license') OR contains(text, 'License')"""
)
def forbidden_reference(spark: SparkSession, d: str) -> DataFrame:
    return ops.forbidden_terms(load(spark, d, "documents"), ["text"], ["license", "License"], ["GNU", "MIT"]).select("doc_id", "kind")


@query(
    """SELECT p_partkey, problem FROM (
      SELECT p_partkey, unnest([CASE WHEN trim(p_type) = '' THEN 'blank' END,
        CASE WHEN (p_type IN ('STANDARD', 'MEDIUM') OR regexp_matches(p_type, '^S')) AND NOT (p_type = 'MEDIUM' OR starts_with(p_type, 'SMA') OR contains(p_type, 'XX')) THEN 'not_concrete' END,
        CASE WHEN contains(p_type, 'PRO') THEN 'several_values' END]) AS problem FROM part) WHERE problem IS NOT NULL"""
)
def field_constraints(spark: SparkSession, d: str) -> DataFrame:
    found = ops.value_constraints(load(spark, d, "part"), "p_type", ["STANDARD", "MEDIUM"], ["^S"], ["PRO"], ["MEDIUM"], ["SMA"], ["XX"])
    return found.select("p_partkey", "problem")


@query(
    """SELECT l_orderkey, l_linenumber, l_suppkey, 'violation' AS kind FROM lineitem
    WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'F' AND o_orderkey = l_orderkey)"""
)
def reference_exists(spark: SparkSession, d: str) -> DataFrame:
    closed = load(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return ops.missing_references(load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), closed, ["l_orderkey"])


@query(
    """SELECT o_orderkey, o_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders x WHERE x.o_orderstatus = 'F' AND x.o_custkey = o.o_custkey) THEN 'violation' ELSE 'review' END AS kind
    FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders x WHERE x.o_orderstatus = 'F' AND x.o_custkey = o.o_custkey AND x.o_orderpriority = o.o_orderpriority)"""
)
def reference_exists_scoped(spark: SparkSession, d: str) -> DataFrame:
    """Orders without a closed order of the same customer and priority; review where the customer has no closed order."""
    rows = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    closed = load(spark, d, "orders").where("o_orderstatus = 'F'")
    return ops.missing_references(rows, closed, ["o_orderpriority"], ["o_custkey"]).select("o_orderkey", "o_custkey", "kind")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def missing_measures(spark: SparkSession, d: str) -> DataFrame:
    items = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    found = ops.presence(load(spark, d, "orders").select("o_orderkey", "o_orderstatus"), items, ["o_orderkey"])
    return found.where("NOT present").drop("present")


@query(
    """SELECT o_orderkey, present, decision FROM (
      SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem) AS present, CASE o_orderstatus WHEN 'F' THEN 'applicable' WHEN 'O' THEN 'not_applicable' ELSE 'empty' END AS decision FROM orders)
    WHERE CASE WHEN present THEN decision = 'not_applicable' ELSE decision = 'applicable' END"""
)
def applicability_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Measures that have a duty row though they don't apply, or lack one though they do; an empty answer passes."""
    decision = F.when(F.col("o_orderstatus") == "F", "applicable").when(F.col("o_orderstatus") == "O", "not_applicable").otherwise("empty")
    items = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    rows = ops.presence(load(spark, d, "orders").select("o_orderkey", decision.alias("decision")), items, ["o_orderkey"])
    wrong = F.when(F.col("present"), F.col("decision") == "not_applicable").otherwise(F.col("decision") == "applicable")
    return rows.where(wrong).select("o_orderkey", "present", "decision")


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, first_value(l_partkey) OVER w AS first_location FROM lineitem
    WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate) QUALIFY row_number() OVER w > 1"""
)
def records_unique(spark: SparkSession, d: str) -> DataFrame:
    found = ops.later_repeats(load(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"], "l_partkey")
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "first_location")


_EVENT_BLOCKS = """WITH m AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS turn
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  n AS (SELECT *, sum(turn) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS block FROM m),
  b AS (SELECT user_id, block, event_type, min(event_id) AS first_id, count(*) AS size FROM n GROUP BY ALL)
"""


@query(_EVENT_BLOCKS + "SELECT user_id, event_type, count(*) AS blocks, sum(size)::BIGINT AS rows FROM b GROUP BY ALL HAVING count(*) > 1")
def ordered_records(spark: SparkSession, d: str) -> DataFrame:
    """Keys that stand in several separate blocks: event types of a user, in the order of time."""
    return ops.scattered_keys(load(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query(_EVENT_BLOCKS + "SELECT user_id, block::BIGINT AS block, event_type, size FROM b")
def record_blocks(spark: SparkSession, d: str) -> DataFrame:
    return ops.blocks(load(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "block", "event_type", "size")


@query(
    """SELECT * FROM (SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_totalprice, o_orderkey) AS previous FROM orders)
    WHERE o_orderkey < previous"""
)
def order_inversions(spark: SparkSession, d: str) -> DataFrame:
    found = ops.inversions(load(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_totalprice", "o_orderkey"], "o_orderkey")
    return found.select("o_custkey", "o_orderkey", "previous")


@query(
    """SELECT l_orderkey, string_agg(l_suppkey, ',' ORDER BY l_suppkey) AS people FROM (
      SELECT l_orderkey, l_suppkey FROM lineitem GROUP BY ALL HAVING bool_or(l_returnflag = 'R') AND bool_or(l_returnflag = 'A')) GROUP BY l_orderkey"""
)
def roles_disjoint(spark: SparkSession, d: str) -> DataFrame:
    found = ops.role_overlap(load(spark, d, "lineitem"), ["l_orderkey"], "l_returnflag", "l_suppkey", "R", "A")
    return found.select("l_orderkey", F.array_join(F.col("people").cast("array<string>"), ",").alias("people"))


@query(
    """SELECT a.l_partkey, a.l_suppkey, a.l_orderkey AS left_l_orderkey, a.l_linenumber AS left_l_linenumber, b.l_orderkey AS right_l_orderkey, b.l_linenumber AS right_l_linenumber
    FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND a.l_returnflag = 'R' AND b.l_returnflag = 'A'"""
)
def roles_same_duty(spark: SparkSession, d: str) -> DataFrame:
    return ops.role_pairs(load(spark, d, "lineitem"), ["l_partkey", "l_suppkey"], "l_returnflag", "R", "A", ["l_orderkey", "l_linenumber"])


@query(
    """WITH used AS (SELECT DISTINCT l_suppkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey),
      allowed AS (SELECT DISTINCT l_suppkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'N' AND l_quantity > 45)
    SELECT l_suppkey, string_agg(p_brand, ',' ORDER BY p_brand) AS excess FROM (
      SELECT * FROM used WHERE l_suppkey IN (SELECT l_suppkey FROM allowed) EXCEPT SELECT * FROM allowed) GROUP BY l_suppkey"""
)
def set_subset(spark: SparkSession, d: str) -> DataFrame:
    """Brands that a supplier delivers beyond those of its large open deliveries."""
    part = load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    items = load(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_quantity").join(part, "l_partkey")
    found = ops.set_excess(items, items.where("l_returnflag = 'N' AND l_quantity > 45"), ["l_suppkey"], "p_brand")
    return found.select("l_suppkey", F.array_join("excess", ",").alias("excess"))


@query(
    """WITH need AS (SELECT DISTINCT l_orderkey AS measure, l_suppkey % 25 AS pair FROM lineitem WHERE l_returnflag = 'R'),
      have AS (SELECT DISTINCT l_orderkey AS measure, l_suppkey % 25 AS pair FROM lineitem WHERE l_returnflag = 'N')
    SELECT measure, pair, CASE WHEN measure IN (SELECT measure FROM have) THEN 'pair_missing' ELSE 'nothing_supplied' END AS reason FROM (SELECT * FROM need EXCEPT SELECT * FROM have)"""
)
def coverage(spark: SparkSession, d: str) -> DataFrame:
    items = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("measure"), (F.col("l_suppkey") % 25).alias("pair"), "l_returnflag")
    return ops.coverage_gaps(items.where("l_returnflag = 'R'"), items.where("l_returnflag = 'N'"), "measure", "pair")


@query(
    """WITH f AS (SELECT conv_id, turn, role, contains(text, '?') AS u, contains(text, 'er') AS a FROM conversations)
    SELECT conv_id, turn, reason, CASE WHEN reason = 'term_missing' THEN 'violation' ELSE 'review' END AS kind FROM (
      SELECT conv_id, turn, CASE WHEN coalesce(role, '') = '' THEN 'role_missing' WHEN role NOT IN ('user', 'assistant') THEN 'role_unknown'
        WHEN coalesce(u, false) AND coalesce(a, false) THEN 'several_roles'
        WHEN NOT coalesce((role = 'user' AND u) OR (role = 'assistant' AND a), false) THEN 'term_missing' END AS reason FROM f) WHERE reason IS NOT NULL"""
)
def value_mapping(spark: SparkSession, d: str) -> DataFrame:
    found = ops.role_terms(load(spark, d, "conversations"), "role", "text", {"user": ["?"], "assistant": ["er"]})
    return found.select("conv_id", "turn", "reason", "kind")


@query(
    """SELECT event_id, array_to_string(list_sort(list_filter(['k', 'source'], lambda x: NOT list_contains(json_keys(props), x))), ',') AS missing FROM events
    WHERE len(list_filter(['k', 'source'], lambda x: NOT list_contains(json_keys(props), x))) > 0"""
)
def schema_contains(spark: SparkSession, d: str) -> DataFrame:
    found = ops.missing_columns(load(spark, d, "events").select("event_id", "props"), F.json_object_keys("props"), ["k", "source"])
    return found.select("event_id", F.array_join("missing", ",").alias("missing"))


@query(
    """WITH e AS (SELECT o_custkey % 100 AS grp, o_orderpriority AS header, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL),
      a AS (SELECT o_custkey % 100 AS grp, o_orderpriority AS header, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL)
    SELECT grp, header, e.n - coalesce(a.n, 0) AS lacking FROM e LEFT JOIN a USING (grp, header) WHERE e.n > coalesce(a.n, 0)"""
)
def schema_bag(spark: SparkSession, d: str) -> DataFrame:
    """Headers compared as bags: priorities of closed orders that open ones have less often, by customer group."""
    rows = load(spark, d, "orders").select((F.col("o_custkey") % 100).alias("grp"), F.col("o_orderpriority").alias("header"), "o_orderstatus")
    return ops.bag_difference(rows.where("o_orderstatus = 'F'"), rows.where("o_orderstatus = 'O'"), "header", ["grp"])


@query(
    """SELECT n_nationkey AS unit, c_mktsegment AS material FROM nation, (SELECT DISTINCT c_mktsegment FROM customer)
    EXCEPT SELECT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 9000"""
)
def required_documents(spark: SparkSession, d: str) -> DataFrame:
    """Units (nations) without a material (segment of a customer with a high balance)."""
    customer = load(spark, d, "customer").select(F.col("c_nationkey").alias("unit"), F.col("c_mktsegment").alias("material"), "c_acctbal")
    units = load(spark, d, "nation").select(F.col("n_nationkey").alias("unit"))
    return ops.missing_combinations(units, customer.select("material"), customer.where("c_acctbal > 9000"))


@query(
    """SELECT coalesce(a.k, b.k) AS custkey, CASE WHEN b.k IS NULL THEN 'left' ELSE 'right' END AS side
    FROM (SELECT DISTINCT c_custkey AS k FROM customer) a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 100000) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL"""
)
def scope_difference(spark: SparkSession, d: str) -> DataFrame:
    return ops.symmetric_difference(
        load(spark, d, "customer").select(F.col("c_custkey").alias("custkey")), load(spark, d, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("custkey")), "custkey"
    )


@query(
    """WITH s AS (SELECT l_partkey, bool_or(o_orderpriority LIKE '%URGENT%' OR o_orderpriority LIKE '%HIGH%') AS small, bool_or(o_orderpriority LIKE '%LOW%') AS eco
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P' GROUP BY l_partkey)
    SELECT p_partkey, p_type AS missing_keywords FROM part LEFT JOIN s ON l_partkey = p_partkey
    WHERE (p_type = 'SMALL' AND NOT coalesce(small, false)) OR (p_type = 'ECONOMY' AND NOT coalesce(eco, false))"""
)
def department_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Parts of a kind that no pending order of a matching priority backs."""
    orders = load(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    supports = load(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey")).join(orders, "l_orderkey").select("p_partkey", "o_orderpriority").distinct()
    found = ops.keyword_support(load(spark, d, "part").select("p_partkey", "p_type"), "p_type", supports, "p_partkey", "o_orderpriority", {"SMALL": ["URGENT", "HIGH"], "ECONOMY": ["LOW"]})
    return found.select("p_partkey", F.array_join("missing_keywords", ",").alias("missing_keywords"))


@query(
    r"""SELECT doc_id, item_id FROM (SELECT doc_id, regexp_replace(text, '[ \t\n\x0B\f\r]+', '', 'g') AS t FROM documents) d
    JOIN (SELECT item_id, regexp_replace(text, '[ \t\n\x0B\f\r]+', '', 'g') AS p FROM benchmark) b ON contains(t, p) WHERE p <> ''"""
)
def deleted_text_reappears(spark: SparkSession, d: str) -> DataFrame:
    """Passages (deleted texts) that stand in a document (a duty), white space aside."""
    return ops.reappearing_texts(load(spark, d, "documents").select("doc_id", "text"), "text", load(spark, d, "benchmark"), "item_id", "text").select("doc_id", "item_id")


@query(
    """SELECT q.vec_id AS query, q.label, c.vec_id AS candidate, round(round(list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6), 4) AS score,
      row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) DESC, c.vec_id) AS rank
    FROM embeddings q JOIN embeddings c ON q.label = c.label AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 QUALIFY rank <= 5"""
)
def candidate_rank(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest vectors of the same label for the stated queries (ids divisible by 100), against all rows."""
    rows = load(spark, d, "embeddings")
    found = ops.ranked_candidates(rows.where("vec_id % 100 = 0"), rows, "label", "vec_id", "embedding", 5)
    return found.select("query", "label", "candidate", F.round("score", 4).alias("score"), "rank")


@query("SELECT doc_id, count(*) OVER (PARTITION BY text) AS copies, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents QUALIFY count(*) OVER (PARTITION BY text) > 1")
def duplicate_text(spark: SparkSession, d: str) -> DataFrame:
    """Documents with equal texts; grouped on a digest, so that no window moves a text."""
    rows = load(spark, d, "documents").select("doc_id", F.sha2(F.col("text"), 256).alias("digest"))
    groups = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")
    return rows.join(groups, "digest").select("doc_id", "copies", "first_id")


@query(
    """SELECT n_regionkey AS unit, c_mktsegment AS business, o_orderpriority AS rule, count(DISTINCT (o_orderkey, o_orderstatus)) AS opinions, count(DISTINCT o_custkey) AS rows
    FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL"""
)
def statistics_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Distinct opinions by unit, business and rule."""
    nation = load(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("unit"))
    customer = load(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", F.col("c_mktsegment").alias("business")).join(F.broadcast(nation), "c_nationkey")
    rows = load(spark, d, "orders").join(customer, "o_custkey")
    return rows.groupBy("unit", "business", F.col("o_orderpriority").alias("rule")).agg(F.count_distinct("o_orderkey", "o_orderstatus").alias("opinions"), F.count_distinct("o_custkey").alias("rows"))


@query("SELECT n_regionkey AS unit, n_nationkey AS business, count(*) AS findings FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey)")
def unit_rollup(spark: SparkSession, d: str) -> DataFrame:
    nation = load(spark, d, "nation").select(F.col("n_nationkey").alias("business"), F.col("n_regionkey").alias("unit"))
    rows = load(spark, d, "customer").select(F.col("c_nationkey").alias("business")).join(F.broadcast(nation), "business")
    return rows.rollup("unit", "business").agg(F.count(F.lit(1)).alias("findings"))


@query(
    """SELECT CASE WHEN l_returnflag = 'R' THEN 'supplier:' || l_suppkey WHEN l_linestatus = 'O' THEN 'order:' || (l_orderkey % 97) ELSE 'line:' || l_linenumber END AS cause,
      count(*) AS limitations, count(DISTINCT l_orderkey) AS records FROM lineitem GROUP BY 1"""
)
def root_cause(spark: SparkSession, d: str) -> DataFrame:
    """Limitations by a cause whose key depends on its type."""
    cause = (
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit("supplier:"), "l_suppkey"))
        .when(F.col("l_linestatus") == "O", F.concat(F.lit("order:"), F.col("l_orderkey") % 97))
        .otherwise(F.concat(F.lit("line:"), "l_linenumber"))
    )
    return load(spark, d, "lineitem").groupBy(cause.alias("cause")).agg(F.count(F.lit(1)).alias("limitations"), F.count_distinct("l_orderkey").alias("records"))


@query(
    """WITH p AS (SELECT user_id, event_type, CASE WHEN value < 5 THEN 'low' WHEN value < 20 THEN 'mid' ELSE 'high' END AS signature FROM events)
    SELECT event_type, signature, count(*) AS rows, count(DISTINCT user_id) AS users, max(per) AS most_by_user FROM (
      SELECT *, count(*) OVER (PARTITION BY event_type, signature, user_id) AS per FROM p) GROUP BY ALL"""
)
def responsibility_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Two-step grouping: by user first, then by pattern."""
    signature = F.when(F.col("value") < 5, "low").when(F.col("value") < 20, "mid").otherwise("high").alias("signature")
    by_user = load(spark, d, "events").groupBy("event_type", signature, "user_id").agg(F.count(F.lit(1)).alias("n"))
    return by_user.groupBy("event_type", "signature").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("users"), F.max("n").alias("most_by_user"))


@query(
    """WITH a AS (SELECT o_orderkey AS k, o_orderpriority AS message FROM orders WHERE o_orderstatus IN ('F', 'P')),
      b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'new wording' ELSE o_orderpriority END AS message FROM orders WHERE o_orderstatus IN ('O', 'P'))
    SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'message_changed' END AS change
    FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.message IS DISTINCT FROM b.message"""
)
def run_diff(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("message"), "o_orderstatus")
    later = rows.where("o_orderstatus IN ('O', 'P')").withColumn("message", F.when(F.col("k") % 3 == 0, "new wording").otherwise(F.col("message")))
    return ops.run_difference(rows.where("o_orderstatus IN ('F', 'P')"), later, "k", ["message"])


@query("SELECT substr(sha256(concat_ws(chr(31), '=' || l_orderkey, '=' || l_linenumber)), 1, 24) AS finding_key, l_orderkey, l_linenumber FROM lineitem GROUP BY ALL")
def finding_identity(spark: SparkSession, d: str) -> DataFrame:
    """One finding per identity: the first of the rows that share a key."""
    rows = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = rows.withColumn("finding_key", identity(F.col("l_orderkey"), F.col("l_linenumber")))
    return ops.first_by_key(rows, "finding_key", ["l_partkey", "l_suppkey", "l_extendedprice"]).select("finding_key", "l_orderkey", "l_linenumber")


@query(
    """SELECT p_type AS rule, count(*) AS considered, sum((p_size > 25)::INT)::BIGINT AS findings, CASE WHEN sum((p_size > 48)::INT) > 0 THEN 'partial' ELSE 'executed' END AS status FROM part GROUP BY p_type"""
)
def status_rollup(spark: SparkSession, d: str) -> DataFrame:
    return (
        load(spark, d, "part")
        .groupBy(F.col("p_type").alias("rule"))
        .agg(F.count(F.lit(1)).alias("considered"), F.count_if(F.col("p_size") > 25).alias("findings"), F.when(F.count_if(F.col("p_size") > 48) > 0, "partial").otherwise("executed").alias("status"))
    )


@query(
    """SELECT term, count(*) AS occurrences, count(DISTINCT source) AS distinct_source, count(DISTINCT lang) AS distinct_lang FROM (
      SELECT source, lang, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z]+')) AS term FROM documents) GROUP BY term"""
)
def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return ops.vocabulary(load(spark, d, "documents").select("source", "lang", "text"), "text", ["source", "lang"])


@query(
    """SELECT o_custkey, string_agg(m, '；' ORDER BY r, m) AS opinion FROM (
      SELECT o_custkey, o_orderpriority AS m, min(o_orderkey % 10) AS r FROM orders GROUP BY ALL) GROUP BY o_custkey"""
)
def opinion_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "orders").select("o_custkey", F.col("o_orderpriority").alias("m"), (F.col("o_orderkey") % 10).alias("r"))
    return ops.merged_opinions(rows, ["o_custkey"], "r", "m")


@query(
    """SELECT l_suppkey AS unit, CASE WHEN l_returnflag = 'R' THEN 'fill:' || l_shipyear ELSE 'confirm:' || l_linestatus END AS task, count(*) AS findings, min(l_orderkey) AS first_record
    FROM (SELECT *, year(l_shipdate) AS l_shipyear FROM lineitem) GROUP BY ALL"""
)
def review_tasks(spark: SparkSession, d: str) -> DataFrame:
    task = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("fill:"), F.year("l_shipdate"))).otherwise(F.concat(F.lit("confirm:"), "l_linestatus"))
    return load(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("unit"), task.alias("task")).agg(F.count(F.lit(1)).alias("findings"), F.min("l_orderkey").alias("first_record"))


@query("SELECT unit, kind, item FROM (SELECT c_nationkey AS unit, 'customer' AS kind, c_name AS item FROM customer WHERE c_acctbal < -500 UNION ALL SELECT s_nationkey, 'supplier', s_name FROM supplier WHERE s_acctbal < 0)")
def incomplete_items(spark: SparkSession, d: str) -> DataFrame:
    """Union of the sources of incomplete results."""
    one = load(spark, d, "customer").where("c_acctbal < -500").select(F.col("c_nationkey").alias("unit"), F.lit("customer").alias("kind"), F.col("c_name").alias("item"))
    two = load(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("unit"), F.lit("supplier").alias("kind"), F.col("s_name").alias("item"))
    return one.unionByName(two)


_SCORES = """WITH s AS (SELECT q.vec_id AS query, c.vec_id AS candidate, round(list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score
    FROM embeddings q JOIN embeddings c ON q.label = c.label AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
  r AS (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS next FROM s WINDOW w AS (PARTITION BY query ORDER BY score DESC, candidate))
"""


@query(
    _SCORES
    + """SELECT query, candidate, CASE WHEN score < 0.15 THEN 'weak' WHEN score - coalesce(next, -1.0) < 0.02 THEN 'ambiguous' ELSE 'accepted' END AS verdict FROM r WHERE n = 1"""
)
def candidate_margin(spark: SparkSession, d: str) -> DataFrame:
    """The best candidate of the stated queries, accepted only with a margin to the next one."""
    rows = load(spark, d, "embeddings")
    ranked = ops.ranked_candidates(rows.where("vec_id % 100 = 0"), rows, "label", "vec_id", "embedding", 2).select("query", "score", "candidate")
    return matching.decided_candidates(ranked, "query", "score", 0.15, 0.02).select("query", "candidate", "verdict")


@query(
    """WITH a AS (SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem WHERE l_returnflag = 'R'),
      b AS (SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem WHERE l_returnflag = 'A')
    SELECT coalesce(a.l_partkey, b.l_partkey) AS l_partkey, coalesce(a.l_suppkey, b.l_suppkey) AS l_suppkey, a.l_orderkey AS left_l_orderkey, a.l_linenumber AS left_l_linenumber,
      b.l_orderkey AS right_l_orderkey, b.l_linenumber AS right_l_linenumber FROM a FULL JOIN b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND a.n = b.n"""
)
def manual_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels and findings paired one to one: line items of either flag by part and supplier."""
    rows, order = load(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]
    return matching.one_to_one(rows.where("l_returnflag = 'R'"), rows.where("l_returnflag = 'A'"), ["l_partkey", "l_suppkey"], order, order)


@query(
    """WITH b AS (SELECT o_custkey, bool_or(o_orderkey < previous) AS bad FROM (SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_totalprice, o_orderkey) AS previous FROM orders) GROUP BY 1)
    SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS new_row FROM orders WHERE o_custkey IN (SELECT o_custkey FROM b WHERE bad)"""
)
def duty_sort(spark: SparkSession, d: str) -> DataFrame:
    """New places for the rows of sheets that are out of order; other sheets stay as they are."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_totalprice", "o_orderkey"))
    rows = load(spark, d, "orders").select("o_custkey", "o_orderkey", place.alias("place"))
    return matching.out_of_order(rows, ["o_custkey"], "place", "o_orderkey").select("o_custkey", "o_orderkey", "new_row")


@query(
    """SELECT o_orderkey, o_orderstatus, t.names AS duty_l_suppkey FROM orders LEFT JOIN (
      SELECT l_orderkey, string_agg(s, '、' ORDER BY s) AS names FROM (SELECT DISTINCT l_orderkey, l_suppkey::VARCHAR AS s FROM lineitem) GROUP BY 1) t ON l_orderkey = o_orderkey"""
)
def enriched_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Measures (orders) with the people of their duty rows (suppliers) beside them."""
    duties = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").cast("string").alias("l_suppkey"))
    return matching.enriched(load(spark, d, "orders").select("o_orderkey", "o_orderstatus"), duties, ["o_orderkey"], ["l_suppkey"])


# The same checks through records, packs and the engine.
from rulespark.plans import audit_queries, evidence_queries, sheet_queries  # noqa: E402

QUERIES |= audit_queries.QUERIES | sheet_queries.QUERIES | evidence_queries.QUERIES
SQL |= audit_queries.SQL | sheet_queries.SQL | evidence_queries.SQL
