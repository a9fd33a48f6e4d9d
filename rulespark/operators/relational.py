"""The relational core of the checks, over any DataFrame.

Each function is a plan of built-in expressions, joins, windows and aggregates.
Rows are compared only through equality keys; a substring condition is a
residual of such a join.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulespark.functions.keys import contains_any, terms_in

#: Rows of either list in one cell of a product.
CELL_ROWS = 2_000
#: Rows of a narrow look-up table (two numbers) that may be broadcast.
BROADCAST_ROWS = 1_000_000
#: Parts that are tried on every text, rather than looked up.
SHORT_LIST = 500
#: Characters by which parts of texts are looked up: the first size that a part reaches.
GRAM_SIZES = (24, 8, 1)
#: Characters of a text that are read for grams at a time.
PIECE = 128


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(Column.__or__, conditions, F.lit(False))


def required_values(rows: DataFrame, fields: Sequence[str], placeholders: Sequence[str] = (), when: Column | None = None) -> DataFrame:
    """A row for each of ``fields`` that is missing (null), blank or a placeholder, with ``field`` and ``problem``."""
    rows = rows.where(when) if when is not None else rows

    def problem(name: str) -> Column:
        text = F.trim(F.col(name).cast("string"))
        return F.when(text.isNull(), "missing").when(text == "", "blank").when(text.isin(list(placeholders)), "placeholder")

    found = F.array(*(F.struct(F.lit(f).alias("field"), problem(f).alias("problem")) for f in fields))
    return rows.withColumn("_found", F.explode(F.filter(found, lambda x: x["problem"].isNotNull()))).select("*", "_found.field", "_found.problem").drop("_found")


def pattern_misses(rows: DataFrame, text: str, patterns: Sequence[str]) -> DataFrame:
    """Rows whose non-empty text matches none of the patterns."""
    return rows.where((F.col(text) != "") & ~any_of([F.col(text).rlike(p) for p in patterns]))


def forbidden_terms(rows: DataFrame, texts: Sequence[str], terms: Sequence[str], softeners: Sequence[str] = ()) -> DataFrame:
    """Rows that hold a forbidden term, with ``kind`` (review if a softening term is there too) and ``found_terms``."""
    whole = F.concat_ws(" ", *(F.col(t) for t in texts))
    found = rows.withColumn("found_terms", terms_in(whole, list(terms))).where(F.size("found_terms") > 0)
    return found.withColumn("kind", F.when(contains_any(whole, list(softeners)), "review").otherwise("violation"))


def value_constraints(
    rows: DataFrame,
    value: str,
    generic: Sequence[str] = (),
    generic_patterns: Sequence[str] = (),
    separators: Sequence[str] = (),
    exact: Sequence[str] = (),
    prefixes: Sequence[str] = (),
    parts: Sequence[str] = (),
) -> DataFrame:
    """Rows whose value is blank, generic or several values in one, with ``problem``; a row can have two.

    Exceptions (exact, by prefix, by part) excuse generic values only.
    """
    text = F.trim(F.col(value))
    excused = text.isin(list(exact)) | any_of([text.startswith(p) for p in prefixes]) | any_of([text.contains(p) for p in parts])
    vague = text.isin(list(generic)) | any_of([text.rlike(p) for p in generic_patterns])
    problems = F.array(
        F.when(F.coalesce(text, F.lit("")) == "", "blank"),
        F.when(vague & ~excused, "not_concrete"),
        F.when(contains_any(text, list(separators)), "several_values"),
    )
    return rows.withColumn("problem", F.explode(F.array_compact(problems)))


def missing_references(source: DataFrame, target: DataFrame, keys: Sequence[str], scope: Sequence[str] = ()) -> DataFrame:
    """Source rows whose keys the target lacks, with ``kind``: review where the target has no row of the scope at all."""
    missing = source.join(target.select(*scope, *keys).distinct(), [*scope, *keys], "left_anti")
    if not scope:
        return missing.withColumn("kind", F.lit("violation"))
    known = target.select(*scope).distinct().withColumn("_known", F.lit(True))
    return missing.join(known, list(scope), "left").withColumn("kind", F.when(F.col("_known"), "violation").otherwise("review")).drop("_known")


def presence(rows: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with ``present``: whether ``other`` has the keys."""
    have = other.select(*keys).distinct().withColumn("present", F.lit(True))
    return rows.join(have, list(keys), "left").withColumn("present", F.coalesce("present", F.lit(False)))


def later_repeats(rows: DataFrame, keys: Sequence[str], order: Sequence[str], location: str) -> DataFrame:
    """The second and later rows of each key, with the location of the first as ``first_location``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    numbered = rows.withColumn("_n", F.row_number().over(w)).withColumn("first_location", F.first(location).over(w))
    return numbered.where("_n > 1").drop("_n")


def equal_rows(rows: DataFrame, keys: Sequence[str], location: str) -> DataFrame:
    """All rows of each key that occurs more than once, with ``repeats`` and the smallest other location."""
    w = Window.partitionBy(*keys)
    counted = (
        rows.withColumn("repeats", F.count(F.lit(1)).over(w))
        .withColumn("_low", F.min(location).over(w))
        .withColumn("_next", F.lead(location).over(w.orderBy(location)))
        .where("repeats > 1")
    )
    other = F.when(F.col(location) == F.col("_low"), F.col("_next")).otherwise(F.col("_low"))
    return counted.withColumn("other_location", other).drop("_low", "_next")


def blocks(rows: DataFrame, partition: Sequence[str], order: Sequence[str], key: str) -> DataFrame:
    """Runs of equal ``key`` in order: (partition, key, block, first, last, size), blocks numbered from 1; gaps and islands."""
    w = Window.partitionBy(*partition).orderBy(*order)
    before = F.lag(key).over(w)
    marked = rows.withColumn("_turn", F.when((F.row_number().over(w) == 1) | ~F.col(key).eqNullSafe(before), 1).otherwise(0))
    marked = marked.withColumn("block", F.sum("_turn").over(w))
    return marked.groupBy(*partition, "block", key).agg(F.min(F.struct(*order)).alias("first"), F.max(F.struct(*order)).alias("last"), F.count(F.lit(1)).alias("size"))


def scattered_keys(rows: DataFrame, partition: Sequence[str], order: Sequence[str], key: str) -> DataFrame:
    """Keys that stand in more than one block of a partition: (partition, key, blocks, rows)."""
    found = blocks(rows, partition, order, key).groupBy(*partition, key).agg(F.count(F.lit(1)).alias("blocks"), F.sum("size").alias("rows"))
    return found.where("blocks > 1")


def inversions(rows: DataFrame, partition: Sequence[str], order: Sequence[str], key: str) -> DataFrame:
    """Rows whose key is lower than that of the row before, with ``previous``."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return rows.withColumn("previous", F.lag(key).over(w)).where(F.col(key) < F.col("previous"))


def role_overlap(rows: DataFrame, group: Sequence[str], role: str, person: str, left: str, right: str) -> DataFrame:
    """Groups in which a person has both roles: (group, people), people sorted.  Counts pairs of group and person, so no set grows with a group."""
    flags = rows.groupBy(*group, person).agg(F.bool_or(F.col(role) == left).alias("_l"), F.bool_or(F.col(role) == right).alias("_r"))
    return flags.where("_l AND _r").groupBy(*group).agg(F.array_sort(F.collect_set(person)).alias("people"))


def role_pairs(rows: DataFrame, keys: Sequence[str], role: str, left: str, right: str, keep: Sequence[str]) -> DataFrame:
    """Pairs of rows with equal keys, one of either role; ``keep`` comes twice, as left_… and right_…."""
    one = rows.where(F.col(role) == left).select(*keys, *(F.col(c).alias(f"left_{c}") for c in keep))
    two = rows.where(F.col(role) == right).select(*keys, *(F.col(c).alias(f"right_{c}") for c in keep))
    return one.join(two, list(keys))


def set_excess(used: DataFrame, allowed: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """Items used under a key that are not allowed there: (keys, excess), sorted; keys without allowed items are left out."""
    extra = used.select(*keys, item).distinct().join(allowed.select(*keys).distinct(), list(keys), "left_semi").join(allowed.select(*keys, item).distinct(), [*keys, item], "left_anti")
    return extra.groupBy(*keys).agg(F.array_sort(F.collect_set(item)).alias("excess"))


def coverage_gaps(required: DataFrame, supplied: DataFrame, key: str, pair: str) -> DataFrame:
    """Required (key, pair) that are not supplied, with ``reason``: the key has no row, or this pair is missing."""
    gaps = required.select(key, pair).distinct().join(supplied.select(key, pair).distinct(), [key, pair], "left_anti")
    return presence(gaps, supplied, [key]).withColumn("reason", F.when(F.col("present"), "pair_missing").otherwise("nothing_supplied")).drop("present")


def role_terms(rows: DataFrame, role: str, text: str, mapping: dict[str, Sequence[str]]) -> DataFrame:
    """Rows whose text lacks the terms of their role, or has those of several roles, with ``kind`` and ``reason``."""
    hit = {r: contains_any(F.col(text), list(terms)) for r, terms in mapping.items()}
    count = reduce(Column.__add__, [h.cast("int") for h in hit.values()])
    own = F.lit(False)
    for name, found in hit.items():
        own = own | ((F.col(role) == name) & found)
    reason = (
        F.when(F.coalesce(F.col(role), F.lit("")) == "", "role_missing")
        .when(~F.col(role).isin(list(mapping)), "role_unknown")
        .when(count > 1, "several_roles")
        .when(~F.coalesce(own, F.lit(False)), "term_missing")
    )
    return rows.withColumn("reason", reason).where("reason IS NOT NULL").withColumn("kind", F.when(F.col("reason") == "term_missing", "violation").otherwise("review"))


def missing_columns(rows: DataFrame, present: Column, required: Sequence[str]) -> DataFrame:
    """Rows whose set of names lacks required ones, with ``missing``, sorted."""
    return rows.withColumn("missing", F.array_sort(F.array_except(F.array(*(F.lit(r) for r in required)), present))).where(F.size("missing") > 0)


def bag_difference(expected: DataFrame, actual: DataFrame, item: str, group: Sequence[str]) -> DataFrame:
    """Items that stand more often in ``expected`` than in ``actual``: (group, item, lacking)."""
    keys = [*group, item]
    want, have = expected.groupBy(*keys).agg(F.count(F.lit(1)).alias("_want")), actual.groupBy(*keys).agg(F.count(F.lit(1)).alias("_have"))
    return want.join(have, keys, "left").withColumn("lacking", F.col("_want") - F.coalesce("_have", F.lit(0))).where("lacking > 0").select(*keys, "lacking")


def missing_combinations(left: DataFrame, right: DataFrame, present: DataFrame) -> DataFrame:
    """Combinations of the distinct rows of two lists of scope values that ``present`` lacks.

    What is asked for is the rest of a product.  Both lists are dealt by hash
    into cells of about CELL_ROWS rows, so that a task makes one cell of the
    product, however long the lists are.
    """
    one, two = left.distinct(), right.distinct()
    a, b = (max(1, -(-x.count() // CELL_ROWS)) for x in (one, two))
    one = one.withColumn("_a", F.pmod(F.xxhash64(*one.columns), F.lit(a))).withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(b - 1).cast("bigint"))))
    two = two.withColumn("_b", F.pmod(F.xxhash64(*two.columns), F.lit(b))).withColumn("_a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(a - 1).cast("bigint"))))
    both = one.join(two, ["_a", "_b"]).drop("_a", "_b")
    return both.join(present.select(*both.columns).distinct(), both.columns, "left_anti")


def symmetric_difference(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with ``side``: left or right."""
    a, b = one.select(key).distinct().withColumn("_a", F.lit(True)), two.select(key).distinct().withColumn("_b", F.lit(True))
    return a.join(b, key, "full_outer").where("_a IS NULL OR _b IS NULL").select(key, F.when(F.col("_a"), "left").otherwise("right").alias("side"))


def keyword_support(rows: DataFrame, text: str, supports: DataFrame, key: str, support: str, synonyms: dict[str, Sequence[str]]) -> DataFrame:
    """Rows in whose text a keyword stands that no supporting text of the same key backs: (rows, missing_keywords)."""
    backed = F.array_compact(F.array(*(F.when(contains_any(F.col(support), list(names)), F.lit(word)) for word, names in synonyms.items())))
    have = supports.select(key, F.explode(backed).alias("_word")).groupBy(key).agg(F.collect_set("_word").alias("_backed"))
    empty = F.array().cast("array<string>")
    asked = rows.withColumn("_asked", terms_in(F.col(text), list(synonyms))).where(F.size("_asked") > 0)
    out = asked.join(have, key, "left").withColumn("missing_keywords", F.array_sort(F.array_except("_asked", F.coalesce("_backed", empty))))
    return out.where(F.size("missing_keywords") > 0).drop("_asked", "_backed")


def _grams(keyed: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(key, gram): hashes of all stretches of ``size`` characters; a text goes through in pieces, so its length costs no more than once."""
    piece = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{PIECE + size - 1}}})).{{1,{PIECE}}}"), 1)
    pieces = keyed.select(key, F.explode(piece).alias("_piece")).where(F.length("_piece") >= size)
    starts = F.sequence(F.lit(1), F.length("_piece") - (size - 1))
    return pieces.select(key, F.explode(F.transform(starts, lambda i: F.xxhash64(F.substring("_piece", i, size)))).alias("gram"))


def holding(rows: DataFrame, text: str, parts: DataFrame, part: str) -> DataFrame:
    """Each row with each row of ``parts`` whose non-empty part stands in the row's text; all columns of both.

    Up to SHORT_LIST parts are broadcast and tried one after the other, which is
    faster for so few.  Of more, a part is looked up by one gram of its own, the one that fewest parts share;
    the texts are read for grams as they are scanned.  The look-up table (two
    numbers a part) is broadcast up to BROADCAST_ROWS parts and shuffled beyond
    them.  ``contains`` confirms every pair that the grams propose.
    """
    parts = parts.where(F.length(part) > 0)
    if parts.select(F.lit(1)).limit(SHORT_LIST + 1).count() <= SHORT_LIST:
        return rows.join(F.broadcast(parts), F.contains(text, part))
    parts = parts.withColumn("_part", F.xxhash64(part))
    rows = rows.withColumn("_text", F.xxhash64(text))
    size = reduce(lambda c, s: c.when(F.length(part) >= s, s), GRAM_SIZES[1:], F.when(F.length(part) >= GRAM_SIZES[0], GRAM_SIZES[0]))
    sized = parts.select("_part", part, size.alias("_size")).distinct()
    counts = {r["_size"]: r["count"] for r in sized.groupBy("_size").count().collect()}
    proposed: list[DataFrame] = []
    for s, n in counts.items():
        grams = _grams(sized.where(F.col("_size") == s), "_part", part, s).distinct()
        shared = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("_n"))
        anchors = grams.join(shared, "gram").groupBy("_part").agg(F.min(F.struct("_n", "gram")).alias("_best")).select("_part", F.col("_best.gram").alias("gram"))
        found = _grams(rows.select("_text", text), "_text", text, s).join(F.broadcast(anchors) if n <= BROADCAST_ROWS else anchors, "gram")
        proposed.append(found.select("_text", "_part").distinct())
    return rows.join(reduce(DataFrame.unionByName, proposed), "_text").join(parts, "_part").where(F.contains(text, part)).drop("_text", "_part")


def reappearing_texts(rows: DataFrame, text: str, passages: DataFrame, passage_id: str, passage: str) -> DataFrame:
    """(rows, passage_id) for each passage that stands in a row's text, white space aside; an empty passage stands nowhere."""
    squeezed = passages.select(passage_id, F.regexp_replace(passage, r"\s+", "").alias("_passage"))
    return holding(rows.withColumn("_flat", F.regexp_replace(text, r"\s+", "")), "_flat", squeezed, "_passage").drop("_flat", "_passage")


def ranked_candidates(queries: DataFrame, candidates: DataFrame, group: str, item: str, vector: str, top: int) -> DataFrame:
    """The ``top`` candidates of the same group by inner product: (query, group, candidate, score, rank), ties by item.

    ``queries`` are a stated set; each meets the candidates of its group.
    """
    q = queries.select(F.col(group), F.col(item).alias("query"), F.col(vector).alias("_q"))
    c = candidates.select(F.col(group), F.col(item).alias("candidate"), F.col(vector).alias("_c"))
    dot = F.aggregate(F.zip_with("_q", "_c", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda a, x: a + x)
    scored = q.join(c, group).where("query != candidate").select("query", group, "candidate", F.round(dot, 6).alias("score"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "candidate")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def run_difference(before: DataFrame, after: DataFrame, key: str, compared: Sequence[str]) -> DataFrame:
    """Findings of two runs by key: (key, change): added, removed, or the first compared column that changed."""
    a = before.select(key, *(F.col(c).alias(f"_a_{c}") for c in compared), F.lit(True).alias("_a"))
    b = after.select(key, *(F.col(c).alias(f"_b_{c}") for c in compared), F.lit(True).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed")
    for c in compared:
        change = change.when(~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")), f"{c}_changed")
    return a.join(b, key, "full_outer").withColumn("change", change).where("change IS NOT NULL").select(key, "change")


def first_by_key(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def merged_opinions(rows: DataFrame, cell: Sequence[str], rank: str, message: str) -> DataFrame:
    """The distinct messages of each cell in the order of their first rank: (cell, opinion)."""
    first = rows.groupBy(*cell, message).agg(F.min(rank).alias("_r"))
    listed = F.array_sort(F.collect_list(F.struct("_r", message)))
    return first.groupBy(*cell).agg(F.array_join(F.transform(listed, lambda x: x[message]), "；").alias("opinion"))


def vocabulary(rows: DataFrame, text: str, sources: Sequence[str], pattern: str = r"[a-z]+") -> DataFrame:
    """(term, occurrences, and the number of distinct values of each source column)."""
    words = rows.select(*sources, F.explode(F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})"), 1)).alias("term"))
    # Counted by source first: the distinct counts then see a row for each term and source, not for each word.
    by_source = words.groupBy("term", *sources).agg(F.count(F.lit(1)).alias("_n"))
    return by_source.groupBy("term").agg(F.sum("_n").alias("occurrences"), *(F.count_distinct(s).alias(f"distinct_{s}") for s in sources))
