"""Coverage ledgers, blind spots and the rule that not seeing is not absence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import BREADTH_THRESHOLD_BPS, COVERAGE_STATES, OBJECT_STATES, PROFILING_STATES, VISIBILITY
from ..functions.scalars import bps, c, domain_map, lit_null

BLIND_TEXT = "Catalog visibility is incomplete; absence must not be interpreted as verified empty."


def visibility(state) -> Column:
    return domain_map(state, VISIBILITY, "UNKNOWN")


def empty_interpretation(state, row_count) -> Column:
    """Only a collector that succeeded and returned nothing proves emptiness."""
    return F.when((c(state) == "SUCCEEDED") & (c(row_count) == 0), "VERIFIED_EMPTY").otherwise("NOT_CLAIMED")


def with_visibility(extracts: DataFrame) -> DataFrame:
    return extracts.withColumn("visibility", visibility("state")).withColumn(
        "empty_interpretation", empty_interpretation("state", "row_count"))


def _state_counts(states) -> list[Column]:
    return [F.count_if(F.col("state") == s).alias(s.lower() + "_count") for s in states]


def coverage_ledger(extracts: DataFrame, keys: list[str] = ["snapshot_id"]) -> DataFrame:
    """A15. One row per snapshot: counts per state, complete, partial, invisible, verified-empty."""
    e = with_visibility(extracts)
    return e.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_queries"), *_state_counts(COVERAGE_STATES),
        F.count_if(F.col("state") == "SUCCEEDED").alias("complete_queries"),
        F.count_if(F.col("state") == "PARTIAL").alias("partial_queries"),
        F.count_if(F.col("state").isin("DENIED", "TIMEOUT", "ERROR")).alias("invisible_or_unknown_queries"),
        F.count_if(F.col("empty_interpretation") == "VERIFIED_EMPTY").alias("verified_empty_queries"),
        F.bool_and(F.col("state") == "SUCCEEDED").alias("all_complete"))


def profiling_coverage(attempts: DataFrame, keys: list[str] = ["snapshot_id"]) -> DataFrame:
    """A16. Attempts per state; only a full success is a claim."""
    return attempts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_attempts"), *_state_counts(PROFILING_STATES),
        F.count_if(F.col("state") == "SUCCEEDED").alias("complete_attempts"),
        F.count_if(F.col("state") == "PARTIAL").alias("partial_attempts"),
        F.count_if(F.col("state") != "SUCCEEDED").alias("non_claimed_attempts"))


def profiling_visibility(state) -> Column:
    return F.when(c(state) == "SUCCEEDED", "VISIBLE_COMPLETE").when(c(state) == "PARTIAL", "VISIBLE_PARTIAL").otherwise("NOT_VISIBLE")


def object_state(state) -> Column:
    return F.when(c(state) == "SUCCEEDED", "COMPLETE").when(c(state).isin("PARTIAL", "DENIED", "UNSUPPORTED"), c(state)).otherwise("UNKNOWN")


def object_coverage(objects: DataFrame, ledger: DataFrame) -> DataFrame:
    """A17, per object: its state is that of the collector that returned it. One collector may return most objects."""
    led = ledger.select("snapshot_id", "query_id", F.col("state").alias("query_state"), "reason_code")
    return objects.join(led, ["snapshot_id", "query_id"], "left").withColumn("state", object_state("query_state")).drop("query_state")


def coverage_gate(objects: DataFrame, keys: list[str] = ["snapshot_id"]) -> DataFrame:
    """A17, per snapshot: classified share in basis points and the breadth-before-depth gate."""
    g = objects.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("visible_objects"), F.count_if(F.col("state") != "UNKNOWN").alias("classified_objects"),
        *_state_counts(OBJECT_STATES))
    return g.withColumn("coverage_bps", bps("classified_objects", "visible_objects")).withColumn(
        "breadth_gate", F.when(F.col("coverage_bps") >= BREADTH_THRESHOLD_BPS, "THRESHOLD").otherwise("BLOCKED"))


def blind_spots(declared: DataFrame, ledger: DataFrame) -> DataFrame:
    """A18. Declared by a query pack (code, description) plus every collector that did not succeed."""
    d = declared.select(
        "code", "description", F.lit("QUERY_PACK_DECLARATION").alias("source"), lit_null().alias("snapshot_id"), lit_null().alias("query_id"),
        lit_null().alias("coverage_state"), lit_null().alias("reason_code"))
    o = ledger.filter(F.col("state") != "SUCCEEDED").select(
        F.concat(F.lit("QUERY_"), "state").alias("code"), F.lit(BLIND_TEXT).alias("description"), F.lit("COVERAGE_LEDGER").alias("source"),
        "snapshot_id", "query_id", F.col("state").alias("coverage_state"), "reason_code")
    return d.unionByName(o)


def caveat(state, empty) -> Column:
    """P19. What a reader may conclude from a collector state."""
    s = c(state)
    return (
        F.when((s == "SUCCEEDED") & (c(empty) == "VERIFIED_EMPTY"), "Collector succeeded with verified empty metadata for its bounded scope.")
        .when(s == "SUCCEEDED", "Collector succeeded for its bounded scope.")
        .when(s == "PARTIAL", "Collector returned partial metadata; do not treat omissions as absence.")
        .when(s == "DENIED", "Collector was denied; evidence is invisible, not absent.")
        .when(s == "TIMEOUT", "Collector timed out; evidence is unknown.")
        .when(s == "ERROR", "Collector errored; evidence is unknown.")
        .otherwise("Collector state is not interpreted as object absence.")
    )


def coverage_rows(extracts: DataFrame) -> DataFrame:
    """A22."""
    return with_visibility(extracts).withColumn("caveat", caveat("state", "empty_interpretation"))


def budget_check(extracts: DataFrame, max_queries: int, max_rows_per_query: int, max_total_rows: int, keys: list[str] = ["snapshot_id"]) -> DataFrame:
    """P11. Budgets per snapshot and what was exceeded."""
    g = extracts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("queries"), F.max("row_count").alias("largest_query"), F.sum("row_count").alias("total_rows"))
    over = F.array_compact(F.array(
        F.when(F.col("queries") > max_queries, "QUERIES"), F.when(F.col("largest_query") > max_rows_per_query, "ROWS_PER_QUERY"),
        F.when(F.col("total_rows") > max_total_rows, "TOTAL_ROWS")))
    return g.withColumn("exceeded", over).withColumn("within_budget", F.size(over) == 0)
