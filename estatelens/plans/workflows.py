"""The entry points end to end, as compositions of operators. Results are lazy DataFrames by name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog, coverage, evidence, graph, metrics, profiling, relationships
from ..sources import extracts, sinks
from ..sources.collectors import COLLECTORS
from ..sources.inventory import inventory


def _union(dfs: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, dfs)


def discover(spark: SparkSession, tables: dict[str, DataFrame], objective: str, keys: dict[str, str] = {}, declared: list[tuple[str, str, str, str]] = (),
             max_rows: int | None = None) -> dict[str, DataFrame]:
    """Autonomous discovery of a database: inventory, priorities, links, profiles, link tests, anomalies, causes, KPIs.

    keys: table -> key column. declared: (child, child column, parent, parent column). max_rows bounds a profile to a
    sample; without it profiles cover whole tables.
    """
    inv = inventory(spark, tables)
    key_rows = F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), F.array(*[F.lit(v) for v in keys.values()])) if keys else None
    is_key = F.coalesce(key_rows[F.col("table_name")] == F.col("column_name"), F.lit(False)) if keys else F.lit(False)
    cols = inv.withColumn("scope", F.lit("db")).withColumn("is_key", is_key)
    goals = spark.range(1).select(F.lit("o").alias("objective_id"), F.lit(objective).alias("objective"))
    decl = spark.createDataFrame([("db", *d) for d in declared], "scope string, from_table string, from_column string, to_table string, to_column string")
    links = decl.select(F.lit("declared_foreign_key").alias("kind"), "*", F.lit(1.0).alias("confidence"), F.lit("declared").alias("evidence")).unionByName(relationships.inferred_links(cols, decl))
    profiles = _union([profiling.sample_profile(df, n=max_rows).withColumn("table_name", F.lit(t)) for t, df in tables.items()])
    tests = [relationships.orphan_probe(tables[a], x, tables[b], y, f"{a}.{x}->{b}.{y}") for a, x, b, y in declared]
    orphans = _union(tests).select("relationship", (~F.col("passed")).alias("is_orphan"), F.lit("orphan_probe").alias("evidence")) if tests else None
    found = profiling.anomalies(profiles, orphans)
    model = metrics.semantic_model(inv.select("table_name", "column_name", F.lower("family").alias("family")))
    out = {"inventory": inv, "priorities": catalog.prioritize_tables(inv, goals), "links": links, "profiles": profiles, "anomalies": found, "causes": profiling.cause_rows(found), "semantic_model": model}
    if tests:
        out["link_tests"] = _union(tests)
    return out


def profile_and_relate(tables: dict[str, DataFrame], constraints: DataFrame, targets: list[tuple[str, str]], schema: str = "main", min_bps: int = 9000) -> dict[str, DataFrame]:
    """Profiles of allowlisted columns, candidate pairs, their overlaps in one job, and the evidence tables.

    targets: (table, column). The pair list is metadata; value work is one job for all pairs.
    """
    one = []
    for t in sorted({t for t, _ in targets}):
        names = [x for a, x in targets if a == t]
        p = profiling.profile_table(tables[t], names)
        types = F.create_map(*[v for x in names for v in (F.lit(x), F.lit(tables[t].schema[x].dataType.simpleString()))])
        one.append(p.select(F.lit(schema).alias("schema_name"), F.lit(t).alias("relation_name"), "column_name", types[F.col("column_name")].alias("native_type"), "type_family",
                            "row_count", "null_count", "distinct_count", F.concat(F.lit(t + "."), "column_name").alias("target_id")))
    profiles = _union(one)
    pairs = relationships.candidate_pairs(profiles.select("schema_name", "relation_name", "column_name", "native_type"), constraints).select(
        F.concat_ws(".", "source_relation_name", "column_name").alias("source_id"), F.concat_ws(".", "target_relation_name", "column_name").alias("target_id")).distinct()
    overlaps = relationships.overlap_metrics(relationships.overlap_all_pairs(relationships.column_values(tables, targets), pairs), min_bps)
    store = evidence.evidence_store(profiles, overlaps)
    return {"profiles": profiles, "pairs": pairs, "overlaps": overlaps, "evidence": store, "steps": evidence.review_steps(store), "summary": evidence.report_summary(profiles, overlaps)}


def analyze(spark: SparkSession, source: extracts.Source, landing: str, store: str, snapshot_id: str, analyzed_at: str, reader=None) -> DataFrame:
    """Land a source, run its collectors, ingest the snapshot and return its coverage ledger.

    A failed read costs its collectors, not the run; nothing is published before every table is written.
    """
    landed = extracts.land(spark, source, landing, reader=reader)
    tables, statuses = {}, []
    for qid, col in COLLECTORS.items():
        if not qid.startswith(source.engine + "."):
            continue
        rows, status = extracts.read_extract(spark, source, qid, landing, landed)
        statuses.append(status)
        if rows is not None:
            tables[qid.replace(".", "_")] = rows.withColumn("snapshot_id", F.lit(snapshot_id))
    extracts_df = _union(statuses).withColumn("snapshot_id", F.lit(snapshot_id))
    tables["catalog_extracts"] = coverage.with_visibility(extracts_df)
    snap = spark.range(1).select(F.lit(source.source_id).alias("source_id"), F.lit(snapshot_id).alias("snapshot_id"), F.lit(source.engine).alias("engine"), F.lit(analyzed_at).alias("analyzed_at"))
    sinks.ingest(tables, snap, store)
    return coverage.coverage_ledger(extracts_df)


SNAPSHOT = ["snapshot_id"]


def overview_tables(categories: dict[str, DataFrame], extracts_df: DataFrame) -> dict[str, DataFrame]:
    """A19-A23. The tables that questions are answered from, per snapshot. categories and extracts carry snapshot_id."""
    c = categories
    relevance = catalog.bi_relevance(*[c[k] for k in ("relations", "columns", "comments")], keys=SNAPSHOT)
    return {"overview_schemas": catalog.schema_summary({k: d for k, d in c.items() if "schema_name" in d.columns}, extracts_df, SNAPSHOT),
            "overview_capacity": catalog.table_capacity(*[c[k] for k in ("relations", "columns", "constraints", "indexes", "statistics", "sizes")], keys=SNAPSHOT),
            "overview_dependencies": catalog.code_dependencies(c["stored-objects"], c["stored-arguments"], c["stored-errors"], c["stored-dependencies"], keys=SNAPSHOT),
            "overview_relevance": relevance,
            "overview_facts": catalog.facts({k: d for k, d in c.items() if k in ("relations", "columns", "stored-objects", "stored-arguments", "stored-errors", "operations")}, keys=SNAPSHOT),
            "overview_coverage": coverage.coverage_rows(extracts_df)}


def ingest_overviews(categories: dict[str, DataFrame], extracts_df: DataFrame, snapshots: DataFrame, root: str) -> None:
    """S8 with A19-A23. Overviews are computed once, when a snapshot comes in, and published with it."""
    sinks.ingest(overview_tables(categories, extracts_df), snapshots, root)


def ask_active(spark: SparkSession, root: str, family: str, **options) -> DataFrame:
    """Q1-Q8 over the overviews of the active snapshots. Only the table the family needs is read, and of it only the
    partitions of active snapshots; ``source_id`` among the options asks about one database."""
    table = {"largest_tables": "capacity", "row_estimates_freshness": "capacity", "object_inventory_validity": "schemas", "dependencies": "dependencies", "stored_logic_signatures": "facts",
             "scheduler_mv_refresh": "facts", "coverage_blind_spots": "coverage", "bi_relevance_candidates": "relevance"}[family]
    role = {"schemas": "overview", "dependencies": "deps"}.get(table, table)
    source = options.pop("source_id", None)
    rows = sinks.active_table(spark, root, "overview_" + table, source)
    return catalog.answer(family, {role: rows}, **options)


def cluster_snapshot(tables: DataFrame, overlaps: DataFrame) -> dict[str, DataFrame]:
    """Clusters of tables over proposed links, with support and confidence. tables: node; overlaps carry source_id,
    target_id (table.column), status and counterevidence."""
    links = overlaps.select(F.split("source_id", r"\.")[0].alias("src"), F.split("target_id", r"\.")[0].alias("dst"), "status", F.size("counterevidence").alias("counter_count"))
    members = graph.clusters(tables, links)
    return {"members": members, "clusters": graph.cluster_summary(members, links)}
