"""Fact load, projection and report contents bound to the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import evidence as E
from ..operators import relationships as J
from ..session import shared_folder
from ..sources import inventory as I
from ..sources import sinks as K
from .base import Registry, load
from .estate import ctes, estate, placed
from . import workflows as W
from .relationship_plans import _METRICS, _PROF, _all_pairs, _profiles

R = Registry()


@R.add("fact_load", "SELECT l_partkey AS truth_key, l_orderkey, l_linenumber, l_quantity AS metric_value, p_brand, p_type FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size <= 25) ON l_partkey = p_partkey")
def fact_load(spark, sf):
    l, p = load(spark, sf, "lineitem", "part")
    facts = l.select(F.col("l_partkey").alias("truth_key"), "l_orderkey", "l_linenumber", F.col("l_quantity").alias("metric_value"))
    return K.load_fact(facts, p.filter("p_size <= 25").select(F.col("p_partkey").alias("truth_key"), "p_brand", "p_type"))


@R.add("fact_check", "SELECT count(*) AS row_count, count(DISTINCT l_partkey) AS distinct_keys FROM lineitem")
def fact_check(spark, sf):
    return K.fact_check(load(spark, sf, "lineitem").select(F.col("l_partkey").alias("truth_key")))


@R.add("projection_summary", ctes("e_relations", "e_columns", "e_constraints", "e_indexes") + """SELECT schema_name, CAST(sum(r) AS BIGINT) AS relation_count, CAST(sum(c) AS BIGINT) AS column_count, CAST(sum(k) AS BIGINT) AS constraint_count, CAST(sum(i) AS BIGINT) AS index_count FROM (
   SELECT schema_name, 1 AS r, 0 AS c, 0 AS k, 0 AS i FROM e_relations UNION ALL SELECT schema_name, 0, 1, 0, 0 FROM e_columns UNION ALL SELECT schema_name, 0, 0, 1, 0 FROM e_constraints UNION ALL SELECT schema_name, 0, 0, 0, 1 FROM e_indexes) GROUP BY 1""")
def projection_summary(spark, sf):
    return K.projection_summary(C.facts({k: estate(spark, sf, k) for k in K.SECTIONS}), ["schema_name"])


@R.add("projection_detail", ctes("e_columns", "e_relations") + """SELECT sha256('r1:' || c.schema_name || ':' || c.relation_name || ':' || c.column_name) AS row_id, 'r1' AS receipt_id, c.schema_name, c.relation_name, relation_kind, column_name, data_type, ordinal_position, is_nullable
   FROM e_columns c JOIN e_relations r ON r.schema_name = c.schema_name AND r.relation_name = c.relation_name""")
def projection_detail(spark, sf):
    c, r = estate(spark, sf, "columns", "relations")
    return K.projection_detail(C.column_detail(c, r), "r1")


@R.add("machine_report", f"""SELECT p.*, o.*, profiled_columns + candidates AS plan_steps, candidates AS candidate_rows FROM (SELECT count(*) AS profiled_columns, count(*) FILTER (WHERE null_count > 0) AS columns_with_nulls FROM {_PROF}) p,
   (SELECT count(*) AS evaluated_pairs, count(*) FILTER (WHERE eligible) AS candidates, count(*) FILTER (WHERE confidence = 'HIGH') AS high_confidence_candidates, count(*) FILTER (WHERE NOT eligible) AS low_confidence_rejected FROM {_METRICS}) o""")
def machine_report(spark, sf):
    m = J.overlap_metrics(_all_pairs(spark, sf))
    cands = m.filter("eligible").select("source_id", "target_id", "confidence", "overlap_bps")
    return K.machine_report(E.report_summary(_profiles(spark, sf), m), cands).drop("candidates_sha256")


@R.add("ingest_readback", ctes("e_relations", "e_columns") + """SELECT 'catalog_relations' AS table_name, source_id AS snapshot_id, count(*) AS expected_rows, count(*) AS stored_rows, true AS matches FROM e_relations GROUP BY 2
   UNION ALL SELECT 'catalog_columns', 'all', count(*), count(*), true FROM e_columns""")
def ingest_readback(spark, sf):
    """Write two catalog tables, one partition per snapshot, publish, ingest again with one snapshot emptied, and reconcile what is stored."""
    r, c = estate(spark, sf, "relations", "columns")
    root = shared_folder(spark)
    tables = {"catalog_relations": r.withColumn("snapshot_id", F.col("source_id")), "catalog_columns": c.withColumn("snapshot_id", F.lit("all"))}
    snaps = tables["catalog_relations"].select("source_id", "snapshot_id").distinct().withColumn("analyzed_at", F.lit("2024-01-01"))
    gone = tables["catalog_relations"].withColumn("snapshot_id", F.lit("gone"))
    snaps = snaps.unionByName(snaps.select(F.lit("gone").alias("source_id"), F.lit("gone").alias("snapshot_id"), "analyzed_at").distinct())
    K.ingest(tables | {"catalog_relations": tables["catalog_relations"].unionByName(gone)}, snaps, root)
    K.ingest(tables, snaps, root)
    return K.readback(spark, tables, root, snaps)


_CATEGORIES = {"relations": "relations", "columns": "columns", "comments": "comments", "constraints": "constraints", "indexes": "indexes", "stored": "stored-objects", "arguments": "stored-arguments",
               "errors": "stored-errors", "dependencies": "stored-dependencies", "statistics": "statistics", "sizes": "sizes"}


def _published(spark, sf):
    """Two snapshots of the estate with their overviews; the second, which is active, lacks a third of the tables."""
    root, lines = shared_folder(spark), placed(spark, sf)
    for snapshot, kept in (("one", F.lit(True)), ("two", F.col("schema_name") < "SCH_5")):
        cats = {v: estate(spark, sf, k, placed=lines) for k, v in _CATEGORIES.items()}
        cats = {k: (d.where(kept) if "schema_name" in d.columns else d.where("source_schema_name < 'SCH_5'") if snapshot == "two" else d).withColumn("snapshot_id", F.lit(snapshot)) for k, d in cats.items()}
        runs = estate(spark, sf, "extracts").where(F.lit(snapshot == "one") | (F.col("state") != "DENIED")).withColumn("snapshot_id", F.lit(snapshot))
        snaps = spark.range(1).select(F.lit("estate").alias("source_id"), F.lit(snapshot).alias("snapshot_id"), F.lit("2024-01-0" + str(len(snapshot))).alias("analyzed_at"))
        W.ingest_overviews(cats, runs, snaps, root)
    return root


_HELD = "WHERE schema_name < 'SCH_5'"


@R.add("q_active_inventory", ctes("e_relations", "e_columns", "e_stored", "e_errors", "e_comments", "e_arguments", "e_constraints", "e_indexes", "e_statistics", "e_sizes", "e_extracts") + f"""SELECT 'two' AS snapshot_id, schema_name, CAST(sum(r) AS BIGINT) AS relation_count,
   CAST(sum(c) AS BIGINT) AS column_count, CAST(sum(s) AS BIGINT) AS stored_object_count, CAST(sum(i) AS BIGINT) AS invalid_object_count, CAST(sum(e) AS BIGINT) AS compile_issue_count,
   (SELECT count(*) FROM e_extracts WHERE state IN ('TIMEOUT', 'ERROR', 'PARTIAL')) AS denied_unknown_count, (SELECT bool_and(state = 'SUCCEEDED') FROM e_extracts WHERE state <> 'DENIED') AS all_complete FROM (
   SELECT schema_name, 1 AS r, 0 AS c, 0 AS s, 0 AS i, 0 AS e FROM e_relations UNION ALL SELECT schema_name, 0, 1, 0, 0, 0 FROM e_columns UNION ALL SELECT schema_name, 0, 0, 1, CASE WHEN status <> 'VALID' THEN 1 ELSE 0 END, 0 FROM e_stored
   UNION ALL SELECT schema_name, 0, 0, 0, 0, 1 FROM e_errors {" ".join(f"UNION ALL SELECT schema_name, 0, 0, 0, 0, 0 FROM {t}" for t in ("e_comments", "e_arguments", "e_constraints", "e_indexes", "e_statistics", "e_sizes"))}) {_HELD} GROUP BY schema_name""")
def q_active_inventory(spark, sf):
    """Overviews are made at ingest; the question reads the active snapshot's alone."""
    return W.ask_active(spark, _published(spark, sf), "object_inventory_validity", source_id="estate")


@R.add("q_active_blind_spots", ctes("e_extracts") + "SELECT 'two' AS snapshot_id, query_id, category, state, reason_code, row_count FROM e_extracts WHERE state <> 'DENIED'")
def q_active_blind_spots(spark, sf):
    return W.ask_active(spark, _published(spark, sf), "coverage_blind_spots").select("snapshot_id", "query_id", "category", "state", "reason_code", "row_count")


_TABLES = ["nation", "customer", "orders", "lineitem", "events", "documents", "labels"]


@R.add("source_inventory", " UNION ALL ".join(f"""SELECT '{t}' AS table_name, column_name, CAST(column_index AS INTEGER) AS ordinal_position,
   CASE WHEN data_type IN ('BIGINT', 'INTEGER', 'DOUBLE', 'SMALLINT', 'FLOAT') OR data_type LIKE 'DECIMAL%' THEN 'NUMERIC' WHEN data_type LIKE 'TIMESTAMP%' OR data_type = 'DATE' THEN 'TEMPORAL' WHEN data_type = 'BOOLEAN' THEN 'BOOLEAN' ELSE 'TEXT' END AS family,
   (SELECT count(*) FROM {t}) AS n_rows FROM duckdb_columns() WHERE table_name = '{t}'""" for t in _TABLES))
def source_inventory(spark, sf):
    """S5 of the given tables, with the rows of each."""
    tabs = dict(zip(_TABLES, load(spark, sf, *_TABLES)))
    sizes = None
    for t, df in tabs.items():
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows")
        sizes = one if sizes is None else sizes.unionByName(one)
    return I.inventory(spark, tabs).join(sizes, "table_name").select("table_name", "column_name", "ordinal_position", "family", "n_rows")


def _counts(name, table, col):
    return f"SELECT '{name}' AS method, count(*) AS row_count, count(*) - count({col}) AS null_count, count(DISTINCT {col}) AS distinct_count FROM {table}"


@R.add("method_runs", " UNION ALL ".join([_counts("COLUMN_PROFILE", "lineitem", "l_quantity"), _counts("COLUMN_SUMMARY", "orders", "o_orderpriority"), _counts("TEMPORAL_COVERAGE", "orders", "o_orderdate"), _counts("QUALITY_INDICATORS", "customer", "c_mktsegment"),
   *[_counts("TABLE_PROFILE", "nation", x) for x in ("n_nationkey", "n_regionkey")],
   """SELECT 'RELATIONSHIP_OVERLAP', (SELECT count(l_orderkey) FROM lineitem), (SELECT count(DISTINCT l_orderkey) FROM lineitem), (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem INTERSECT SELECT o_orderkey FROM orders))"""]))
def method_runs(spark, sf):
    """R1. Every allowlisted method by its name, over whole tables; an overlap's counts stand in the same columns."""
    l, o, c, n = load(spark, sf, "lineitem", "orders", "customer", "nation")
    runs = [("COLUMN_PROFILE", [l], {"column": "l_quantity", "family": "NUMERIC"}), ("COLUMN_SUMMARY", [o], {"column": "o_orderpriority", "max_rows": None}), ("TEMPORAL_COVERAGE", [o], {"column": "o_orderdate", "max_rows": None}),
            ("QUALITY_INDICATORS", [c], {"column": "c_mktsegment", "max_rows": None}), ("TABLE_PROFILE", [n], {"columns": ["n_nationkey", "n_regionkey"]})]
    out = I.run_method("RELATIONSHIP_OVERLAP", l, o, source_column="l_orderkey", target_column="o_orderkey").select(
        F.lit("RELATIONSHIP_OVERLAP").alias("method"), F.col("source_non_null_count").alias("row_count"), F.col("source_distinct_count").alias("null_count"), F.col("matched_distinct_count").alias("distinct_count"))
    for name, frames, arguments in runs:
        out = out.unionByName(I.run_method(name, *frames, **arguments).select(F.lit(name).alias("method"), "row_count", "null_count", "distinct_count"))
    return out


@R.add("structure_map", ctes("e_relations", "e_constraints", "e_extracts") + """SELECT 'inventory' AS part, schema_name AS a, relation_name AS b, relation_kind AS c FROM e_relations
   UNION ALL SELECT 'relationships', relation_name, column_name, referenced_relation_name FROM e_constraints WHERE constraint_kind = 'FOREIGN_KEY' UNION ALL SELECT 'coverage', snapshot_id, query_id, state FROM e_extracts""")
def structure_map(spark, sf):
    """S10. The map as JSON files, and what they hold."""
    r, k, x = estate(spark, sf, "relations", "constraints", "extracts")
    links = J.declared_links(k)
    root = shared_folder(spark)
    K.write_structure_map(r, links, x, root)
    back = lambda name, schema, *cols: spark.read.schema(schema).json(f"{root}/{name}").select(F.lit(name).alias("part"), *[F.col(c).alias(n) for c, n in zip(cols, "abc")])
    return back("inventory", r.schema, "schema_name", "relation_name", "relation_kind").unionByName(back("relationships", links.schema, "from_table", "from_column", "to_table")).unionByName(
        back("coverage", x.schema, "snapshot_id", "query_id", "state"))
