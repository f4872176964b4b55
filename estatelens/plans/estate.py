"""An estate of catalogs derived from the given tables, so that metadata work grows with the data.

A customer is a schema, an order a relation, a line item a column; a part is a stored object, and the line items
that name it are its arguments, errors and dependencies; an event is one collector run of a snapshot (its user).
The texts below are plain enough for Spark and DuckDB alike: operators read them as DataFrames, oracles as CTEs.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import measured

_SCH = "'SCH_' || CAST(o_custkey AS STRING)"
_REL = "'T_' || CAST(o_orderkey AS STRING)"
_COL = """CASE l_partkey % 6 WHEN 0 THEN 'created_date_' WHEN 1 THEN 'total_amount_' WHEN 2 THEN 'customer_id_' WHEN 3 THEN 'note_'
  WHEN 4 THEN 'status_' ELSE 'blob_' END || CAST(l_partkey AS STRING) || '_' || CAST(l_suppkey AS STRING) || '_' || CAST(l_linenumber AS STRING)"""
_LO = "FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey"

ESTATE = {
    "e_schemas": "SELECT 'SCH_' || CAST(c_custkey AS STRING) AS schema_name, c_name AS owner_name FROM {customer}",
    "e_relations": f"""SELECT 'SRC_' || CAST(o_custkey % 25 AS STRING) AS source_id, {_SCH} AS schema_name, {_REL} AS relation_name,
      CASE o_orderstatus WHEN 'F' THEN 'TABLE' WHEN 'O' THEN 'VIEW' ELSE 'MATERIALIZED_VIEW' END AS relation_kind FROM {{orders}}""",
    "e_columns": f"""SELECT {_SCH} AS schema_name, {_REL} AS relation_name, {_COL} AS column_name, l_linenumber AS ordinal_position,
      CASE l_linenumber % 4 WHEN 0 THEN 'int4' WHEN 1 THEN 'varchar' WHEN 2 THEN 'timestamp' ELSE 'numeric' END AS data_type,
      l_returnflag <> 'A' AS is_nullable {_LO}""",
    "e_comments": f"""SELECT {_SCH} AS schema_name, {_REL} AS relation_name, {_COL} AS column_name {_LO} WHERE l_returnflag = 'R'""",
    "e_constraints": f"""SELECT {_SCH} AS schema_name, {_REL} AS relation_name, 'K_' || CAST(l_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING) AS constraint_name,
      CASE WHEN l_returnflag = 'A' THEN 'PRIMARY_KEY' WHEN l_returnflag = 'R' THEN 'FOREIGN_KEY' ELSE 'CHECK' END AS constraint_kind, {_COL} AS column_name,
      CASE WHEN l_returnflag = 'R' THEN 'SCH_' || CAST(l_suppkey AS STRING) END AS referenced_schema_name,
      CASE WHEN l_returnflag = 'R' THEN 'T_' || CAST(l_partkey AS STRING) END AS referenced_relation_name,
      CASE WHEN l_returnflag = 'R' THEN 'id' END AS referenced_column_name {_LO} WHERE l_linestatus = 'F'""",
    "e_indexes": f"""SELECT {_SCH} AS schema_name, {_REL} AS relation_name, 'I_' || CAST(l_orderkey AS STRING) || '_' || CAST(l_partkey AS STRING) AS index_name,
      {_COL} AS column_name {_LO} WHERE l_linestatus = 'O' AND l_discount >= 0.05""",
    "e_statistics": f"""SELECT {_SCH} AS schema_name, {_REL} AS relation_name,
      CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN CAST(FLOOR(o_totalprice) AS BIGINT) END AS num_rows_estimate,
      CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate END AS last_analyzed,
      CASE WHEN o_orderpriority = '1-URGENT' THEN 'YES' ELSE 'NO' END AS stale_stats, 'OPTIMIZER_ESTIMATE' AS row_count_semantics
      FROM {{orders}} WHERE o_orderstatus <> 'O'""",
    "e_sizes": f"""SELECT {_SCH} AS schema_name, LOWER({_REL}) AS segment_name, CAST(FLOOR(o_totalprice * 100) AS BIGINT) AS bytes,
      CAST(FLOOR(o_totalprice / 8) AS BIGINT) AS blocks, 'ALLOCATED_SEGMENT_BYTES' AS size_semantics FROM {{orders}} WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')""",
    "e_stored": """SELECT 'SCH_' || CAST(p_partkey AS STRING) AS schema_name, 'P_' || CAST(p_partkey AS STRING) AS object_name,
      CASE p_size % 3 WHEN 0 THEN 'PROCEDURE' WHEN 1 THEN 'FUNCTION' ELSE 'TRIGGER' END AS object_kind,
      CASE WHEN p_size <= 5 THEN 'INVALID' WHEN p_size <= 45 THEN 'VALID' END AS status, CAST(p_size AS BIGINT) AS source_line_count,
      sha2(p_name || p_brand, 256) AS source_hash_sha256 FROM {part}""",
    "e_arguments": """SELECT 'SCH_' || CAST(l_partkey AS STRING) AS schema_name, 'P_' || CAST(l_partkey AS STRING) AS object_name,
      'arg_' || CAST(l_orderkey AS STRING) || '_' || CAST(l_suppkey AS STRING) AS argument_name FROM {lineitem} WHERE l_linenumber = 1""",
    "e_errors": """SELECT 'SCH_' || CAST(l_partkey AS STRING) AS schema_name, 'P_' || CAST(l_partkey AS STRING) AS object_name,
      CAST(l_orderkey AS BIGINT) AS line_number FROM {lineitem} WHERE l_linenumber = 2 AND l_returnflag = 'R'""",
    "e_dependencies": f"""SELECT 'SCH_' || CAST(l_partkey AS STRING) AS source_schema_name, 'P_' || CAST(l_partkey AS STRING) AS source_object_name,
      CASE l_suppkey % 3 WHEN 0 THEN 'PROCEDURE' WHEN 1 THEN 'FUNCTION' ELSE 'TRIGGER' END AS source_object_kind,
      {_SCH} AS target_schema_name, {_REL} AS target_object_name, 'TABLE' AS target_object_kind,
      CASE WHEN l_linestatus = 'F' AND l_returnflag <> 'R' THEN {_COL} END AS target_column_name,
      CASE WHEN l_linestatus = 'F' AND l_returnflag <> 'R' THEN 'PROVEN' ELSE 'NOT_PROVEN' END AS column_resolution_state,
      CASE WHEN l_returnflag = 'R' THEN 'UNRESOLVED' ELSE 'RESOLVED' END AS resolution_state,
      'DEP_' || CAST(l_linenumber AS STRING) AS native_dependency_kind {_LO} WHERE l_linenumber >= 3""",
    "e_extracts": """SELECT 'SNAP_' || CAST(user_id AS STRING) AS snapshot_id, 'q.' || event_type || '.' || CAST(event_id AS STRING) AS query_id,
      CASE event_type WHEN 'view' THEN 'relations' WHEN 'click' THEN 'columns' WHEN 'signup' THEN 'stored-objects' WHEN 'purchase' THEN 'statistics' ELSE 'operations' END AS category,
      CASE WHEN value < 5 THEN 'DENIED' WHEN value < 10 THEN 'TIMEOUT' WHEN value < 14 THEN 'ERROR' WHEN value < 18 THEN 'UNSUPPORTED' WHEN value < 24 THEN 'PARTIAL' ELSE 'SUCCEEDED' END AS state,
      CASE WHEN value < 5 THEN 'ACCESS_DENIED' WHEN value < 10 THEN 'QUERY_TIMEOUT' WHEN value < 14 THEN 'bad reason' WHEN value < 18 THEN 'NOT_AVAILABLE' WHEN value < 24 THEN 'ROW_LIMIT' END AS reason_code,
      CASE WHEN value < 3 THEN CAST(2 AS BIGINT) WHEN value < 18 THEN CAST(0 AS BIGINT) WHEN value > 90 THEN CAST(0 AS BIGINT) ELSE CAST(FLOOR(value) AS BIGINT) END AS row_count
      FROM {events}""",
}


def _tables(text: str) -> set[str]:
    return set(re.findall(r"\{(\w+)\}", text))


def portable(spark: SparkSession, sf: str, text: str, **made: DataFrame) -> DataFrame:
    """Run a portable text over the given tables, and over tables made before."""
    return spark.sql(text, **made, **{t: spark.read.parquet(os.path.join(sf, t + ".parquet")) for t in _tables(text) - set(made)})


PART_ROWS = 1_000_000


def dealt(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Large orders and lineitem dealt by order, as the texts join them, in partitions of some ``PART_ROWS`` rows.

    Bytes say little about such narrow rows: a partition of the usual size holds many millions of them, and a task sorts them all.
    Tables that a dozen partitions hold are left to the planner, which may broadcast one.
    """
    both = {t: spark.read.parquet(os.path.join(sf, t + ".parquet")) for t in ("orders", "lineitem")}
    n = -(-sum(t.count() for t in both.values()) // PART_ROWS)
    return {t: both[t].repartition(n, key) for t, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey"))} if n > 12 else {}


def _joined(spark: SparkSession, sf: str, texts: list[str]) -> list[DataFrame]:
    made = dealt(spark, sf) if any(_LO in x for x in texts) else {}
    return [portable(spark, sf, x, **(made if _LO in x else {})) for x in texts]


def estate(spark: SparkSession, sf: str, *names: str, placed: DataFrame | None = None):
    texts = [ESTATE["e_" + n] for n in names]
    out = _joined(spark, sf, texts) if placed is None else [portable(spark, sf, x.replace(_LO, "FROM {placed}"), **({"placed": placed} if _LO in x else {})) for x in texts]
    return out[0] if len(out) == 1 else out


def placed(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with their order, written once for a job that makes many tables of them, with the columns that the texts name."""
    named = set(re.findall(r"\w+", " ".join(x for x in ESTATE.values() if _LO in x)))
    both = _joined(spark, sf, [f"SELECT * {_LO}"])[0]
    return measured(both.select([x for x in both.columns if x in named]))


def duck(text: str) -> str:
    """The same text for DuckDB."""
    text = re.sub(r"\{(\w+)\}", r"\1", text)
    return re.sub(r"sha2\((.*?), 256\)", r"sha256(\1)", text)


def ctes(*names: str, texts: dict | None = None) -> str:
    src = {**ESTATE, **(texts or {})}
    return "WITH " + ", ".join(f"{n} AS ({duck(src[n])})" for n in names) + " "


SOURCES = {"DB_A": lambda name: "TRUE", "DB_B": lambda name: {"e_columns": "ordinal_position <= 2", "e_dependencies": "source_schema_name < 'SCH_5'"}.get(name, "schema_name < 'SCH_5'")}


def _held(name: str, source: str) -> str:
    return f"SELECT * FROM ({ESTATE[name]}) AS held WHERE {SOURCES[source](name)}"


def sources(spark: SparkSession, sf: str, *names: str) -> list[DataFrame]:
    """Tables of two databases with the same schema and object names, told apart by source_id; the second holds less."""
    held = iter(_joined(spark, sf, [_held("e_" + n, s) for n in names for s in SOURCES]))
    return [next(held).withColumn("source_id", F.lit(a)).unionByName(next(held).withColumn("source_id", F.lit(b))) for a, b in [SOURCES] * len(names)]


def one_source(source: str, *names: str) -> str:
    """CTEs of one of the two databases alone."""
    return ctes(*names, texts={n: _held(n, source) for n in names})


def each_source(body: str, *names: str) -> str:
    """The same SQL over each database alone: what an operator must give if it never mixes them."""
    return " UNION ALL ".join(f"SELECT '{s}' AS source_id, * FROM ({one_source(s, *names)}{body})" for s in SOURCES)
