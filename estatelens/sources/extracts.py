"""Landing catalogs over JDBC and reading landed extracts.

One read per raw catalog table, each with an explicit column list, a per-query timeout and a read-only session.
A failure becomes a coverage state of the collectors that need the table; it never ends the run.
"""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import EXTRACT_SCHEMAS, EXTRACT_STATUS
from .collectors import COLLECTORS, collect


@dataclass(frozen=True)
class Source:
    """A database to read. The password comes from the environment variable it names, never from a profile."""
    source_id: str
    engine: str
    url: str
    user: str
    password_env: str
    schemas: tuple[str, ...] = ()
    timeout_seconds: int = 7
    options: dict = field(default_factory=dict)


# fixed values: catalog columns each raw table lands
RAW_COLUMNS = {
    "mssql": {
        "sys.schemas": "schema_id, name, principal_id", "sys.database_principals": "principal_id, name",
        "sys.objects": "object_id, name, type, schema_id, is_ms_shipped, parent_object_id, create_date, modify_date",
        "sys.tables": "object_id, name, schema_id, is_ms_shipped",
        "sys.columns": "object_id, column_id, name, user_type_id, max_length, precision, scale, is_nullable, is_computed, is_identity, default_object_id",
        "sys.types": "user_type_id, name, schema_id", "sys.default_constraints": "object_id, definition",
        "sys.computed_columns": "object_id, column_id, definition",
        "sys.identity_columns": "object_id, column_id, CONVERT(nvarchar(128), seed_value) AS seed_value, CONVERT(nvarchar(128), increment_value) AS increment_value",
        "sys.key_constraints": "name, type, parent_object_id, unique_index_id",
        "sys.indexes": "object_id, index_id, name, type_desc, type, is_hypothetical, is_unique, is_primary_key, is_unique_constraint, is_disabled, filter_definition, data_space_id",
        "sys.index_columns": "object_id, index_id, column_id, key_ordinal, index_column_id, is_included_column, partition_ordinal",
        "sys.foreign_keys": "object_id, name, parent_object_id, delete_referential_action_desc, update_referential_action_desc, is_disabled, is_not_trusted",
        "sys.foreign_key_columns": "constraint_object_id, constraint_column_id, parent_column_id, referenced_object_id, referenced_column_id",
        "sys.check_constraints": "name, parent_object_id, parent_column_id, definition, is_disabled, is_not_trusted",
        "sys.partitions": "object_id, index_id, partition_number", "sys.data_spaces": "data_space_id, name", "sys.partition_schemes": "data_space_id",
        "sys.sequences": "name, schema_id, user_type_id, precision, scale, CONVERT(nvarchar(128), start_value) AS start_value, CONVERT(nvarchar(128), increment) AS increment, "
                         "CONVERT(nvarchar(128), minimum_value) AS minimum_value, CONVERT(nvarchar(128), maximum_value) AS maximum_value, is_cycling, cache_size, CONVERT(nvarchar(128), current_value) AS current_value",
        "sys.synonyms": "name, schema_id, base_object_name", "sys.sql_modules": "object_id, definition", "sys.triggers": "object_id, is_disabled",
        "sys.sql_expression_dependencies": "referencing_id, referencing_minor_id, referenced_id, referenced_minor_id, referenced_schema_name, referenced_entity_name, referenced_database_name, referenced_server_name, "
                                           "referenced_class_desc, is_schema_bound_reference, is_caller_dependent",
        "sys.databases": "name, compatibility_level",
    },
    "oracle": {
        "all_objects": "owner, object_name, object_type, object_id, status, created, last_ddl_time, temporary",
        "all_tab_cols": "owner, table_name, column_name, column_id, data_type_owner, data_type, data_length, data_precision, data_scale, nullable, virtual_column, data_default_vc",
        "all_tab_identity_cols": "owner, table_name, column_name, generation_type, identity_options", "all_tab_comments": "owner, table_name, comments",
        "all_col_comments": "owner, table_name, column_name, comments",
        "all_constraints": "owner, table_name, constraint_name, constraint_type, r_owner, r_constraint_name, search_condition_vc, delete_rule, status, validated, deferrable, deferred, index_owner, index_name",
        "all_cons_columns": "owner, table_name, constraint_name, column_name, position",
        "all_indexes": "owner, table_owner, table_name, index_name, index_type, uniqueness, status, tablespace_name, leaf_blocks",
        "all_ind_columns": "index_owner, index_name, table_owner, table_name, column_name, column_position",
        "all_ind_expressions": "index_owner, index_name, table_owner, table_name, column_position, column_expression",
        "all_part_indexes": "owner, index_name, partitioning_type, partition_count", "all_part_key_columns": "owner, name, column_name, column_position, object_type",
        "all_sequences": "sequence_owner, sequence_name, increment_by, min_value, max_value, cycle_flag, cache_size, last_number",
        "all_synonyms": "owner, synonym_name, table_owner, table_name, db_link", "all_part_tables": "owner, table_name, partitioning_type, subpartitioning_type, partition_count",
        "all_tab_partitions": "table_owner, table_name, partition_name, subpartition_count, tablespace_name, num_rows, blocks, last_analyzed",
        "all_tab_subpartitions": "table_owner, table_name, partition_name, subpartition_name, tablespace_name, num_rows, blocks, last_analyzed",
        "all_lobs": "owner, table_name, column_name, segment_name, tablespace_name, securefile, compression, deduplication, encrypt, in_row, chunk, retention, cache, logging",
        "all_tables": "owner, table_name, tablespace_name, blocks",
        "all_tab_statistics": "owner, table_name, object_type, partition_name, subpartition_name, num_rows, blocks, avg_row_len, sample_size, last_analyzed, stale_stats",
        "all_ind_statistics": "owner, table_name, index_name, object_type, partition_name, subpartition_name, num_rows, leaf_blocks, distinct_keys, clustering_factor, sample_size, last_analyzed, stale_stats",
        "all_mviews": "owner, mview_name, container_name, build_mode, refresh_mode, refresh_method, fast_refreshable, last_refresh_date, last_refresh_type, staleness, compile_state",
        "all_source": "owner, name, type, line, text", "all_triggers": "owner, trigger_name, status, table_owner, table_name",
        "all_arguments": "owner, package_name, object_name, argument_name, position, sequence, data_level, data_type, type_owner, type_name, type_subname, in_out, defaulted",
        "all_errors": "owner, name, type, sequence, line, position, attribute, message_number, text",
        "all_dependencies": "owner, name, type, referenced_owner, referenced_name, referenced_type, referenced_link_name, dependency_type",
        "all_scheduler_jobs": "owner, job_name, enabled, state, job_type, job_class, program_name, schedule_name, start_date, next_run_date, last_start_date, TO_CHAR(last_run_duration) AS last_run_duration, run_count, failure_count",
        "all_scheduler_programs": "owner, program_name, enabled, program_type, number_of_arguments", "all_scheduler_schedules": "owner, schedule_name, schedule_type, repeat_interval, start_date",
        "all_db_links": "owner, db_link, host, created", "product_component_version": "product, version", "session_privs": "privilege",
        "all_tab_privs": "privilege, table_schema, table_name, grantee", "all_col_privs": "privilege, table_schema, table_name, column_name, grantee",
        "role_tab_privs": "privilege, owner, table_name, role", "session_roles": "role",
    },
    "postgresql": {
        "pg_namespace": "oid::bigint AS oid, nspname, nspowner::bigint AS nspowner", "pg_roles": "oid::bigint AS oid, rolname",
        "pg_class": "oid::bigint AS oid, relname, relnamespace::bigint AS relnamespace, relkind, relpersistence, relrowsecurity, relispartition",
        "pg_attribute": "attrelid::bigint AS attrelid, attname, attnum, atttypid::bigint AS atttypid, attnotnull, atthasdef, attidentity, attgenerated, attisdropped",
        "pg_type": "oid::bigint AS oid, typname, typnamespace::bigint AS typnamespace",
        "pg_constraint": "oid::bigint AS oid, conname, contype, conrelid::bigint AS conrelid, conkey::int[] AS conkey, confrelid::bigint AS confrelid, confkey::int[] AS confkey, confdeltype, confupdtype, "
                         "convalidated, condeferrable, condeferred",
        "pg_rewrite": "oid::bigint AS oid, ev_class::bigint AS ev_class",
        "pg_depend": "objid::bigint AS objid, classid::regclass::text AS classid, refclassid::regclass::text AS refclassid, refobjid::bigint AS refobjid, deptype", "pg_settings": "name, setting",
    },
}
SESSION_QUERIES = {
    ("mssql", "server"): "SELECT DB_NAME() AS database_name, CAST(SERVERPROPERTY('ProductVersion') AS nvarchar(128)) AS product_version, CAST(SERVERPROPERTY('Edition') AS nvarchar(256)) AS edition",
    ("mssql", "granted_permissions"): "SELECT permission_name FROM fn_my_permissions(NULL, 'DATABASE')",
    ("oracle", "session_context"): "SELECT SYS_CONTEXT('USERENV', 'DB_UNIQUE_NAME') AS db_unique_name, SYS_CONTEXT('USERENV', 'CON_NAME') AS con_name, SYS_CONTEXT('USERENV', 'SESSION_USER') AS session_user FROM dual",
    ("postgresql", "server"): "SELECT current_database() AS database_name",
}
# fixed values: raw tables whose rows belong to one schema, and the column that says so
SCOPED = {"oracle": {t: cols.split(",")[0].strip() for t, cols in RAW_COLUMNS["oracle"].items() if cols.split(",")[0].strip() in ("owner", "table_owner", "index_owner", "sequence_owner")}}
SESSION_INIT = {"oracle": "ALTER SESSION SET NLS_NUMERIC_CHARACTERS = '.,'", "postgresql": "SET SESSION CHARACTERISTICS AS TRANSACTION READ ONLY"}


class _Trace(dict):
    """Remembers which raw tables a collector asks for."""

    def __init__(self, inner):
        super().__init__()
        self.inner, self.used = inner, set()

    def __missing__(self, name):
        self.used.add(name)
        return self.inner[name]


def raw_query(source: Source, table: str) -> str:
    """The SELECT that lands one raw table, with declared schemas pushed into it where the table has them."""
    if (source.engine, table) in SESSION_QUERIES:
        return SESSION_QUERIES[(source.engine, table)]
    prefix = "pg_catalog." if source.engine == "postgresql" else ""
    sql = f"SELECT {RAW_COLUMNS[source.engine][table]} FROM {prefix}{table}"
    col = SCOPED.get(source.engine, {}).get(table)
    if col and source.schemas and table not in ("role_tab_privs",):
        if any(not re.fullmatch(r"[A-Z][A-Z0-9_$#]{0,127}", s) for s in source.schemas):
            raise ValueError("schema names must be plain identifiers")
        sql += f" WHERE {col} IN (" + ", ".join(f"'{s}'" for s in source.schemas) + ")"
    return sql


def jdbc_options(source: Source, table: str, password: str | None) -> dict:
    o = {"url": source.url, "query": raw_query(source, table), "user": source.user, "queryTimeout": str(source.timeout_seconds), "fetchsize": "10000", **source.options}
    if password:
        o["password"] = password
    if source.engine == "mssql":
        o.setdefault("applicationIntent", "ReadOnly")
    if source.engine in SESSION_INIT:
        o["sessionInitStatement"] = SESSION_INIT[source.engine]
    return o


def classify_failure(engine: str, message: str) -> tuple[str, str]:
    """Coverage state and reason code of a failed read, from the driver's message."""
    m = message.upper()
    code = (re.search(r"ORA-\d{5}", m) or re.search(r"SQLSTATE[ :=\[]*([0-9A-Z]{5})", m) or re.search(r"\bERROR[ :]+(\d{3,5})", m))
    reason = re.sub(r"[^A-Z0-9_]", "_", code.group(0))[:128] if code else f"{engine.upper()}_QUERY_FAILED"
    if re.search(r"57014|ORA-01013|TIMEOUT|TIMED OUT|ORA-00040", m):
        return "TIMEOUT", reason
    if re.search(r"42501|ORA-01031|ORA-00942|PERMISSION (WAS )?DENIED|\bERROR[ :]+229\b|ACCESS DENIED", m):
        return "DENIED", reason
    if re.search(r"NOT SUPPORTED|UNSUPPORTED|0A000", m):
        return "UNSUPPORTED", reason
    return "ERROR", reason


def land(spark: SparkSession, source: Source, root: str, tables: list[str] | None = None, parallel: int = 4,
         reader: Callable[[SparkSession, dict], DataFrame] | None = None) -> dict[str, tuple[str, str | None]]:
    """S1-S3. Land raw tables below ``root`` as Parquet, each as its own job; returns (state, reason) per table.

    ``reader`` exists so that tests can stand in for a database.
    """
    import os
    read = reader or (lambda s, o: s.read.format("jdbc").options(**o).load())
    names = tables or sorted(RAW_COLUMNS[source.engine]) + [t for e, t in SESSION_QUERIES if e == source.engine]
    password = os.environ.get(source.password_env)

    def one(table):
        try:
            df = read(spark, jdbc_options(source, table, password))
            df.toDF(*[x.lower() for x in df.columns]).write.mode("overwrite").parquet(f"{root}/{source.engine}/{table}/source_id={source.source_id}")
            return table, ("SUCCEEDED", None)
        except Exception as e:  # noqa: BLE001 - every failure is evidence
            return table, classify_failure(source.engine, str(e))

    with ThreadPoolExecutor(parallel) as pool:
        return dict(pool.map(one, names))


class LandedTables(dict):
    """Raw tables of one engine below a landing root; all sources at once, told apart by source_id."""

    def __init__(self, spark, root, engine):
        super().__init__()
        self._args = spark, root, engine

    def __missing__(self, table):
        spark, root, engine = self._args
        self[table] = spark.read.parquet(f"{root}/{engine}/{table}")
        return self[table]


WORST = ["SUCCEEDED", "PARTIAL", "UNSUPPORTED", "TIMEOUT", "DENIED", "ERROR"]


def read_extract(spark: SparkSession, source: Source, query_id: str, root: str, landed: dict[str, tuple[str, str | None]]):
    """S1-S3. One collector over what was landed: (rows or None, status row as DataFrame).

    A collector is as complete as the worst of the tables it reads.
    """
    col = COLLECTORS[query_id]
    trace = _Trace(LandedTables(spark, root, source.engine))
    state, reason, rows, count = "SUCCEEDED", None, None, 0
    bad = None
    try:
        rows = collect(query_id, trace, ["source_id"]).filter(F.col("source_id") == source.source_id)
    except Exception as e:  # noqa: BLE001 - a table that never landed
        bad = classify_failure(source.engine, str(e))
    states = [landed[t] for t in trace.used if t in landed and landed[t][0] != "SUCCEEDED"]
    if states:
        state, reason = max(states, key=lambda s: WORST.index(s[0]))
        rows = None
    elif bad:
        state, reason, rows = bad[0], bad[1], None
    if rows is not None:
        count = rows.count()
    status = spark.createDataFrame([(source.source_id, query_id, col.category, state, reason, count)], EXTRACT_STATUS)
    return rows, status


ENVELOPE = "engine STRING, runtimeValidated BOOLEAN, results MAP<STRING, STRUCT<state: STRING, reasonCode: STRING, rows: STRING>>"


def read_extract_json(spark: SparkSession, path: str) -> DataFrame:
    """S4. Landed result files, one document per file: (path, engine, query_id, state, reason_code, row_count, rows_json)."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", ENVELOPE).alias("d"))
    e = t.select("path", "d.engine", F.explode("d.results").alias("query_id", "r"))
    n = F.coalesce(F.json_array_length("r.rows"), F.lit(0)).cast("long")
    return e.select("path", "engine", "query_id", F.col("r.state").alias("state"), F.col("r.reasonCode").alias("reason_code"), n.alias("row_count"), F.col("r.rows").alias("rows_json"))


def extract_rows(extracts: DataFrame, category: str, query_id: str | None = None) -> DataFrame:
    """Typed rows of one collector from landed JSON, by the schema of its category."""
    qid = query_id or category
    schema = EXTRACT_SCHEMAS[category]
    ddl = "ARRAY<STRUCT<" + ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in schema.fields) + ">>"
    return extracts.filter(F.col("query_id") == qid).select("path", F.inline(F.from_json("rows_json", ddl)))
