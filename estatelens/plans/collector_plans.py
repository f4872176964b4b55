"""Collectors over raw catalogs that Spark derives from the given tables; each oracle is stated on the tables directly.

A customer is a schema, an order a relation, a line item a column (and key, index, check...), a part a routine.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..session import measured
from ..sources.collectors import COLLECTORS, collect, conform
from .base import Registry, typed
from .estate import _COL, portable

R = Registry()
CN = _COL
SN, RN = "'SCH_' || o_custkey", "'T_' || o_orderkey"
CID = "l_partkey * 1000000 + l_suppkey * 10 + l_linenumber"
OID, LOID = "o_orderkey * 4 + 1", "l_orderkey * 4 + 1"
BIG = f"CAST(l_orderkey AS DECIMAL(19, 0)) * 10000000000000000000 + {CID}"  # of any order and column, each with an id of its own
LO = "{lineitem} JOIN {orders} ON l_orderkey = o_orderkey"
KN = f"'K_' || l_orderkey || '_' || ({CID})"
IN = f"'I_' || l_orderkey || '_' || ({CID})"
PTYPE = "CASE p_size % 6 WHEN 0 THEN 'P ' WHEN 1 THEN 'FN' WHEN 2 THEN 'TR' WHEN 3 THEN 'IF' WHEN 4 THEN 'SN' ELSE 'PC' END"
PKIND = "CASE p_size % 6 WHEN 1 THEN 'FUNCTION' WHEN 2 THEN 'TRIGGER' WHEN 3 THEN 'FUNCTION' ELSE 'PROCEDURE' END"
OKIND = "CASE p_size % 6 WHEN 0 THEN 'PROCEDURE' WHEN 1 THEN 'FUNCTION' WHEN 2 THEN 'TRIGGER' WHEN 3 THEN 'PACKAGE' WHEN 4 THEN 'SEQUENCE' ELSE 'PACKAGE BODY' END"

MSSQL = {
    "sys.schemas": "SELECT c_custkey + 1000 AS schema_id, 'SCH_' || c_custkey AS name, c_nationkey AS principal_id FROM {customer} UNION ALL SELECT 4, 'sys', 0 FROM {region} WHERE r_regionkey = 0",
    "sys.database_principals": "SELECT n_nationkey AS principal_id, n_name AS name FROM {nation} WHERE n_regionkey <> 3",
    "sys.objects": f"""SELECT {OID} AS object_id, {RN} AS name, CASE o_orderstatus WHEN 'O' THEN 'V ' ELSE 'U ' END AS type, o_custkey + 1000 AS schema_id, o_orderstatus = 'P' AS is_ms_shipped, 0L AS parent_object_id, o_orderdate AS create_date, o_orderdate AS modify_date FROM {{orders}}
       UNION ALL SELECT p_partkey * 4 + 2, 'P_' || p_partkey, {PTYPE}, p_partkey + 1000, p_size > 48, CASE WHEN p_size % 6 = 2 THEN p_partkey * 4 + 1 ELSE 0 END, NULL, NULL FROM {{part}}""",
    "sys.tables": f"SELECT {OID} AS object_id, {RN} AS name, o_custkey + 1000 AS schema_id, o_orderstatus = 'P' AS is_ms_shipped FROM {{orders}} WHERE o_orderstatus <> 'O'",
    "sys.columns": f"""SELECT {LOID} AS object_id, {CID} AS column_id, {CN} AS name, l_linenumber AS user_type_id, CAST(l_quantity AS INT) AS max_length, l_linenumber AS precision, 0 AS scale, l_returnflag <> 'A' AS is_nullable,
       l_discount = 0.1 AS is_computed, l_discount = 0.0 AS is_identity, CASE WHEN l_tax = 0.08 THEN {BIG} ELSE 0 END AS default_object_id FROM {{lineitem}}""",
    "sys.types": "SELECT DISTINCT l_linenumber AS user_type_id, 't' || l_linenumber AS name, CASE WHEN l_linenumber > 0 THEN 4L ELSE 1L END AS schema_id FROM {lineitem}",
    "sys.default_constraints": f"SELECT {BIG} AS object_id, '((' || CAST(l_quantity AS INT) || '))' AS definition FROM {{lineitem}} WHERE l_tax = 0.08",
    "sys.computed_columns": f"SELECT {LOID} AS object_id, {CID} AS column_id, '(' || l_returnflag || ')' AS definition FROM {{lineitem}} WHERE l_discount = 0.1",
    "sys.identity_columns": f"SELECT {LOID} AS object_id, {CID} AS column_id, 1 AS seed_value, l_linenumber AS increment_value FROM {{lineitem}} WHERE l_discount = 0.0",
    "sys.key_constraints": f"SELECT {KN} AS name, CASE WHEN l_tax < 0.04 THEN 'PK' ELSE 'UQ' END AS type, {LOID} AS parent_object_id, {CID} AS unique_index_id FROM {{lineitem}} WHERE l_discount = 0.05",
    "sys.indexes": f"""SELECT {LOID} AS object_id, {CID} AS index_id, {IN} AS name, 'KIND_' || l_linenumber % 3 AS type_desc, l_linenumber % 3 AS type, l_tax = 0.07 AS is_hypothetical, l_linestatus = 'F' AS is_unique, l_discount = 0.05 AND l_tax < 0.04 AS is_primary_key,
       l_discount = 0.05 AND l_tax >= 0.04 AS is_unique_constraint, l_returnflag = 'R' AS is_disabled, CASE WHEN l_returnflag = 'N' THEN 'x > 1' END AS filter_definition, l_linenumber AS data_space_id FROM {{lineitem}} WHERE l_discount >= 0.05""",
    "sys.index_columns": f"SELECT {LOID} AS object_id, {CID} AS index_id, {CID} AS column_id, CASE WHEN l_discount = 0.06 THEN 0 ELSE 1 END AS key_ordinal, 1 AS index_column_id, l_discount = 0.06 AS is_included_column, CASE WHEN l_linenumber = 2 THEN 1 ELSE 0 END AS partition_ordinal FROM {{lineitem}} WHERE l_discount >= 0.05",
    "sys.foreign_keys": f"SELECT {BIG} AS object_id, {KN} AS name, {LOID} AS parent_object_id, 'NO_ACTION' AS delete_referential_action_desc, 'CASCADE' AS update_referential_action_desc, l_linestatus = 'F' AS is_disabled, l_returnflag = 'N' AS is_not_trusted FROM {{lineitem}} WHERE l_discount = 0.03",
    "sys.foreign_key_columns": f"SELECT {BIG} AS constraint_object_id, 1 AS constraint_column_id, {CID} AS parent_column_id, {LOID} AS referenced_object_id, {CID} AS referenced_column_id FROM {{lineitem}} WHERE l_discount = 0.03",
    "sys.check_constraints": f"SELECT {KN} AS name, {LOID} AS parent_object_id, CASE WHEN l_linenumber = 1 THEN 0 ELSE {CID} END AS parent_column_id, '(q > ' || l_linenumber || ')' AS definition, l_linestatus = 'F' AS is_disabled, l_returnflag = 'N' AS is_not_trusted FROM {{lineitem}} WHERE l_discount = 0.02",
    "sys.partitions": f"SELECT {LOID} AS object_id, {CID} AS index_id, 1 AS partition_number FROM {{lineitem}} WHERE l_discount >= 0.05 AND l_tax > 0.01 UNION ALL SELECT {LOID}, {CID}, CASE WHEN l_linestatus = 'F' THEN 2 ELSE 1 END FROM {{lineitem}} WHERE l_discount >= 0.05 AND l_tax > 0.01",
    "sys.data_spaces": "SELECT DISTINCT l_linenumber AS data_space_id, 'DS_' || l_linenumber AS name FROM {lineitem} WHERE l_linenumber < 6",
    "sys.partition_schemes": "SELECT DISTINCT l_linenumber AS data_space_id FROM {lineitem} WHERE l_linenumber = 2",
    "sys.sequences": "SELECT s_name AS name, s_suppkey + 1000 AS schema_id, s_nationkey % 7 + 1 AS user_type_id, 18 AS precision, 0 AS scale, 1 AS start_value, s_nationkey AS increment, -5 AS minimum_value, s_suppkey * 100 AS maximum_value, s_acctbal < 0 AS is_cycling, 20 AS cache_size, s_suppkey AS current_value FROM {supplier}",
    "sys.synonyms": "SELECT s_name AS name, s_suppkey + 1000 AS schema_id, CASE s_nationkey % 5 WHEN 0 THEN 'obj' WHEN 1 THEN '[sch].[obj_' || s_suppkey || ']' WHEN 2 THEN 'db.sch.obj' WHEN 3 THEN '[srv].[my.db].[sch].[obj]' ELSE 'a.b.c.d.e' END AS base_object_name FROM {supplier}",
    "sys.sql_modules": "SELECT p_partkey * 4 + 2 AS object_id, 'create ' || p_name AS definition FROM {part} WHERE p_size % 7 <> 0",
    "sys.triggers": "SELECT p_partkey * 4 + 2 AS object_id, p_size > 25 AS is_disabled FROM {part} WHERE p_size % 6 = 2",
    "sys.sql_expression_dependencies": f"""SELECT l_partkey * 4 + 2 AS referencing_id, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS referencing_minor_id, CASE WHEN l_linestatus = 'F' THEN {LOID} END AS referenced_id, CASE WHEN l_tax > 0.04 THEN {CID} ELSE 0 END AS referenced_minor_id,
       CASE WHEN l_linenumber = 3 THEN 'GIVEN' END AS referenced_schema_name, CASE WHEN l_linenumber = 4 OR l_linestatus = 'O' THEN 'ENT_' || l_suppkey END AS referenced_entity_name, CASE WHEN l_discount = 0.1 THEN 'otherdb' END AS referenced_database_name, CAST(NULL AS STRING) AS referenced_server_name,
       'OBJECT_OR_COLUMN' AS referenced_class_desc, l_quantity > 25 AS is_schema_bound_reference, l_quantity < 5 AS is_caller_dependent FROM {{lineitem}} WHERE l_linenumber >= 3""",
    "sys.databases": "SELECT c_custkey AS source_id, c_name AS name, 150 + c_nationkey % 3 AS compatibility_level FROM {customer} UNION ALL SELECT c_custkey, 'master', 160 FROM {customer}",
    "server": "SELECT c_custkey AS source_id, c_name AS database_name, '16.0.' || c_nationkey AS product_version, c_mktsegment AS edition FROM {customer}",
    "granted_permissions": "SELECT o_custkey AS source_id, CASE o_orderstatus WHEN 'F' THEN 'CONNECT' WHEN 'O' THEN 'VIEW DEFINITION' ELSE 'ALTER' END AS permission_name FROM {orders} WHERE o_orderpriority = '1-URGENT'",
}
_AT = {"F": "TABLE", "O": "VIEW", "P": "MATERIALIZED VIEW"}
_OT = "CASE o_orderstatus WHEN 'F' THEN 'TABLE' WHEN 'O' THEN 'VIEW' ELSE 'MATERIALIZED VIEW' END"
_KT = "CASE l_returnflag WHEN 'A' THEN 'P' WHEN 'R' THEN 'R' ELSE CASE l_linestatus WHEN 'F' THEN 'C' ELSE 'O' END END"
ORACLE = {
    "all_objects": f"""SELECT {SN} AS owner, {RN} AS object_name, {_OT} AS object_type, {OID} AS object_id, o_orderpriority AS status, o_orderdate AS created, o_orderdate AS last_ddl_time, 'N' AS temporary FROM {{orders}}
       UNION ALL SELECT 'SCH_' || p_partkey, 'P_' || p_partkey, {OKIND}, p_partkey * 4 + 2, CASE WHEN p_size > 45 THEN 'INVALID' ELSE 'VALID' END, NULL, NULL, 'N' FROM {{part}}""",
    "all_tab_cols": f"""SELECT {SN} AS owner, {RN} AS table_name, {CN} AS column_name, l_linenumber AS column_id, CAST(NULL AS STRING) AS data_type_owner, 'NUMBER' AS data_type, CAST(l_quantity AS INT) AS data_length, 10 AS data_precision, 2 AS data_scale,
       CASE WHEN l_returnflag = 'A' THEN 'N' ELSE 'Y' END AS nullable, CASE WHEN l_discount = 0.1 THEN 'YES' ELSE 'NO' END AS virtual_column, l_linestatus AS data_default_vc FROM {LO}""",
    "all_tab_identity_cols": f"SELECT {SN} AS owner, {RN} AS table_name, {CN} AS column_name, 'ALWAYS' AS generation_type, 'START ' || l_linenumber AS identity_options FROM {LO} WHERE l_discount = 0.0",
    "all_tab_comments": f"SELECT {SN} AS owner, {RN} AS table_name, nullif(o_orderpriority, '5-LOW') AS comments FROM {{orders}} UNION ALL SELECT 'SCH_' || p_partkey, 'P_' || p_partkey, p_name FROM {{part}}",
    "all_col_comments": f"SELECT {SN} AS owner, {RN} AS table_name, {CN} AS column_name, l_returnflag AS comments FROM {LO}",
    "all_constraints": f"""SELECT {SN} AS owner, {RN} AS table_name, {KN} AS constraint_name, {_KT} AS constraint_type, CASE WHEN l_returnflag = 'R' THEN {SN} END AS r_owner, CASE WHEN l_returnflag = 'R' THEN {KN} END AS r_constraint_name, 'q > 0' AS search_condition_vc,
       'NO ACTION' AS delete_rule, CASE WHEN l_tax > 0.02 THEN 'ENABLED' ELSE 'DISABLED' END AS status, 'VALIDATED' AS validated, CASE WHEN l_linenumber = 7 THEN 'DEFERRABLE' ELSE 'NOT DEFERRABLE' END AS deferrable, 'IMMEDIATE' AS deferred, {SN} AS index_owner, {IN} AS index_name FROM {LO}""",
    "all_cons_columns": f"SELECT {SN} AS owner, {RN} AS table_name, {KN} AS constraint_name, {CN} AS column_name, 1 AS position FROM {LO} WHERE NOT (l_returnflag = 'N' AND l_linenumber = 1)",
    "all_indexes": f"""SELECT {SN} AS owner, {SN} AS table_owner, {RN} AS table_name, {IN} AS index_name, 'NORMAL' AS index_type, CASE WHEN l_linestatus = 'F' THEN 'UNIQUE' ELSE 'NONUNIQUE' END AS uniqueness, CASE WHEN l_returnflag = 'R' THEN 'UNUSABLE' ELSE 'VALID' END AS status,
       CASE WHEN l_linenumber < 5 THEN 'TS_' || l_linenumber END AS tablespace_name, l_suppkey AS leaf_blocks FROM {LO} WHERE l_discount >= 0.05""",
    "all_ind_columns": f"SELECT {SN} AS index_owner, {IN} AS index_name, {SN} AS table_owner, {RN} AS table_name, {CN} AS column_name, 1 AS column_position FROM {LO} WHERE l_discount >= 0.05",
    "all_ind_expressions": f"SELECT {SN} AS index_owner, {IN} AS index_name, {SN} AS table_owner, {RN} AS table_name, 1 AS column_position, 'UPPER(' || l_linenumber || ')' AS column_expression FROM {LO} WHERE l_discount >= 0.05 AND l_tax = 0.08",
    "all_part_indexes": f"SELECT {SN} AS owner, {IN} AS index_name, 'RANGE' AS partitioning_type, 4 AS partition_count FROM {LO} WHERE l_discount >= 0.05 AND l_linenumber = 2",
    "all_part_key_columns": f"SELECT {SN} AS owner, {IN} AS name, {CN} AS column_name, 1 AS column_position, 'INDEX' AS object_type FROM {LO} WHERE l_discount >= 0.05 AND l_linenumber = 2 AND l_linestatus = 'F' UNION ALL SELECT {SN}, {RN}, 'ID', 1, 'TABLE' FROM {{orders}} WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'",
    "all_sequences": "SELECT 'SCH_' || s_suppkey AS sequence_owner, s_name AS sequence_name, s_nationkey AS increment_by, CAST(-5 AS DECIMAL(28, 0)) AS min_value, CAST('9999999999999999999999999999' AS DECIMAL(28, 0)) AS max_value, CASE WHEN s_acctbal < 0 THEN 'Y' ELSE 'N' END AS cycle_flag, 20 AS cache_size, s_suppkey * 10 AS last_number FROM {supplier}",
    "all_synonyms": "SELECT 'SCH_' || s_suppkey AS owner, s_name AS synonym_name, 'O_' || s_nationkey AS table_owner, 'T_' || s_suppkey AS table_name, CASE WHEN s_acctbal < 3000 THEN 'LINK' || s_nationkey END AS db_link FROM {supplier}",
    "all_part_tables": f"SELECT {SN} AS owner, {RN} AS table_name, 'RANGE' AS partitioning_type, 'NONE' AS subpartitioning_type, 12 AS partition_count FROM {{orders}} WHERE o_orderstatus = 'F'",
    "all_tab_partitions": f"SELECT {SN} AS table_owner, {RN} AS table_name, 'PT_' || ({CID}) AS partition_name, 2 AS subpartition_count, 'TS' AS tablespace_name, CAST(l_quantity AS BIGINT) AS num_rows, l_linenumber AS blocks, l_shipdate AS last_analyzed FROM {LO}",
    "all_tab_subpartitions": f"SELECT {SN} AS table_owner, {RN} AS table_name, 'PT_' || ({CID}) AS partition_name, 'SP_' || l_linenumber AS subpartition_name, 'TS' AS tablespace_name, CAST(l_quantity AS BIGINT) AS num_rows, l_linenumber AS blocks, l_shipdate AS last_analyzed FROM {LO} WHERE l_returnflag = 'R'",
    "all_lobs": f"SELECT {SN} AS owner, {RN} AS table_name, {CN} AS column_name, 'LOB_' || ({CID}) AS segment_name, 'TS_LOB' AS tablespace_name, 'YES' AS securefile, 'NO' AS compression, 'NO' AS deduplication, l_linestatus AS encrypt, 'YES' AS in_row, 8192 AS chunk, CAST(NULL AS BIGINT) AS retention, 'NO' AS cache, 'YES' AS logging FROM {LO} WHERE l_discount = 0.01",
    "all_tables": f"SELECT {SN} AS owner, {RN} AS table_name, CASE WHEN o_orderpriority <> '5-LOW' THEN 'TS_1' END AS tablespace_name, o_custkey AS blocks FROM {{orders}} WHERE o_orderstatus <> 'O'",
    "all_tab_statistics": f"SELECT {SN} AS owner, {RN} AS table_name, 'TABLE' AS object_type, CAST(NULL AS STRING) AS partition_name, CAST(NULL AS STRING) AS subpartition_name, CAST(o_totalprice AS BIGINT) AS num_rows, o_custkey AS blocks, 100 AS avg_row_len, 10 AS sample_size, o_orderdate AS last_analyzed, 'NO' AS stale_stats FROM {{orders}}",
    "all_ind_statistics": f"SELECT {SN} AS owner, {RN} AS table_name, {IN} AS index_name, 'INDEX' AS object_type, CAST(NULL AS STRING) AS partition_name, CAST(NULL AS STRING) AS subpartition_name, CAST(l_quantity AS BIGINT) AS num_rows, l_suppkey AS leaf_blocks, 5 AS distinct_keys, 7 AS clustering_factor, 10 AS sample_size, l_shipdate AS last_analyzed, 'YES' AS stale_stats FROM {LO} WHERE l_discount >= 0.05",
    "all_mviews": f"SELECT {SN} AS owner, {RN} AS mview_name, 'C_' || o_custkey AS container_name, 'IMMEDIATE' AS build_mode, 'DEMAND' AS refresh_mode, 'FORCE' AS refresh_method, 'NO' AS fast_refreshable, o_orderdate AS last_refresh_date, 'COMPLETE' AS last_refresh_type, o_orderpriority AS staleness, 'VALID' AS compile_state FROM {{orders}} WHERE o_orderstatus = 'P'",
    "all_source": f"SELECT 'SCH_' || p_partkey AS owner, 'P_' || p_partkey AS name, {OKIND} AS type, l_orderkey * 10 + l_linenumber AS line, CASE WHEN l_tax = 0.08 AND l_discount = 0.1 THEN 'Code WRAPPED' ELSE l_returnflag || l_linestatus END AS text FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey WHERE p_size <> 10",
    "all_triggers": "SELECT 'SCH_' || p_partkey AS owner, 'P_' || p_partkey AS trigger_name, 'ENABLED' AS status, 'SCH_1' AS table_owner, 'T_' || p_size AS table_name FROM {part} WHERE p_size % 6 = 2 AND p_size > 20",
    "all_arguments": "SELECT 'SCH_' || l_partkey AS owner, CASE WHEN l_tax > 0.04 THEN 'PKG_' || l_suppkey END AS package_name, 'P_' || l_partkey AS object_name, 'ARG_' || l_orderkey AS argument_name, l_linenumber AS position, l_linenumber + 1 AS sequence, 0 AS data_level, 'NUMBER' AS data_type, CAST(NULL AS STRING) AS type_owner, CAST(NULL AS STRING) AS type_name, CAST(NULL AS STRING) AS type_subname, 'IN' AS in_out, CASE WHEN l_returnflag = 'A' THEN 'Y' ELSE 'N' END AS defaulted FROM {lineitem}",
    "all_errors": "SELECT 'SCH_' || l_partkey AS owner, 'P_' || l_partkey AS name, 'PROCEDURE' AS type, l_linenumber AS sequence, l_orderkey AS line, 3 AS position, 'ERROR' AS attribute, 900 + l_linenumber AS message_number, 'PLS-' || l_suppkey AS text FROM {lineitem} WHERE l_returnflag = 'R'",
    "all_dependencies": f"SELECT 'SCH_' || l_partkey AS owner, 'P_' || l_partkey AS name, CASE l_linenumber WHEN 1 THEN 'VIEW' WHEN 2 THEN 'PROCEDURE' WHEN 3 THEN 'SYNONYM' ELSE 'TYPE BODY' END AS type, CASE WHEN l_tax > 0 THEN {SN} END AS referenced_owner, {RN} AS referenced_name, 'TABLE' AS referenced_type, CAST(NULL AS STRING) AS referenced_link_name, 'HARD' AS dependency_type FROM {LO}",
    "all_scheduler_jobs": "SELECT 'SCH_' || user_id AS owner, 'J_' || event_id AS job_name, 'TRUE' AS enabled, 'SCHEDULED' AS state, 'PLSQL_BLOCK' AS job_type, 'DEFAULT' AS job_class, CAST(NULL AS STRING) AS program_name, 'S_' || user_id AS schedule_name, ts AS start_date, ts AS next_run_date, CAST(NULL AS TIMESTAMP) AS last_start_date, '+00' AS last_run_duration, user_id AS run_count, 0 AS failure_count FROM {events} WHERE event_type = 'error'",
    "all_scheduler_programs": "SELECT 'SCH_' || user_id AS owner, 'P_' || event_id AS program_name, 'FALSE' AS enabled, 'STORED_PROCEDURE' AS program_type, 3 AS number_of_arguments FROM {events} WHERE event_type = 'view'",
    "all_scheduler_schedules": "SELECT 'SCH_' || user_id AS owner, 'S_' || event_id AS schedule_name, 'CALENDAR' AS schedule_type, 'FREQ=DAILY' AS repeat_interval, ts AS start_date FROM {events} WHERE event_type = 'click'",
    "all_db_links": "SELECT 'SCH_' || c_custkey AS owner, 'L_' || c_name AS db_link, CASE WHEN c_acctbal > 0 THEN 'host' || c_nationkey END AS host, CAST(NULL AS TIMESTAMP) AS created FROM {customer}",
    "product_component_version": "SELECT c_custkey AS source_id, 'Oracle AI Database' AS product, '23.' || c_nationkey AS version FROM {customer} UNION ALL SELECT c_custkey, 'PL/SQL', '1' FROM {customer}",
    "session_context": "SELECT c_custkey AS source_id, c_name AS db_unique_name, c_mktsegment AS con_name, 'U' || c_custkey % 3 AS session_user FROM {customer}",
    "session_privs": "SELECT c_custkey AS source_id, 'CREATE SESSION' AS privilege FROM {customer}",
    "all_tab_privs": "SELECT o_custkey AS source_id, 'SELECT' AS privilege, 'SX' AS table_schema, 'T_' || o_orderkey AS table_name, 'U' || o_orderkey % 3 AS grantee FROM {orders}",
    "all_col_privs": "SELECT o_custkey AS source_id, 'UPDATE' AS privilege, 'SX' AS table_schema, 'T_' || o_orderkey AS table_name, 'C1' AS column_name, 'U1' AS grantee FROM {orders} WHERE o_orderstatus = 'F'",
    "role_tab_privs": "SELECT o_custkey AS source_id, 'READ' AS privilege, 'OW' AS owner, 'T_' || o_orderkey AS table_name, o_orderpriority AS role FROM {orders}",
    "session_roles": "SELECT c_custkey AS source_id, '1-URGENT' AS role FROM {customer} WHERE c_mktsegment = 'BUILDING'",
}
_RK = "CASE o_orderpriority WHEN '1-URGENT' THEN 'v' WHEN '2-HIGH' THEN 'm' WHEN '3-MEDIUM' THEN 'p' WHEN '5-LOW' THEN 'i' ELSE 'r' END"
PG = {
    "pg_namespace": "SELECT c_custkey + 1000 AS oid, 'SCH_' || c_custkey AS nspname, c_nationkey AS nspowner FROM {customer} UNION ALL SELECT 11, 'pg_catalog', 0 FROM {region} WHERE r_regionkey = 0",
    "pg_roles": "SELECT n_nationkey AS oid, n_name AS rolname FROM {nation} WHERE n_regionkey <> 2",
    "pg_class": f"SELECT {OID} AS oid, {RN} AS relname, o_custkey + 1000 AS relnamespace, {_RK} AS relkind, 'p' AS relpersistence, o_orderstatus = 'F' AS relrowsecurity, o_orderstatus = 'P' AS relispartition FROM {{orders}}",
    "pg_attribute": f"SELECT {LOID} AS attrelid, {CN} AS attname, {CID} AS attnum, l_linenumber AS atttypid, l_returnflag = 'A' AS attnotnull, l_tax = 0.08 AS atthasdef, '' AS attidentity, 's' AS attgenerated, l_discount = 0.1 AS attisdropped FROM {{lineitem}} UNION ALL SELECT {OID}, 'ctid', -1, 1, true, false, '', '', false FROM {{orders}}",
    "pg_type": "SELECT DISTINCT l_linenumber AS oid, 't' || l_linenumber AS typname, CASE WHEN l_linenumber > 0 THEN 11L ELSE 1L END AS typnamespace FROM {lineitem}",
    "pg_constraint": f"""SELECT l_orderkey * 4 AS oid, 'fk_' || l_orderkey AS conname, 'f' AS contype, {LOID} AS conrelid, array_sort(collect_list({CID})) AS conkey, {LOID} AS confrelid, reverse(array_sort(collect_list({CID}))) AS confkey, 'c' AS confdeltype, 'a' AS confupdtype, true AS convalidated, false AS condeferrable, false AS condeferred
       FROM {{lineitem}} WHERE l_discount = 0.03 GROUP BY l_orderkey
       UNION ALL SELECT l_orderkey * 4 + 1, 'pk_' || l_orderkey, 'p', {LOID}, array_sort(collect_list({CID})), 0, NULL, ' ', ' ', true, true, false FROM {{lineitem}} WHERE l_discount = 0.05 GROUP BY l_orderkey
       UNION ALL SELECT {BIG}, 'ck_' || ({CID}), 'c', {LOID}, CASE WHEN l_linenumber > 1 THEN array({CID}) END, 0, NULL, ' ', ' ', l_linestatus = 'F', false, false FROM {{lineitem}} WHERE l_discount = 0.02
       UNION ALL SELECT l_orderkey * 4 + 2, 'xx', 'x', {LOID}, NULL, 0, NULL, ' ', ' ', true, false, false FROM {{lineitem}} WHERE l_discount = 0.09""",
    "pg_rewrite": f"SELECT o_orderkey AS oid, {OID} AS ev_class FROM {{orders}} WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW')",
    "pg_depend": f"SELECT o_orderkey AS objid, CASE WHEN l_tax = 0.08 THEN 'pg_type' ELSE 'pg_rewrite' END AS classid, 'pg_class' AS refclassid, l_partkey * 4 + 1 AS refobjid, CASE WHEN l_discount = 0.1 THEN 'i' ELSE 'n' END AS deptype FROM {LO} UNION ALL SELECT o_orderkey, 'pg_rewrite', 'pg_class', {OID}, 'n' FROM {{orders}}",
    "pg_settings": "SELECT c_custkey AS source_id, 'server_version' AS name, '16.' || c_nationkey AS setting FROM {customer} UNION ALL SELECT c_custkey, 'port', '5432' FROM {customer}",
    "server": "SELECT c_custkey AS source_id, c_name AS database_name FROM {customer}",
}
# Catalog ids are unique, line items need not be: copies of a line item's key are one column.
LINES = """(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, MAX(l_quantity) AS l_quantity, MAX(l_discount) AS l_discount, MAX(l_tax) AS l_tax, MAX(l_returnflag) AS l_returnflag,
   MAX(l_linestatus) AS l_linestatus, MAX(l_shipdate) AS l_shipdate FROM {lineitem} GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber)"""
# Line items that are to meet their order are dealt by it once, and made distinct where they are.
BASES = {"placed": f"SELECT l.*, o_orderkey, o_custkey FROM {LINES.replace('{lineitem}', '(SELECT /*+ REPARTITION(l_orderkey) */ * FROM {lineitem})')} AS l JOIN {{orders}} ON l_orderkey = o_orderkey", "lines": f"SELECT * FROM {LINES}"}
# What is distinct anyway needs no distinct line items.
RAW = {e: {t: q if q.startswith("SELECT DISTINCT") else q.replace(LO, "{placed}").replace("{lineitem}", "{lines}") for t, q in tables.items()} for e, tables in (("mssql", MSSQL), ("oracle", ORACLE), ("postgresql", PG))}


class Landed(dict):
    """Raw tables built on first use. Those made of line items rest on ``bases``, or make theirs anew, each with the columns it needs."""

    def __init__(self, spark, sf, texts, bases=None, empty=False):
        super().__init__()
        self._args = spark, sf, texts
        self.bases, self.empty = bases or {}, empty

    def __missing__(self, name):
        spark, sf, texts = self._args
        text = texts[name]
        for base, rows in BASES.items():
            if base not in self.bases:
                text = text.replace(f"{{{base}}}", f"({rows})")
        made = portable(spark, sf, text, **{b: d for b, d in self.bases.items() if f"{{{b}}}" in text})
        self[name] = made.limit(0) if self.empty else made
        return self[name]


def landed(spark, sf, engine):
    return Landed(spark, sf, RAW[engine])


def collected(spark, sf, qid, by=()):
    """A collector's rows. What more than one of its raw tables makes of the line items is written once, with the columns that they name:
    empty tables tell which it reads."""
    texts = RAW[qid.split(".")[0]]
    tried = Landed(spark, sf, texts, empty=True)
    collect(qid, tried, by)
    shared = [b for b in BASES if sum(f"{{{b}}}" in texts[t] for t in tried) > 1]
    named = set(re.findall(r"\w+", " ".join(texts[t] for t in tried)))
    made = {b: portable(spark, sf, BASES[b]) for b in shared}
    return collect(qid, Landed(spark, sf, texts, {b: measured(d.select([x for x in d.columns if x in named])) for b, d in made.items()}), by)


_L = f"WITH lo AS (SELECT *, {SN} AS sn, {RN} AS rn, {CN} AS cn, {CID} AS cid, {KN} AS kn, {IN} AS ixn FROM lineitem JOIN orders ON l_orderkey = o_orderkey), own AS (SELECT 'SCH_' || c_custkey AS sn FROM customer) "
_ISO = "strftime({x}, '%Y-%m-%dT%H:%M:%S')"
_CON = "is_deferrable, is_initially_deferred"
EXPECT = {
    "mssql.preflight.identity": "SELECT c_custkey AS source_id, 'mssql' AS engine, '16.0.' || c_nationkey AS engine_version, c_mktsegment AS engine_edition, c_name AS database_name, NULL AS container_name, 150 + c_nationkey % 3 AS compatibility_level FROM customer",
    "mssql.preflight.rights": "SELECT c_custkey AS source_id, p AS permission_name, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = s) THEN 1 ELSE 0 END AS has_permission FROM customer, (VALUES ('CONNECT', 'F'), ('VIEW DEFINITION', 'O')) v(p, s)",
    "mssql.structure.schemas": "SELECT 'SCH_' || c_custkey AS schema_name, c_custkey + 1000 AS schema_id, CASE WHEN n_regionkey <> 3 THEN n_name END AS owner_name FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "mssql.structure.relations": f"SELECT {SN} AS schema_name, {RN} AS relation_name, CASE o_orderstatus WHEN 'O' THEN 'VIEW' ELSE 'TABLE' END AS relation_kind, {OID} AS object_id, {_ISO.format(x='o_orderdate')} AS created_at, {_ISO.format(x='o_orderdate')} AS modified_at, false AS is_ms_shipped FROM orders WHERE o_orderstatus <> 'P'",
    "mssql.structure.columns": _L + """SELECT sn AS schema_name, rn AS relation_name, CASE o_orderstatus WHEN 'O' THEN 'VIEW' ELSE 'TABLE' END AS relation_kind, cn AS column_name, cid AS ordinal_position, 'sys' AS data_type_schema, 't' || l_linenumber AS data_type, CAST(l_quantity AS INT) AS max_length,
       l_linenumber AS numeric_precision, 0 AS numeric_scale, l_returnflag <> 'A' AS is_nullable, CASE WHEN l_tax = 0.08 THEN '((' || CAST(l_quantity AS INT) || '))' END AS default_expression, CASE WHEN l_discount = 0.1 THEN 'COMPUTED' WHEN l_discount = 0 THEN 'IDENTITY' ELSE 'NONE' END AS generation_kind,
       CASE WHEN l_discount = 0.1 THEN '(' || l_returnflag || ')' END AS generation_expression, l_discount = 0 AS is_identity, CASE WHEN l_discount = 0 THEN '1' END AS identity_seed, CASE WHEN l_discount = 0 THEN l_linenumber::VARCHAR END AS identity_increment, NULL AS identity_generation, NULL AS identity_options
       FROM lo WHERE o_orderstatus <> 'P'""",
    "mssql.structure.constraints": _L + """SELECT sn AS schema_name, rn AS relation_name, kn AS constraint_name, CASE WHEN l_discount = 0.03 THEN 'FOREIGN_KEY' WHEN l_discount = 0.02 THEN 'CHECK' WHEN l_tax < 0.04 THEN 'PRIMARY_KEY' ELSE 'UNIQUE' END AS constraint_kind,
       CASE WHEN l_discount = 0.02 AND l_linenumber = 1 THEN NULL ELSE cn END AS column_name, CASE WHEN l_discount <> 0.02 THEN 1 END AS ordinal_position, CASE WHEN l_discount = 0.03 THEN sn END AS referenced_schema_name, CASE WHEN l_discount = 0.03 THEN rn END AS referenced_relation_name,
       CASE WHEN l_discount = 0.03 THEN cn END AS referenced_column_name, CASE WHEN l_discount = 0.02 THEN '(q > ' || l_linenumber || ')' END AS check_expression, CASE WHEN l_discount = 0.03 THEN 'NO_ACTION' END AS delete_rule, CASE WHEN l_discount = 0.03 THEN 'CASCADE' END AS update_rule,
       CASE WHEN l_discount = 0.05 THEN l_returnflag <> 'R' ELSE l_linestatus <> 'F' END AS is_enabled, l_discount = 0.05 OR l_returnflag <> 'N' AS is_validated, false AS is_deferrable, false AS is_initially_deferred FROM lo WHERE o_orderstatus = 'F' AND l_discount IN (0.02, 0.03, 0.05)""",
    "mssql.structure.indexes": _L + """SELECT sn AS schema_name, rn AS relation_name, ixn AS index_name, 'KIND_' || l_linenumber % 3 AS index_kind, cn AS column_name, 1 AS ordinal_position, NULL AS column_expression, l_discount = 0.06 AS is_included, l_linenumber = 2 AS is_partition_key, CASE WHEN l_linenumber = 2 THEN 1 END AS partition_ordinal,
       l_linestatus = 'F' AS is_unique, l_discount = 0.05 AND l_tax < 0.04 AS is_primary_key, l_discount = 0.05 AND l_tax >= 0.04 AS is_unique_constraint, l_returnflag <> 'R' AS is_enabled, CASE WHEN l_returnflag = 'N' THEN 'x > 1' END AS filter_expression, CASE WHEN l_linenumber < 6 THEN 'DS_' || l_linenumber END AS data_space_name,
       CASE WHEN l_linenumber = 2 THEN 'RANGE' ELSE 'NONE' END AS partitioning_kind, CASE WHEN l_tax <= 0.01 THEN 0 WHEN l_linestatus = 'F' THEN 2 ELSE 1 END AS partition_count FROM lo WHERE o_orderstatus = 'F' AND l_discount >= 0.05 AND l_linenumber % 3 <> 0 AND l_tax <> 0.07""",
    "mssql.structure.sequences": """SELECT 'SCH_' || s_suppkey AS schema_name, s_name AS sequence_name, 't' || (s_nationkey % 7 + 1) AS data_type, 18 AS numeric_precision, 0 AS numeric_scale, '1' AS start_value, s_nationkey::VARCHAR AS increment_by, '-5' AS min_value, (s_suppkey * 100)::VARCHAR AS max_value, s_acctbal < 0 AS is_cycling,
       20 AS cache_size, s_suppkey::VARCHAR AS observed_value, 'CURRENT_VALUE' AS observed_value_semantics FROM supplier""",
    "mssql.structure.synonyms": """SELECT 'SCH_' || s_suppkey AS schema_name, s_name AS synonym_name, CASE k WHEN 0 THEN 'obj' WHEN 1 THEN '[sch].[obj_' || s_suppkey || ']' WHEN 2 THEN 'db.sch.obj' WHEN 3 THEN '[srv].[my.db].[sch].[obj]' ELSE 'a.b.c.d.e' END AS target_reference,
       CASE k WHEN 2 THEN 'db' WHEN 3 THEN 'my.db' END AS target_catalog_name, CASE WHEN k IN (1, 2, 3) THEN 'sch' END AS target_schema_name, CASE WHEN k = 1 THEN 'obj_' || s_suppkey WHEN k < 4 THEN 'obj' END AS target_object_name, CASE k WHEN 3 THEN 'srv' END AS remote_locator FROM (SELECT *, s_nationkey % 5 AS k FROM supplier)""",
    "mssql.stored.objects": _L + f"""SELECT 'SCH_' || p_partkey AS schema_name, 'P_' || p_partkey AS object_name, {PKIND} AS object_kind, (p_partkey * 4 + 2)::VARCHAR AS native_object_id, CASE WHEN p_size % 6 = 2 THEN {SN} END AS parent_schema_name, CASE WHEN p_size % 6 = 2 THEN {RN} END AS parent_object_name,
       CASE WHEN p_size % 6 <> 2 THEN 'NOT_APPLICABLE' WHEN p_size > 25 THEN 'DISABLED' ELSE 'ENABLED' END AS enablement_state, CASE WHEN p_size % 7 = 0 THEN 'ENCRYPTED_OR_INVISIBLE' ELSE 'VISIBLE_HASHED' END AS definition_visibility, CASE WHEN p_size % 7 <> 0 THEN 1 END AS definition_component_ordinal,
       CASE WHEN p_size % 7 <> 0 THEN sha256(unhex(regexp_replace(hex('create ' || p_name), '(..)', '\\100', 'g'))) END AS definition_component_hash, CASE WHEN p_size % 7 <> 0 THEN 'SHA-256/MSSQL-NVARCHAR-UTF16LE' END AS definition_component_hash_algorithm
       FROM part LEFT JOIN orders ON o_orderkey = p_partkey WHERE p_size % 6 <> 4 AND p_size <= 48 AND 'SCH_' || p_partkey IN (SELECT sn FROM own)""",
    "mssql.stored.dependencies": _L + f"""SELECT 'SCH_' || p_partkey AS source_schema_name, 'P_' || p_partkey AS source_object_name, {PKIND} AS source_object_kind, CASE WHEN l_linenumber = 3 THEN 'GIVEN' WHEN l_linestatus = 'F' THEN sn END AS target_schema_name, CASE WHEN l_linenumber = 4 OR l_linestatus = 'O' THEN 'ENT_' || l_suppkey ELSE rn END AS target_object_name,
       CASE WHEN l_linestatus = 'F' THEN CASE o_orderstatus WHEN 'O' THEN 'VIEW' ELSE 'TABLE' END END AS target_object_kind, CASE WHEN l_linestatus = 'F' AND l_tax > 0.04 THEN cn END AS target_column_name, CASE WHEN l_linestatus = 'F' AND l_tax > 0.04 THEN 'PROVEN' ELSE 'NOT_PROVEN' END AS column_resolution_state,
       CASE WHEN l_discount = 0.1 THEN 'otherdb' END AS target_database_name, NULL AS target_server_or_link_name, CASE WHEN l_linestatus = 'F' AND l_discount <> 0.1 THEN 'RESOLVED' ELSE 'UNRESOLVED' END AS resolution_state, 'OBJECT_OR_COLUMN' AS native_dependency_kind, l_quantity > 25 AS is_schema_bound, l_quantity < 5 AS is_caller_dependent
       FROM lo JOIN part ON p_partkey = l_partkey WHERE l_linenumber >= 3 AND l_returnflag <> 'R' AND p_size % 6 <> 4 AND p_size <= 48 AND 'SCH_' || p_partkey IN (SELECT sn FROM own)""",
    "oracle.preflight.identity": "SELECT c_custkey AS source_id, 'oracle' AS engine, '23.' || c_nationkey AS engine_version, NULL AS engine_edition, c_name AS database_name, c_mktsegment AS container_name, NULL AS compatibility_level FROM customer",
    "oracle.preflight.rights": """SELECT c_custkey AS source_id, 'SYSTEM:CREATE SESSION' AS permission_name, 1 AS has_permission FROM customer UNION ALL SELECT o_custkey, 'OBJECT:SELECT:SX.T_' || o_orderkey, 1 FROM orders WHERE o_orderkey % 3 = o_custkey % 3
       UNION ALL SELECT o_custkey, 'COLUMN_OBJECT:UPDATE:SX.T_' || o_orderkey || '.C1', 1 FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 3 = 1 UNION ALL SELECT o_custkey, 'ROLE_OBJECT:READ:OW.T_' || o_orderkey, 1 FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority = '1-URGENT' AND c_mktsegment = 'BUILDING'""",
    "oracle.structure.schemas": f"SELECT DISTINCT {SN} AS schema_name FROM orders",
    "oracle.structure.relations": f"SELECT {SN} AS schema_name, {RN} AS relation_name, {_OT} AS relation_kind, {OID} AS object_id, {_ISO.format(x='o_orderdate')} AS created_at, {_ISO.format(x='o_orderdate')} AS modified_at, o_orderpriority AS status, 'N' AS temporary FROM orders",
    "oracle.structure.columns": _L + f"""SELECT sn AS schema_name, rn AS relation_name, {_OT} AS relation_kind, cn AS column_name, l_linenumber::BIGINT AS ordinal_position, NULL AS data_type_schema, 'NUMBER' AS data_type, CAST(l_quantity AS INT) AS max_length, 10 AS numeric_precision, 2 AS numeric_scale, l_returnflag <> 'A' AS is_nullable,
       CASE WHEN l_discount <> 0.1 THEN l_linestatus END AS default_expression, CASE WHEN l_discount = 0.1 THEN 'VIRTUAL' WHEN l_discount = 0 THEN 'IDENTITY' ELSE 'NONE' END AS generation_kind, CASE WHEN l_discount = 0.1 THEN l_linestatus END AS generation_expression, l_discount = 0 AS is_identity,
       NULL AS identity_seed, NULL AS identity_increment, CASE WHEN l_discount = 0 THEN 'ALWAYS' END AS identity_generation, CASE WHEN l_discount = 0 THEN 'START ' || l_linenumber END AS identity_options FROM lo""",
    "oracle.structure.comments": _L + f"""SELECT {SN} AS schema_name, {RN} AS relation_name, NULL AS column_name, 'RELATION' AS comment_scope, CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE length(o_orderpriority) END AS comment_length, CASE WHEN o_orderpriority <> '5-LOW' THEN sha256(o_orderpriority) END AS comment_sha256, 'SHA256_OF_COMMENT_TEXT' AS comment_hash_algorithm FROM orders
       UNION ALL SELECT sn, rn, cn, 'COLUMN', 1, sha256(l_returnflag), 'SHA256_OF_COMMENT_TEXT' FROM lo""",
    "oracle.structure.constraints": _L + f"""SELECT sn AS schema_name, rn AS relation_name, kn AS constraint_name, CASE l_returnflag WHEN 'A' THEN 'PRIMARY_KEY' WHEN 'R' THEN 'FOREIGN_KEY' ELSE 'CHECK' END AS constraint_kind, CASE WHEN l_returnflag = 'N' AND l_linenumber = 1 THEN NULL ELSE cn END AS column_name,
       CASE WHEN l_returnflag = 'N' AND l_linenumber = 1 THEN NULL ELSE 1 END AS ordinal_position, CASE WHEN l_returnflag = 'R' THEN sn END AS referenced_schema_name, CASE WHEN l_returnflag = 'R' THEN rn END AS referenced_relation_name, CASE WHEN l_returnflag = 'R' THEN cn END AS referenced_column_name,
       CASE WHEN l_returnflag = 'N' THEN 'q > 0' END AS check_expression, CASE WHEN l_returnflag = 'R' THEN 'NO ACTION' END AS delete_rule, NULL AS update_rule, l_tax > 0.02 AS is_enabled, true AS is_validated, l_linenumber = 7 AS is_deferrable, false AS is_initially_deferred FROM lo WHERE NOT (l_returnflag = 'N' AND l_linestatus = 'O')""",
    "oracle.structure.indexes": _L + """SELECT sn AS schema_name, rn AS relation_name, ixn AS index_name, 'NORMAL' AS index_kind, cn AS column_name, 1 AS ordinal_position, CASE WHEN l_tax = 0.08 THEN 'UPPER(' || l_linenumber || ')' END AS column_expression, false AS is_included, l_linenumber = 2 AND l_linestatus = 'F' AS is_partition_key,
       CASE WHEN l_linenumber = 2 AND l_linestatus = 'F' THEN 1 END AS partition_ordinal, l_linestatus = 'F' AS is_unique, l_returnflag = 'A' AS is_primary_key, false AS is_unique_constraint, l_returnflag <> 'R' AS is_enabled, NULL AS filter_expression, CASE WHEN l_linenumber < 5 THEN 'TS_' || l_linenumber END AS data_space_name,
       CASE WHEN l_linenumber = 2 THEN 'RANGE' ELSE 'NONE' END AS partitioning_kind, CASE WHEN l_linenumber = 2 THEN 4 ELSE 1 END AS partition_count FROM lo WHERE l_discount >= 0.05""",
    "oracle.structure.sequences": """SELECT 'SCH_' || s_suppkey AS schema_name, s_name AS sequence_name, 'NUMBER' AS data_type, NULL AS numeric_precision, NULL AS numeric_scale, NULL AS start_value, s_nationkey::VARCHAR AS increment_by, '-5' AS min_value, '9999999999999999999999999999' AS max_value, s_acctbal < 0 AS is_cycling, 20 AS cache_size,
       (s_suppkey * 10)::VARCHAR AS observed_value, 'LAST_NUMBER' AS observed_value_semantics FROM supplier""",
    "oracle.structure.synonyms": """SELECT 'SCH_' || s_suppkey AS schema_name, s_name AS synonym_name, 'O_' || s_nationkey || '.T_' || s_suppkey || CASE WHEN s_acctbal < 3000 THEN '@LINK' || s_nationkey ELSE '' END AS target_reference, NULL AS target_catalog_name, 'O_' || s_nationkey AS target_schema_name, 'T_' || s_suppkey AS target_object_name,
       CASE WHEN s_acctbal < 3000 THEN 'LINK' || s_nationkey END AS remote_locator FROM supplier""",
    "oracle.structure.partitions": _L + f"""SELECT {SN} AS schema_name, {RN} AS relation_name, 'TABLE' AS relation_kind, 'TABLE_PARTITIONING' AS partition_scope, NULL AS partition_name, NULL AS subpartition_name, 'RANGE' AS partitioning_type, 'NONE' AS subpartitioning_type, 12 AS partition_count, NULL AS subpartition_count,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'ID' END AS partition_key_column, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END AS partition_key_ordinal, NULL AS tablespace_name, NULL AS num_rows_estimate, NULL AS blocks_estimate, NULL AS last_analyzed FROM orders WHERE o_orderstatus = 'F'
       UNION ALL SELECT sn, rn, 'TABLE', 'TABLE_PARTITION', 'PT_' || cid, NULL, NULL, NULL, NULL, 2, NULL, NULL, 'TS', CAST(l_quantity AS BIGINT), l_linenumber, {_ISO.format(x='l_shipdate')} FROM lo
       UNION ALL SELECT sn, rn, 'TABLE', 'TABLE_SUBPARTITION', 'PT_' || cid, 'SP_' || l_linenumber, NULL, NULL, NULL, NULL, NULL, NULL, 'TS', CAST(l_quantity AS BIGINT), l_linenumber, {_ISO.format(x='l_shipdate')} FROM lo WHERE l_returnflag = 'R'""",
    "oracle.structure.lobs": _L + "SELECT sn AS schema_name, rn AS relation_name, cn AS column_name, 'LOB_' || cid AS segment_name, 'TS_LOB' AS tablespace_name, 'YES' AS securefile, 'NO' AS compression, 'NO' AS deduplication, l_linestatus AS encryption, 'YES' AS in_row, 8192 AS chunk, NULL AS retention, 'NO' AS cache, 'YES' AS logging FROM lo WHERE l_discount = 0.01",
    "oracle.structure.tablespaces": _L + f"""SELECT schema_name, tablespace_name, NULL AS block_size, NULL AS status, NULL AS contents, NULL AS logging, NULL AS extent_management, NULL AS allocation_type, NULL AS segment_space_management, count(*) AS visible_object_references FROM (
       SELECT {SN} AS schema_name, 'TS_1' AS tablespace_name FROM orders WHERE o_orderstatus <> 'O' AND o_orderpriority <> '5-LOW' UNION ALL SELECT sn, 'TS_' || l_linenumber FROM lo WHERE l_discount >= 0.05 AND l_linenumber < 5 UNION ALL SELECT sn, 'TS_LOB' FROM lo WHERE l_discount = 0.01) GROUP BY 1, 2""",
    "oracle.statistics.tables": f"SELECT {SN} AS schema_name, {RN} AS relation_name, 'TABLE' AS object_type, NULL AS partition_name, NULL AS subpartition_name, CAST(trunc(o_totalprice) AS BIGINT) AS num_rows_estimate, o_custkey AS blocks_estimate, 100 AS avg_row_len, 10 AS sample_size, {_ISO.format(x='o_orderdate')} AS last_analyzed, 'NO' AS stale_stats, 'OPTIMIZER_STATISTICS_ESTIMATE' AS row_count_semantics FROM orders",
    "oracle.statistics.indexes": _L + f"SELECT sn AS schema_name, rn AS relation_name, ixn AS index_name, 'INDEX' AS object_type, NULL AS partition_name, NULL AS subpartition_name, CAST(l_quantity AS BIGINT) AS num_rows_estimate, l_suppkey AS leaf_blocks, 5 AS distinct_keys, 7 AS clustering_factor, 10 AS sample_size, {_ISO.format(x='l_shipdate')} AS last_analyzed, 'YES' AS stale_stats, 'OPTIMIZER_STATISTICS_ESTIMATE' AS row_count_semantics FROM lo WHERE l_discount >= 0.05",
    "oracle.size.segments": _L + f"""SELECT {SN} AS schema_name, {RN} AS segment_name, NULL AS partition_name, 'TABLE_OR_MATERIALIZED_VIEW' AS segment_type, CASE WHEN o_orderpriority <> '5-LOW' THEN 'TS_1' END AS tablespace_name, NULL AS bytes, o_custkey AS blocks, NULL AS extents, 'VISIBLE_TABLE_BLOCK_METADATA_BYTES_NOT_VISIBLE' AS size_semantics FROM orders WHERE o_orderstatus <> 'O'
       UNION ALL SELECT sn, rn, 'PT_' || cid, 'TABLE_PARTITION', 'TS', NULL, l_linenumber, NULL, 'VISIBLE_PARTITION_BLOCK_METADATA_BYTES_NOT_VISIBLE' FROM lo
       UNION ALL SELECT sn, ixn, NULL, 'INDEX', CASE WHEN l_linenumber < 5 THEN 'TS_' || l_linenumber END, NULL, l_suppkey, NULL, 'VISIBLE_INDEX_LEAF_BLOCK_METADATA_BYTES_NOT_VISIBLE' FROM lo WHERE l_discount >= 0.05
       UNION ALL SELECT sn, 'LOB_' || cid, NULL, 'LOB', 'TS_LOB', NULL, NULL, NULL, 'VISIBLE_LOB_METADATA_BYTES_NOT_VISIBLE' FROM lo WHERE l_discount = 0.01""",
    "oracle.structure.mview_refresh": f"SELECT {SN} AS schema_name, {RN} AS relation_name, 'C_' || o_custkey AS container_name, 'IMMEDIATE' AS build_mode, 'DEMAND' AS refresh_mode, 'FORCE' AS refresh_method, 'NO' AS fast_refreshable, {_ISO.format(x='o_orderdate')} AS last_refresh_date, 'COMPLETE' AS last_refresh_type, o_orderpriority AS staleness, 'VALID' AS compile_state FROM orders WHERE o_orderstatus = 'P'",
    "oracle.stored.objects": f"""WITH s AS (SELECT l_partkey, l_orderkey * 10 + l_linenumber AS line, CASE WHEN l_tax = 0.08 AND l_discount = 0.1 THEN 'Code WRAPPED' ELSE l_returnflag || l_linestatus END AS t FROM lineitem),
       g AS (SELECT l_partkey, count(*) AS n, sha256(string_agg(sha256(t), '' ORDER BY line, sha256(t))) AS h, bool_or(t = 'Code WRAPPED') AS w FROM s GROUP BY 1)
       SELECT 'SCH_' || p_partkey AS schema_name, 'P_' || p_partkey AS object_name, {OKIND} AS object_kind, p_partkey * 4 + 2 AS native_object_id, CASE WHEN p_size > 45 THEN 'INVALID' ELSE 'VALID' END AS status, NULL AS created_at, NULL AS last_ddl_time, CASE WHEN p_size % 6 = 2 AND p_size > 20 THEN 'ENABLED' ELSE 'NOT_APPLICABLE' END AS trigger_status,
       CASE WHEN p_size % 6 = 2 AND p_size > 20 THEN 'SCH_1' END AS trigger_table_schema_name, CASE WHEN p_size % 6 = 2 AND p_size > 20 THEN 'T_' || p_size END AS trigger_table_name, coalesce(n, 0) AS source_line_count, h AS source_hash_sha256, CASE WHEN n > 0 THEN 'SHA256_OF_ORDERED_SOURCE_LINE_SHA256_VALUES' END AS source_hash_algorithm,
       CASE WHEN n > 0 THEN 'LOCAL_HASH_ONLY_RAW_SOURCE_NOT_EMITTED' ELSE 'SOURCE_NOT_VISIBLE' END AS source_storage_policy, coalesce(w, false) AS wrapped_code_blind_spot FROM part LEFT JOIN g ON l_partkey = p_partkey AND p_size <> 10 WHERE p_size % 6 <> 4""",
    "oracle.stored.arguments": """SELECT 'SCH_' || l_partkey AS schema_name, CASE WHEN l_tax > 0.04 THEN 'PKG_' || l_suppkey ELSE 'P_' || l_partkey END AS object_name, CASE WHEN l_tax > 0.04 THEN 'PKG_' || l_suppkey END AS package_name, 'P_' || l_partkey AS subprogram_name, 'ARG_' || l_orderkey AS argument_name, l_linenumber AS position, l_linenumber + 1 AS sequence,
       0 AS data_level, 'NUMBER' AS data_type, NULL AS type_owner, NULL AS type_name, NULL AS type_subname, 'IN' AS in_out, CASE WHEN l_returnflag = 'A' THEN 'Y' ELSE 'N' END AS defaulted, CASE WHEN l_returnflag = 'A' THEN 'DEFAULT_EXISTS_VALUE_NOT_EMITTED' ELSE 'NO_DEFAULT' END AS default_value_policy FROM lineitem""",
    "oracle.stored.errors": "SELECT 'SCH_' || l_partkey AS schema_name, 'P_' || l_partkey AS object_name, 'PROCEDURE' AS object_kind, l_linenumber AS sequence, l_orderkey AS line, 3 AS position, 'ERROR' AS attribute, 900 + l_linenumber AS message_number, length('PLS-' || l_suppkey) AS error_text_length, sha256('PLS-' || l_suppkey) AS error_text_sha256, 'SHA256_OF_COMPILE_ERROR_TEXT' AS error_hash_algorithm FROM lineitem WHERE l_returnflag = 'R'",
    "oracle.stored.dependencies": _L + """SELECT 'SCH_' || l_partkey AS source_schema_name, 'P_' || l_partkey AS source_object_name, CASE l_linenumber WHEN 1 THEN 'VIEW' WHEN 2 THEN 'PROCEDURE' ELSE 'TYPE BODY' END AS source_object_kind, CASE WHEN l_tax > 0 THEN sn END AS target_schema_name, rn AS target_object_name, 'TABLE' AS target_object_kind, NULL AS target_db_link_name,
       'HARD' AS native_dependency_kind, CASE WHEN l_tax > 0 THEN 'RESOLVED' ELSE 'UNRESOLVED' END AS resolution_state, 'NOT_PROVEN' AS column_resolution_state FROM lo WHERE l_linenumber <> 3""",
    "oracle.operations.scheduler": f"""SELECT 'SCH_' || user_id AS schema_name, CASE event_type WHEN 'error' THEN 'J_' WHEN 'view' THEN 'P_' ELSE 'S_' END || event_id AS object_name, CASE event_type WHEN 'error' THEN 'SCHEDULER_JOB' WHEN 'view' THEN 'SCHEDULER_PROGRAM' ELSE 'SCHEDULER_SCHEDULE' END AS object_kind,
       CASE event_type WHEN 'error' THEN 'TRUE' WHEN 'view' THEN 'FALSE' END AS enabled, CASE event_type WHEN 'error' THEN 'SCHEDULED' END AS status, CASE event_type WHEN 'error' THEN 'PLSQL_BLOCK' WHEN 'view' THEN 'STORED_PROCEDURE' ELSE 'CALENDAR' END AS type_name, CASE event_type WHEN 'error' THEN 'DEFAULT' END AS class_name,
       CASE event_type WHEN 'view' THEN 'P_' || event_id END AS program_name, CASE event_type WHEN 'error' THEN 'S_' || user_id WHEN 'click' THEN 'S_' || event_id END AS schedule_name, CASE event_type WHEN 'click' THEN 'FREQ=DAILY' END AS repeat_interval, CASE WHEN event_type <> 'view' THEN {_ISO.format(x='ts')} END AS start_at,
       CASE event_type WHEN 'error' THEN {_ISO.format(x='ts')} END AS next_run_at, NULL AS last_start_at, CASE event_type WHEN 'error' THEN '+00' END AS last_run_duration, CASE event_type WHEN 'error' THEN user_id WHEN 'view' THEN 3 END AS run_count, CASE event_type WHEN 'error' THEN 0 END AS failure_count,
       CASE event_type WHEN 'error' THEN 'JOB_ACTION_NOT_EMITTED' WHEN 'view' THEN 'PROGRAM_ACTION_NOT_EMITTED' ELSE 'SCHEDULE_TIMING_ONLY' END AS sensitive_fields_policy FROM events WHERE event_type IN ('error', 'view', 'click')""",
    "oracle.operations.db_links": """SELECT 'SCH_' || c_custkey AS schema_name, 'L_' || c_name AS db_link_name, NULL AS created_at, CASE WHEN c_acctbal > 0 THEN sha256('host' || c_nationkey) END AS target_host_sha256, CASE WHEN c_acctbal > 0 THEN 'SHA256_OF_HOST_NO_CREDENTIALS' ELSE 'NO_HOST_VISIBLE' END AS target_host_policy,
       'USERNAME_AND_PASSWORD_NOT_EMITTED' AS credential_policy FROM customer""",
    "postgresql.preflight.identity": "SELECT c_custkey AS source_id, 'postgresql' AS engine, '16.' || c_nationkey AS engine_version, c_name AS database_name, NULL AS container_name FROM customer",
    "postgresql.structure.schemas": "SELECT 'SCH_' || c_custkey AS schema_name, c_custkey + 1000 AS native_schema_oid, n_name AS owner_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey <> 2 UNION ALL SELECT 'pg_catalog', 11, n_name FROM nation WHERE n_nationkey = 0 AND n_regionkey <> 2",
    "postgresql.structure.relations": f"SELECT {SN} AS schema_name, {RN} AS relation_name, CASE o_orderpriority WHEN '1-URGENT' THEN 'VIEW' WHEN '2-HIGH' THEN 'MATERIALIZED_VIEW' WHEN '3-MEDIUM' THEN 'PARTITIONED_TABLE' ELSE 'TABLE' END AS relation_kind, {OID} AS native_relation_oid, 'p' AS persistence, o_orderstatus = 'F' AS row_security_enabled, o_orderstatus = 'P' AS is_partition FROM orders WHERE o_orderpriority <> '5-LOW'",
    "postgresql.structure.columns": _L + """SELECT sn AS schema_name, rn AS relation_name, CASE o_orderpriority WHEN '1-URGENT' THEN 'VIEW' WHEN '2-HIGH' THEN 'MATERIALIZED_VIEW' WHEN '3-MEDIUM' THEN 'PARTITIONED_TABLE' ELSE 'TABLE' END AS relation_kind, cn AS column_name, cid AS ordinal_position, 'pg_catalog' AS type_schema_name, 't' || l_linenumber AS data_type,
       l_linenumber::BIGINT AS native_type_oid, l_returnflag <> 'A' AS is_nullable, l_tax = 0.08 AS has_default, '' AS identity_kind, 's' AS generated_kind FROM lo WHERE o_orderpriority <> '5-LOW' AND l_discount <> 0.1""",
    "postgresql.structure.constraints": _L + """, f AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_discount ORDER BY cid) AS pos, row_number() OVER (PARTITION BY l_orderkey, l_discount ORDER BY cid DESC) AS rpos FROM lo WHERE l_discount IN (0.03, 0.05)),
       a AS (SELECT sn AS schema_name, rn AS relation_name, CASE WHEN l_discount = 0.03 THEN 'fk_' ELSE 'pk_' END || l_orderkey AS constraint_name, CASE WHEN l_discount = 0.03 THEN 'FOREIGN_KEY' ELSE 'PRIMARY_KEY' END AS constraint_kind, cn AS column_name, pos AS ordinal_position, CASE WHEN l_discount = 0.03 THEN sn END AS referenced_schema_name,
         CASE WHEN l_discount = 0.03 THEN rn END AS referenced_relation_name, CASE WHEN l_discount = 0.03 THEN (SELECT g.cn FROM f g WHERE g.l_orderkey = f.l_orderkey AND g.l_discount = 0.03 AND g.rpos = f.pos) END AS referenced_column_name, CASE WHEN l_discount = 0.03 THEN 'CASCADE' END AS delete_rule, CASE WHEN l_discount = 0.03 THEN 'NO_ACTION' END AS update_rule,
         true AS is_validated, l_discount = 0.05 AS is_deferrable FROM f UNION ALL SELECT sn, rn, 'ck_' || cid, 'CHECK', CASE WHEN l_linenumber > 1 THEN cn END, CASE WHEN l_linenumber > 1 THEN 1 END, NULL, NULL, NULL, NULL, NULL, l_linestatus = 'F', false FROM lo WHERE l_discount = 0.02)
       SELECT *, 'OMITTED_NO_RAW_DEFINITION' AS definition_disclosure, true AS is_enabled, false AS is_initially_deferred FROM a""",
    "postgresql.structure.dependencies": _L + f"""SELECT lo.sn AS source_schema_name, lo.rn AS source_relation_name, CASE lo.o_orderpriority WHEN '1-URGENT' THEN 'VIEW' ELSE 'MATERIALIZED_VIEW' END AS source_relation_kind, 'SCH_' || t.o_custkey AS target_schema_name, 'T_' || t.o_orderkey AS target_relation_name,
       CASE t.o_orderpriority WHEN '1-URGENT' THEN 'VIEW' WHEN '2-HIGH' THEN 'MATERIALIZED_VIEW' WHEN '3-MEDIUM' THEN 'PARTITIONED_TABLE' ELSE 'TABLE' END AS target_relation_kind, 'PG_DEPEND_REWRITE_NORMAL' AS dependency_kind, 'CATALOG_DECLARED' AS relationship_authority, false AS inferred FROM lo JOIN orders t ON t.o_orderkey = lo.l_partkey
       WHERE lo.o_orderpriority IN ('1-URGENT', '2-HIGH') AND t.o_orderpriority <> '5-LOW' AND l_tax <> 0.08 AND l_discount <> 0.1 AND lo.o_orderkey <> t.o_orderkey""",
}


CASTS = {  # types of oracle columns that are all null, or that the SQL computes narrower than declared
    "mssql_preflight_identity": {"VARCHAR": "container_name"},
    "mssql_structure_columns": {"VARCHAR": "identity_generation identity_options"},
    "mssql_structure_indexes": {"VARCHAR": "column_expression", "BIGINT": "partition_count"},
    "mssql_structure_sequences": {"BIGINT": "cache_size"},
    "mssql_stored_dependencies": {"VARCHAR": "target_server_or_link_name"},
    "oracle_preflight_identity": {"VARCHAR": "engine_edition", "INTEGER": "compatibility_level"},
    "oracle_structure_columns": {"VARCHAR": "data_type_schema identity_seed identity_increment"},
    "oracle_structure_comments": {"INTEGER": "comment_length"},
    "oracle_structure_constraints": {"VARCHAR": "update_rule"},
    "oracle_structure_indexes": {"VARCHAR": "filter_expression", "BIGINT": "partition_count"},
    "oracle_structure_sequences": {"INTEGER": "numeric_precision numeric_scale", "VARCHAR": "start_value", "BIGINT": "cache_size"},
    "oracle_structure_synonyms": {"VARCHAR": "target_catalog_name"},
    "oracle_structure_partitions": {"BIGINT": "partition_count subpartition_count blocks_estimate"},
    "oracle_structure_lobs": {"BIGINT": "chunk retention"},
    "oracle_structure_tablespaces": {"BIGINT": "block_size", "VARCHAR": "status contents logging extent_management allocation_type segment_space_management"},
    "oracle_statistics_tables": {"VARCHAR": "partition_name subpartition_name", "BIGINT": "avg_row_len sample_size"},
    "oracle_statistics_indexes": {"VARCHAR": "partition_name subpartition_name", "BIGINT": "distinct_keys clustering_factor sample_size"},
    "oracle_size_segments": {"BIGINT": "bytes extents"},
    "oracle_stored_objects": {"VARCHAR": "created_at last_ddl_time"},
    "oracle_stored_arguments": {"VARCHAR": "type_owner type_name type_subname"},
    "oracle_stored_errors": {"BIGINT": "sequence position message_number", "INTEGER": "error_text_length"},
    "oracle_stored_dependencies": {"VARCHAR": "target_db_link_name"},
    "oracle_operations_scheduler": {"VARCHAR": "last_start_at", "BIGINT": "failure_count"},
    "oracle_operations_db_links": {"VARCHAR": "created_at"},
    "postgresql_preflight_identity": {"VARCHAR": "container_name"},
    "postgresql_structure_constraints": {"INTEGER": "ordinal_position"},
}


def _bind(qid):
    name = qid.replace(".", "_")

    @R.add("collect_" + name, typed(re.sub(r"\blineitem\b", LINES.format(lineitem="lineitem"), EXPECT[qid]), CASTS.get(name, {})))
    def run(spark, sf):
        by = ["source_id"] if qid.endswith((".identity", ".rights")) else []
        return collected(spark, sf, qid, by)


for _q in COLLECTORS:
    _bind(_q)


@R.add("collect_scoped", f"SELECT {SN} AS schema_name, {RN} AS relation_name, {_OT} AS relation_kind FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'FURNITURE')")
def collect_scoped(spark, sf):
    scope = portable(spark, sf, "SELECT 'SCH_' || c_custkey AS schema_name FROM {customer} WHERE c_mktsegment = 'FURNITURE'")
    return collect("oracle.structure.relations", landed(spark, sf, "oracle"), scope=scope).select("schema_name", "relation_name", "relation_kind")


@R.add("conformed_relations", f"""SELECT engine, relation_kind, count(*) AS n, count(created_at) AS dated FROM (
   SELECT 'mssql' AS engine, CASE o_orderstatus WHEN 'O' THEN 'VIEW' ELSE 'TABLE' END AS relation_kind, o_orderdate AS created_at FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 'oracle', {_OT}, o_orderdate FROM orders
   UNION ALL SELECT 'postgresql', CASE o_orderpriority WHEN '1-URGENT' THEN 'VIEW' WHEN '2-HIGH' THEN 'MATERIALIZED_VIEW' WHEN '3-MEDIUM' THEN 'PARTITIONED_TABLE' ELSE 'TABLE' END, NULL FROM orders WHERE o_orderpriority <> '5-LOW') GROUP BY 1, 2""")
def conformed_relations(spark, sf):
    """Three engines in one estate table."""
    parts = [conform(collect(f"{e}.structure.relations", landed(spark, sf, e)), "relations").withColumn("engine", F.lit(e)) for e in RAW]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("engine", "relation_kind").agg(F.count(F.lit(1)).alias("n"), F.count("created_at").alias("dated"))
