"""Closed vocabularies and explicit schemas shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: state vocabularies ---------------------------------------------------------------
COVERAGE_STATES = ["SUCCEEDED", "PARTIAL", "DENIED", "UNSUPPORTED", "TIMEOUT", "ERROR"]
VISIBILITY = {
    "SUCCEEDED": "VISIBLE_COMPLETE",
    "PARTIAL": "VISIBLE_PARTIAL",
    "DENIED": "INVISIBLE",
    "UNSUPPORTED": "NOT_APPLICABLE",
    "TIMEOUT": "UNKNOWN",
    "ERROR": "UNKNOWN",
}
PROFILING_STATES = ["SUCCEEDED", "PARTIAL", "DENIED", "UNSUPPORTED", "TIMEOUT", "TAMPER"]
OBJECT_STATES = ["COMPLETE", "PARTIAL", "DENIED", "UNSUPPORTED", "UNKNOWN"]
RECEIPT_STATES = ["CANCELLED", "DENIED", "PARTIAL", "SUCCEEDED", "TIMEOUT", "UNKNOWN", "UNSUPPORTED"]
DIFF_CLASSES = ["ADDED", "REMOVED", "CHANGED", "DENIED", "UNSUPPORTED", "UNKNOWN"]
REASON_CODE = "^[A-Z][A-Z0-9_]{2,127}$"
HEX64 = "^[a-f0-9]{64}$"
OBSERVATION_FIELDS = ["observationTimestamp", "observation_timestamp", "observedAt"]
BREADTH_THRESHOLD_BPS = 9500
HIGH_CONFIDENCE_BPS = 9500

# --- fixed values: outcome journal transitions (from, event, to) ------------------------------------
JOURNAL_START = "__start__"
JOURNAL_TRANSITIONS = [
    ("__start__", "initialized", "not_dispatched"),
    ("not_dispatched", "dispatch_known_rejected", "known_rejected"),
    ("not_dispatched", "dispatch_response_lost", "outcome_unknown"),
    ("not_dispatched", "dispatch_committed_acknowledged", "committed_equivalent"),
    ("outcome_unknown", "reconcile_exact_after", "committed_equivalent"),
    ("outcome_unknown", "reconcile_exact_before", "unchanged_safe_to_retry"),
    ("outcome_unknown", "reconcile_owned_partial", "partial"),
    ("outcome_unknown", "reconcile_diverged", "diverged"),
    ("outcome_unknown", "reconcile_manual_review", "manual_review"),
    ("unchanged_safe_to_retry", "fresh_retry_authorized", "not_dispatched"),
    ("partial", "manual_review_opened", "manual_review"),
    ("diverged", "manual_review_opened", "manual_review"),
]

# --- fixed values: native type families -------------------------------------------------------------
POSTGRES_TYPE_FAMILY = {
    "bool": "BOOLEAN",
    "int2": "NUMERIC", "int4": "NUMERIC", "int8": "NUMERIC", "numeric": "NUMERIC",
    "float4": "NUMERIC", "float8": "NUMERIC", "money": "NUMERIC",
    "text": "TEXT", "varchar": "TEXT", "bpchar": "TEXT", "name": "TEXT", "uuid": "TEXT",
    "date": "TEMPORAL", "time": "TEMPORAL", "timetz": "TEMPORAL", "timestamp": "TEMPORAL", "timestamptz": "TEMPORAL",
}

# --- fixed values: ambient principal schemas of SQL Server ------------------------------------------
AMBIENT_SCHEMAS = [
    "db_accessadmin", "db_backupoperator", "db_datareader", "db_datawriter", "db_ddladmin",
    "db_denydatareader", "db_denydatawriter", "db_owner", "db_securityadmin", "guest",
]

TARGET = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("schema_name", T.StringType()),
    T.StructField("relation_name", T.StringType()),
    T.StructField("column_name", T.StringType()),
    T.StructField("dst_schema_name", T.StringType()),
    T.StructField("dst_relation_name", T.StringType()),
    T.StructField("dst_column_name", T.StringType()),
])
EXTRACT_STATUS = T.StructType([
    T.StructField("source_id", T.StringType()),
    T.StructField("query_id", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("reason_code", T.StringType()),
    T.StructField("row_count", T.LongType()),
])


def _s(*names):
    return [T.StructField(n, T.StringType()) for n in names]


def _i(*names):
    return [T.StructField(n, T.IntegerType()) for n in names]


def _b(*names):
    return [T.StructField(n, T.BooleanType()) for n in names]


EXTRACT_SCHEMAS = {
    "identity": T.StructType(_s("engine", "engine_version", "engine_edition", "database_name", "container_name") + _i("compatibility_level")),
    "rights": T.StructType(_s("permission_name") + _i("has_permission")),
    "schemas": T.StructType(_s("schema_name") + [T.StructField("schema_id", T.LongType())] + _s("owner_name")),
    "relations": T.StructType(
        _s("schema_name", "relation_name", "relation_kind") + [T.StructField("object_id", T.LongType())]
        + _s("created_at", "modified_at") + _b("is_ms_shipped")),
    "columns": T.StructType(
        _s("schema_name", "relation_name", "relation_kind", "column_name") + _i("ordinal_position")
        + _s("data_type_schema", "data_type") + _i("max_length", "numeric_precision", "numeric_scale") + _b("is_nullable")
        + _s("default_expression", "generation_kind", "generation_expression") + _b("is_identity")
        + _s("identity_seed", "identity_increment", "identity_generation", "identity_options")),
    "constraints": T.StructType(
        _s("schema_name", "relation_name", "constraint_name", "constraint_kind", "column_name") + _i("ordinal_position")
        + _s("referenced_schema_name", "referenced_relation_name", "referenced_column_name", "check_expression", "delete_rule", "update_rule")
        + _b("is_enabled", "is_validated", "is_deferrable", "is_initially_deferred")),
    "indexes": T.StructType(
        _s("schema_name", "relation_name", "index_name", "index_kind", "column_name") + _i("ordinal_position")
        + _s("column_expression") + _b("is_included", "is_partition_key") + _i("partition_ordinal")
        + _b("is_unique", "is_primary_key", "is_unique_constraint", "is_enabled") + _s("filter_expression", "data_space_name", "partitioning_kind")
        + _i("partition_count")),
    "dependencies": T.StructType(
        _s("source_schema_name", "source_relation_name", "source_relation_kind", "target_schema_name", "target_relation_name",
           "target_relation_kind", "dependency_kind", "relationship_authority") + _b("inferred")),
}
