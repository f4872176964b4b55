"""Oracle collectors over landed dictionary views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.scalars import c
from .base import COLUMNS, CONSTRAINTS, IDENTITY, INDEXES, SEQUENCES, SYNONYMS, Catalog, Collector, case, seconds

# fixed values: object types a collector keeps
RELATIONS = ["TABLE", "VIEW", "MATERIALIZED VIEW"]
STORED = ["PACKAGE", "PACKAGE BODY", "PROCEDURE", "FUNCTION", "TRIGGER", "TYPE", "TYPE BODY"]
DEPENDENT = STORED + ["VIEW", "MATERIALIZED VIEW"]
CONSTRAINT = {"P": "PRIMARY_KEY", "U": "UNIQUE", "R": "FOREIGN_KEY", "C": "CHECK"}


def is_(x, v) -> Column:
    return F.coalesce(c(x) == v, F.lit(False))


def plain(x) -> Column:
    """Number as text without exponent or grouping."""
    return c(x).cast("decimal(38,0)").cast("string")


def union(*dfs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, dfs)


def _relation_objects(k: Catalog) -> DataFrame:
    return k.t("all_objects", schema_name="owner", relation_name="object_name", relation_kind="object_type").filter(F.col("relation_kind").isin(RELATIONS))


def identity(k):
    """C12."""
    p = k.t("product_component_version", product="product", engine_version="version").filter("product like 'Oracle%Database%'")
    s = k.t("session_context", database_name="db_unique_name", container_name="con_name")
    return k.out(k.beside(p, s).withColumn("engine", F.lit("oracle")), IDENTITY)


def rights(k):
    """C13. System, object, column and role-granted object privileges as one list of names."""
    me = k.t("session_context", grantee="session_user")
    def name(kind, *parts):
        return F.concat(F.lit(kind + ":"), "privilege", F.lit(":"), F.concat_ws(".", *parts))
    system = k.t("session_privs", privilege="privilege").withColumn("permission_name", F.concat(F.lit("SYSTEM:"), "privilege"))
    obj = k.join(k.t("all_tab_privs", privilege="privilege", s="table_schema", n="table_name", grantee="grantee"), me, ["grantee"]).withColumn("permission_name", name("OBJECT", "s", "n"))
    col = k.join(k.t("all_col_privs", privilege="privilege", s="table_schema", n="table_name", x="column_name", grantee="grantee"), me, ["grantee"]).withColumn("permission_name", name("COLUMN_OBJECT", "s", "n", "x"))
    role = k.join(k.t("role_tab_privs", privilege="privilege", s="owner", n="table_name", role="role"), k.t("session_roles", role="role"), ["role"]).withColumn("permission_name", name("ROLE_OBJECT", "s", "n"))
    return union(*[k.out(d.withColumn("has_permission", F.lit(1)), "permission_name string, has_permission int") for d in (system, obj, col, role)])


def schemas(k):
    """C15."""
    return _relation_objects(k).select(*k.by, "schema_name").distinct()


def relations(k):
    """C16."""
    o = k.t("all_objects", schema_name="owner", relation_name="object_name", relation_kind="object_type", object_id="object_id", created_at=seconds("created"), modified_at=seconds("last_ddl_time"), status="status", temporary="temporary")
    return k.out(o.filter(F.col("relation_kind").isin(RELATIONS)), "schema_name string, relation_name string, relation_kind string, object_id bigint, created_at string, modified_at string, status string, temporary string")


def columns(k):
    """C17."""
    virtual = F.col("virtual_column") == "YES"
    x = k.t("all_tab_cols", schema_name="owner", relation_name="table_name", column_name="column_name", ordinal_position="column_id", data_type_schema="data_type_owner", data_type="data_type", max_length="data_length",
            numeric_precision="data_precision", numeric_scale="data_scale", is_nullable=is_("nullable", "Y"), virtual_column="virtual_column", value="data_default_vc")
    i = k.t("all_tab_identity_cols", schema_name="owner", relation_name="table_name", column_name="column_name", identity_generation="generation_type", identity_options="identity_options", is_identity=F.lit(True))
    x = k.join(k.join(x, _relation_objects(k), ["schema_name", "relation_name"]), i, ["schema_name", "relation_name", "column_name"], "left").fillna({"is_identity": False})
    x = x.withColumns({
        "default_expression": F.when(F.col("virtual_column") == "NO", F.col("value")), "generation_expression": F.when(virtual, F.col("value")),
        "generation_kind": F.when(virtual, "VIRTUAL").when(F.col("is_identity"), "IDENTITY").otherwise("NONE")})
    return k.out(x, COLUMNS)


def comments(k):
    """C18. Length and hash of relation and column comments, never the text."""
    t = k.t("all_tab_comments", schema_name="owner", relation_name="table_name", column_name=F.lit(None).cast("string"), comments="comments", comment_scope=F.lit("RELATION"))
    x = k.t("all_col_comments", schema_name="owner", relation_name="table_name", column_name="column_name", comments="comments", comment_scope=F.lit("COLUMN"))
    known = _relation_objects(k).drop("relation_kind").withColumn("_r", F.lit(1))
    out = k.join(t.unionByName(x), known, ["schema_name", "relation_name"]).withColumns({
        "comment_length": F.coalesce(F.length("comments"), F.lit(0)), "comment_sha256": F.sha2("comments", 256), "comment_hash_algorithm": F.lit("SHA256_OF_COMMENT_TEXT")})
    return k.out(out, "schema_name string, relation_name string, column_name string, comment_scope string, comment_length int, comment_sha256 string, comment_hash_algorithm string")


def constraints(k):
    """C19. A foreign key meets the key it references column by column, on position. Constraint columns are dealt once, by the constraint
    that holds them, for those who have them and those who reference them; position is compared within a constraint."""
    ct = F.col("t")
    own, ref = ["schema_name", "relation_name", "constraint_name"], ["r_owner", "referenced_relation_name", "r_name"]
    x = k.t("all_constraints", schema_name="owner", relation_name="table_name", constraint_name="constraint_name", t="constraint_type", r_owner="r_owner", r_name="r_constraint_name", cond="search_condition_vc", rule="delete_rule",
            is_enabled=is_("status", "ENABLED"), is_validated=is_("validated", "VALIDATED"), is_deferrable=is_("deferrable", "DEFERRABLE"), is_initially_deferred=is_("deferred", "DEFERRED")).filter(ct.isin(list(CONSTRAINT)))
    cc = k.t("all_cons_columns", schema_name="owner", relation_name="table_name", constraint_name="constraint_name", at=F.struct("column_name", "position"))
    rc = k.t("all_constraints", r_owner="owner", r_name="constraint_name", referenced_relation_name="table_name", _met=F.lit(True))
    rcc = cc.select(*k.by, *[F.col(n).alias(m) for n, m in zip(own, ref)], F.col("at").alias("ref"))
    x = k.join(x, cc, own, "left").withColumns({"column_name": F.col("at.column_name"), "ordinal_position": F.col("at.position")}).drop("at")
    refers = F.col("r_owner").isNotNull() & F.col("r_name").isNotNull()  # the others meet no key
    none = {n: F.lit(None).cast("string") for n in ("referenced_schema_name", "referenced_relation_name", "referenced_column_name")}
    r = k.join(x.filter(refers), rc, ["r_owner", "r_name"], "left").withColumn("referenced_schema_name", F.when(F.col("_met"), F.col("r_owner"))).drop("_met").alias("r")
    meets = [F.col(f"r.{n}") == F.col(f"c.{n}") for n in k.by + ref] + [F.coalesce(F.col("ordinal_position") == F.col("ref.position"), F.lit(False))]
    r = r.join(rcc.alias("c"), meets, "left").select("r.*", F.col("ref.column_name").alias("referenced_column_name"))
    x = r.unionByName(x.filter(~refers).withColumns(none))
    return k.out(x.withColumns({"constraint_kind": case("t", CONSTRAINT), "check_expression": F.when(ct == "C", F.col("cond")), "delete_rule": F.when(ct == "R", F.col("rule"))}), CONSTRAINTS)


def indexes(k):
    """C20."""
    i = k.t("all_indexes", owner="owner", schema_name="table_owner", relation_name="table_name", index_name="index_name", index_kind="index_type", is_unique=is_("uniqueness", "UNIQUE"), is_enabled=is_("status", "VALID"), data_space_name="tablespace_name")
    ic = k.t("all_ind_columns", owner="index_owner", index_name="index_name", schema_name="table_owner", relation_name="table_name", column_name="column_name", ordinal_position="column_position")
    ie = k.t("all_ind_expressions", owner="index_owner", index_name="index_name", schema_name="table_owner", relation_name="table_name", ordinal_position="column_position", column_expression="column_expression")
    pi = k.t("all_part_indexes", owner="owner", index_name="index_name", partitioning_kind="partitioning_type", partition_count="partition_count")
    pk = k.t("all_part_key_columns", owner="owner", index_name="name", column_name="column_name", partition_ordinal="column_position", ot="object_type").filter("ot = 'INDEX'").drop("ot")
    cn = k.t("all_constraints", schema_name="owner", relation_name="table_name", owner="index_owner", index_name="index_name", ct="constraint_type").filter(F.col("ct").isin("P", "U"))
    on = ["owner", "index_name", "schema_name", "relation_name"]
    # constraints meet on the key that the rows are already dealt by
    x = k.join(k.join(k.join(k.join(i, ic, on), cn, on, "left"), ie, on + ["ordinal_position"], "left"), pi, ["owner", "index_name"], "left")
    x = k.join(x, pk, ["owner", "index_name", "column_name"], "left").fillna({"partitioning_kind": "NONE", "partition_count": 1})
    return k.out(x.withColumns({"is_included": F.lit(False), "is_partition_key": F.col("partition_ordinal").isNotNull(), "is_primary_key": is_("ct", "P"), "is_unique_constraint": is_("ct", "U")}), INDEXES)


def sequences(k):
    """C21."""
    q = k.t("all_sequences", schema_name="sequence_owner", sequence_name="sequence_name", increment_by=plain("increment_by"), min_value=plain("min_value"), max_value=plain("max_value"), is_cycling=is_("cycle_flag", "Y"),
            cache_size="cache_size", observed_value=plain("last_number"), data_type=F.lit("NUMBER"), observed_value_semantics=F.lit("LAST_NUMBER"))
    return k.out(q, SEQUENCES)


def synonyms(k):
    """C22."""
    s = k.t("all_synonyms", schema_name="owner", synonym_name="synonym_name", target_schema_name="table_owner", target_object_name="table_name", remote_locator="db_link")
    ref = F.concat_ws("@", F.concat(F.coalesce("target_schema_name", F.lit("")), F.lit("."), F.coalesce("target_object_name", F.lit(""))), "remote_locator")
    return k.out(s.withColumn("target_reference", ref), SYNONYMS)


def partitions(k):
    """C23. Partitioned tables with their key columns, partitions and subpartitions."""
    pt = k.t("all_part_tables", schema_name="owner", relation_name="table_name", partitioning_type="partitioning_type", subpartitioning_type="subpartitioning_type", partition_count="partition_count")
    pk = k.t("all_part_key_columns", schema_name="owner", relation_name="name", partition_key_column="column_name", partition_key_ordinal="column_position", ot="object_type").filter("ot = 'TABLE'").drop("ot")
    a = k.join(pt, pk, ["schema_name", "relation_name"], "left").withColumn("partition_scope", F.lit("TABLE_PARTITIONING"))
    stats = dict(tablespace_name="tablespace_name", num_rows_estimate="num_rows", blocks_estimate="blocks", last_analyzed=seconds("last_analyzed"))
    b = k.t("all_tab_partitions", schema_name="table_owner", relation_name="table_name", partition_name="partition_name", subpartition_count="subpartition_count", partition_scope=F.lit("TABLE_PARTITION"), **stats)
    d = k.t("all_tab_subpartitions", schema_name="table_owner", relation_name="table_name", partition_name="partition_name", subpartition_name="subpartition_name", partition_scope=F.lit("TABLE_SUBPARTITION"), **stats)
    spec = ("schema_name string, relation_name string, relation_kind string, partition_scope string, partition_name string, subpartition_name string, partitioning_type string, subpartitioning_type string, partition_count bigint, "
            "subpartition_count bigint, partition_key_column string, partition_key_ordinal int, tablespace_name string, num_rows_estimate bigint, blocks_estimate bigint, last_analyzed string")
    return union(*[k.out(x.withColumn("relation_kind", F.lit("TABLE")), spec) for x in (a, b, d)])


def lobs(k):
    """C24."""
    names = ["column_name", "segment_name", "tablespace_name", "securefile", "compression", "deduplication", "in_row", "chunk", "retention", "cache", "logging"]
    x = k.t("all_lobs", schema_name="owner", relation_name="table_name", encryption="encrypt", **{n: n for n in names})
    return k.out(x, "schema_name string, relation_name string, column_name string, segment_name string, tablespace_name string, securefile string, compression string, deduplication string, encryption string, in_row string, "
                    "chunk bigint, retention bigint, cache string, logging string")


def tablespaces(k):
    """C25. Tablespaces that visible tables, indexes and LOBs name, and how often."""
    used = union(*[k.t(v, schema_name="owner", tablespace_name="tablespace_name") for v in ("all_tables", "all_indexes", "all_lobs")]).filter("tablespace_name is not null")
    g = used.groupBy(*k.by, "schema_name", "tablespace_name").agg(F.count(F.lit(1)).alias("visible_object_references"))
    return k.out(g, "schema_name string, tablespace_name string, block_size bigint, status string, contents string, logging string, extent_management string, allocation_type string, segment_space_management string, "
                    "visible_object_references bigint")


def table_statistics(k):
    """C26. Optimizer estimates, labelled as such."""
    x = k.t("all_tab_statistics", schema_name="owner", relation_name="table_name", object_type="object_type", partition_name="partition_name", subpartition_name="subpartition_name", num_rows_estimate="num_rows", blocks_estimate="blocks",
            avg_row_len="avg_row_len", sample_size="sample_size", last_analyzed=seconds("last_analyzed"), stale_stats="stale_stats").withColumn("row_count_semantics", F.lit("OPTIMIZER_STATISTICS_ESTIMATE"))
    return k.out(x, "schema_name string, relation_name string, object_type string, partition_name string, subpartition_name string, num_rows_estimate bigint, blocks_estimate bigint, avg_row_len bigint, sample_size bigint, "
                    "last_analyzed string, stale_stats string, row_count_semantics string")


def index_statistics(k):
    """C27."""
    x = k.t("all_ind_statistics", schema_name="owner", relation_name="table_name", index_name="index_name", object_type="object_type", partition_name="partition_name", subpartition_name="subpartition_name", num_rows_estimate="num_rows",
            leaf_blocks="leaf_blocks", distinct_keys="distinct_keys", clustering_factor="clustering_factor", sample_size="sample_size", last_analyzed=seconds("last_analyzed"), stale_stats="stale_stats").withColumn(
        "row_count_semantics", F.lit("OPTIMIZER_STATISTICS_ESTIMATE"))
    return k.out(x, "schema_name string, relation_name string, index_name string, object_type string, partition_name string, subpartition_name string, num_rows_estimate bigint, leaf_blocks bigint, distinct_keys bigint, "
                    "clustering_factor bigint, sample_size bigint, last_analyzed string, stale_stats string, row_count_semantics string")


def segment_sizes(k):
    """C28. Block metadata of what is visible; bytes are never guessed."""
    def branch(table, kind, label, **cols):
        return k.t(table, tablespace_name="tablespace_name", **cols).withColumns({"segment_type": F.lit(kind), "size_semantics": F.lit(f"VISIBLE_{label}_METADATA_BYTES_NOT_VISIBLE")})
    parts = [
        branch("all_tables", "TABLE_OR_MATERIALIZED_VIEW", "TABLE_BLOCK", schema_name="owner", segment_name="table_name", blocks="blocks"),
        branch("all_tab_partitions", "TABLE_PARTITION", "PARTITION_BLOCK", schema_name="table_owner", segment_name="table_name", partition_name="partition_name", blocks="blocks"),
        branch("all_indexes", "INDEX", "INDEX_LEAF_BLOCK", schema_name="owner", segment_name="index_name", blocks="leaf_blocks"),
        branch("all_lobs", "LOB", "LOB", schema_name="owner", segment_name="segment_name")]
    spec = "schema_name string, segment_name string, partition_name string, segment_type string, tablespace_name string, bytes bigint, blocks bigint, extents bigint, size_semantics string"
    return union(*[k.out(p, spec) for p in parts])


def mview_refresh(k):
    """C29."""
    names = ["container_name", "build_mode", "refresh_mode", "refresh_method", "fast_refreshable", "last_refresh_type", "staleness", "compile_state"]
    x = k.t("all_mviews", schema_name="owner", relation_name="mview_name", last_refresh_date=seconds("last_refresh_date"), **{n: n for n in names})
    return k.out(x, "schema_name string, relation_name string, container_name string, build_mode string, refresh_mode string, refresh_method string, fast_refreshable string, last_refresh_date string, last_refresh_type string, "
                    "staleness string, compile_state string")


def stored_objects(k):
    """C30. Source is reduced to line hashes where it is read; only 64-character hashes of an object are gathered,
    since the object hash is defined over their whole ordered sequence."""
    o = k.t("all_objects", schema_name="owner", object_name="object_name", object_kind="object_type", native_object_id="object_id", status="status", created_at=seconds("created"), last_ddl_time=seconds("last_ddl_time")).filter(F.col("object_kind").isin(STORED))
    key = ["schema_name", "object_name", "object_kind"]
    s = k.t("all_source", schema_name="owner", object_name="name", object_kind="type", line="line", h=F.sha2("text", 256), w=F.lower("text").contains("wrapped"))
    s = s.groupBy(*k.by, *key).agg(F.count("line").alias("source_line_count"), F.array_sort(F.collect_list(F.struct("line", "h"))).alias("lines"), F.bool_or("w").alias("wrapped"))
    s = s.withColumn("source_hash_sha256", F.sha2(F.array_join(F.transform("lines", lambda x: x["h"]), ""), 256)).drop("lines")
    t = k.t("all_triggers", schema_name="owner", object_name="trigger_name", trigger_state="status", trigger_table_schema_name="table_owner", trigger_table_name="table_name", is_trigger=F.lit(True))
    x = k.join(k.join(o, s, key, "left"), t, ["schema_name", "object_name"], "left").fillna({"source_line_count": 0})
    seen = F.col("source_line_count") > 0
    x = x.withColumns({
        "trigger_status": F.when(F.col("is_trigger").isNull(), "NOT_APPLICABLE").otherwise(F.col("trigger_state")),
        "source_hash_algorithm": F.when(seen, "SHA256_OF_ORDERED_SOURCE_LINE_SHA256_VALUES"),
        "source_storage_policy": F.when(seen, "LOCAL_HASH_ONLY_RAW_SOURCE_NOT_EMITTED").otherwise("SOURCE_NOT_VISIBLE"), "wrapped_code_blind_spot": F.coalesce("wrapped", F.lit(False))})
    return k.out(x, "schema_name string, object_name string, object_kind string, native_object_id bigint, status string, created_at string, last_ddl_time string, trigger_status string, trigger_table_schema_name string, "
                    "trigger_table_name string, source_line_count bigint, source_hash_sha256 string, source_hash_algorithm string, source_storage_policy string, wrapped_code_blind_spot boolean")


def arguments(k):
    """C31."""
    names = ["package_name", "argument_name", "position", "sequence", "data_level", "data_type", "type_owner", "type_name", "type_subname", "in_out", "defaulted"]
    x = k.t("all_arguments", schema_name="owner", subprogram_name="object_name", **{n: n for n in names})
    x = x.withColumns({"object_name": F.coalesce("package_name", "subprogram_name"), "default_value_policy": F.when(is_("defaulted", "Y"), "DEFAULT_EXISTS_VALUE_NOT_EMITTED").otherwise("NO_DEFAULT")})
    return k.out(x, "schema_name string, object_name string, package_name string, subprogram_name string, argument_name string, position int, sequence int, data_level int, data_type string, type_owner string, type_name string, "
                    "type_subname string, in_out string, defaulted string, default_value_policy string")


def errors(k):
    """C32. Length and hash of compile errors, never the text."""
    names = ["sequence", "line", "position", "attribute", "message_number"]
    x = k.t("all_errors", schema_name="owner", object_name="name", object_kind="type", error_text_length=F.length("text"), error_text_sha256=F.sha2("text", 256), **{n: n for n in names})
    return k.out(x.withColumn("error_hash_algorithm", F.lit("SHA256_OF_COMPILE_ERROR_TEXT")), "schema_name string, object_name string, object_kind string, sequence bigint, line bigint, position bigint, attribute string, message_number bigint, "
                 "error_text_length int, error_text_sha256 string, error_hash_algorithm string")


def dependencies(k):
    """C33."""
    x = k.t("all_dependencies", source_schema_name="owner", source_object_name="name", source_object_kind="type", target_schema_name="referenced_owner", target_object_name="referenced_name", target_object_kind="referenced_type",
            target_db_link_name="referenced_link_name", native_dependency_kind="dependency_type").filter(F.col("source_object_kind").isin(DEPENDENT))
    x = x.withColumns({"resolution_state": F.when(F.col("target_schema_name").isNull() | F.col("target_object_name").isNull(), "UNRESOLVED").otherwise("RESOLVED"), "column_resolution_state": F.lit("NOT_PROVEN")})
    return k.out(x, "source_schema_name string, source_object_name string, source_object_kind string, target_schema_name string, target_object_name string, target_object_kind string, target_db_link_name string, "
                    "native_dependency_kind string, resolution_state string, column_resolution_state string")


def scheduler(k):
    """C34. Jobs, programs and schedules without their actions."""
    j = k.t("all_scheduler_jobs", schema_name="owner", object_name="job_name", enabled="enabled", status="state", type_name="job_type", class_name="job_class", program_name="program_name", schedule_name="schedule_name",
            start_at=seconds("start_date"), next_run_at=seconds("next_run_date"), last_start_at=seconds("last_start_date"), last_run_duration="last_run_duration", run_count="run_count", failure_count="failure_count")
    p = k.t("all_scheduler_programs", schema_name="owner", object_name="program_name", program_name="program_name", enabled="enabled", type_name="program_type", run_count="number_of_arguments")
    s = k.t("all_scheduler_schedules", schema_name="owner", object_name="schedule_name", schedule_name="schedule_name", type_name="schedule_type", repeat_interval="repeat_interval", start_at=seconds("start_date"))
    spec = ("schema_name string, object_name string, object_kind string, enabled string, status string, type_name string, class_name string, program_name string, schedule_name string, repeat_interval string, start_at string, "
            "next_run_at string, last_start_at string, last_run_duration string, run_count bigint, failure_count bigint, sensitive_fields_policy string")
    kinds = ((j, "SCHEDULER_JOB", "JOB_ACTION_NOT_EMITTED"), (p, "SCHEDULER_PROGRAM", "PROGRAM_ACTION_NOT_EMITTED"), (s, "SCHEDULER_SCHEDULE", "SCHEDULE_TIMING_ONLY"))
    return union(*[k.out(d.withColumns({"object_kind": F.lit(n), "sensitive_fields_policy": F.lit(pol)}), spec) for d, n, pol in kinds])


def db_links(k):
    """C35. The host as a hash; no credentials."""
    x = k.t("all_db_links", schema_name="owner", db_link_name="db_link", created_at=seconds("created"), host="host")
    x = x.withColumns({"target_host_sha256": F.sha2("host", 256), "target_host_policy": F.when(F.col("host").isNull(), "NO_HOST_VISIBLE").otherwise("SHA256_OF_HOST_NO_CREDENTIALS"),
                       "credential_policy": F.lit("USERNAME_AND_PASSWORD_NOT_EMITTED")})
    return k.out(x, "schema_name string, db_link_name string, created_at string, target_host_sha256 string, target_host_policy string, credential_policy string")


_S = "schema_name"
COLLECTORS = [
    Collector("oracle.preflight.identity", "preflight", None, ("database_name",), 5, identity),
    Collector("oracle.preflight.rights", "preflight", None, ("permission_name",), 5, rights),
    Collector("oracle.structure.schemas", "schemas", _S, (_S,), 5, schemas),
    Collector("oracle.structure.relations", "relations", _S, (_S, "relation_name", "relation_kind"), 5, relations),
    Collector("oracle.structure.columns", "columns", _S, (_S, "relation_name", "ordinal_position", "column_name"), 5, columns),
    Collector("oracle.structure.comments", "comments", _S, (_S, "relation_name", "comment_scope", "column_name"), 5, comments),
    Collector("oracle.structure.constraints", "constraints", _S, (_S, "relation_name", "constraint_kind", "constraint_name", "ordinal_position", "column_name"), 5, constraints),
    Collector("oracle.structure.indexes", "indexes", _S, (_S, "relation_name", "index_name", "ordinal_position", "column_name"), 5, indexes),
    Collector("oracle.structure.sequences", "sequences", _S, (_S, "sequence_name"), 5, sequences),
    Collector("oracle.structure.synonyms", "synonyms", _S, (_S, "synonym_name"), 5, synonyms),
    Collector("oracle.structure.partitions", "partitions", _S, (_S, "relation_name", "partition_scope", "partition_name", "subpartition_name", "partition_key_ordinal"), 7, partitions),
    Collector("oracle.structure.lobs", "lobs", _S, (_S, "relation_name", "column_name", "segment_name"), 5, lobs),
    Collector("oracle.structure.tablespaces", "tablespaces", _S, (_S, "tablespace_name"), 5, tablespaces),
    Collector("oracle.statistics.tables", "statistics", _S, (_S, "relation_name", "object_type", "partition_name", "subpartition_name"), 7, table_statistics),
    Collector("oracle.statistics.indexes", "statistics", _S, (_S, "relation_name", "index_name", "object_type", "partition_name", "subpartition_name"), 7, index_statistics),
    Collector("oracle.size.segments", "sizes", _S, (_S, "segment_type", "segment_name", "partition_name"), 7, segment_sizes),
    Collector("oracle.structure.mview_refresh", "operations", _S, (_S, "relation_name"), 5, mview_refresh),
    Collector("oracle.stored.objects", "stored-objects", _S, (_S, "object_name", "object_kind"), 7, stored_objects),
    Collector("oracle.stored.arguments", "stored-arguments", _S, (_S, "object_name", "subprogram_name", "sequence", "position", "argument_name"), 7, arguments),
    Collector("oracle.stored.errors", "stored-errors", _S, (_S, "object_name", "object_kind", "sequence"), 5, errors),
    Collector("oracle.stored.dependencies", "stored-dependencies", "source_schema_name", ("source_schema_name", "source_object_name", "source_object_kind"), 7, dependencies),
    Collector("oracle.operations.scheduler", "operations", _S, (_S, "object_kind", "object_name"), 7, scheduler),
    Collector("oracle.operations.db_links", "db-links", _S, (_S, "db_link_name"), 5, db_links),
]
