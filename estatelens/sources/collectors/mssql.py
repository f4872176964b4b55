"""SQL Server collectors over landed sys.* tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...session import measured
from .base import COLUMNS, CONSTRAINTS, IDENTITY, INDEXES, SEQUENCES, SYNONYMS, Catalog, Collector, case, millis

# fixed values: object type codes
ROUTINE = {("P", "PC"): "PROCEDURE", ("FN", "FS", "FT", "IF", "TF"): "FUNCTION", ("TR", "TA"): "TRIGGER"}
ROUTINE_CODES = ["P", "PC", "FN", "FS", "FT", "IF", "TF", "TR", "TA"]
TARGET = {"U": "TABLE", "V": "VIEW", **ROUTINE, "SO": "SEQUENCE", "SN": "SYNONYM"}
RELATION = {"U": "TABLE", "V": "VIEW"}
REQUESTED = ["CONNECT", "VIEW DEFINITION"]


def _schemas(k: Catalog) -> DataFrame:
    return k.t("sys.schemas", schema_id="schema_id", schema_name="name")


def _objects(k: Catalog) -> DataFrame:
    o = k.t("sys.objects", object_id="object_id", object_name="name", type=F.rtrim("type"), schema_id="schema_id", shipped="is_ms_shipped",
            parent_object_id="parent_object_id", create_date="create_date", modify_date="modify_date")
    return k.join(o, _schemas(k), ["schema_id"])


def _tables(k: Catalog) -> DataFrame:
    """User tables with their schema: (object_id, schema_name, relation_name)."""
    t = k.t("sys.tables", object_id="object_id", relation_name="name", schema_id="schema_id", shipped="is_ms_shipped").filter(~F.col("shipped"))
    return k.join(t, _schemas(k), ["schema_id"]).drop("schema_id", "shipped")


def _cols(k: Catalog) -> DataFrame:
    return k.t("sys.columns", object_id="object_id", column_id="column_id", column_name="name")


def identity(k):
    """C1. The connected database with server version and edition."""
    d = k.t("sys.databases", database_name="name", compatibility_level="compatibility_level")
    s = k.t("server", database_name="database_name", engine_version="product_version", engine_edition="edition")
    return k.out(k.join(d, s, ["database_name"]).withColumn("engine", F.lit("mssql")), IDENTITY)


def rights(k):
    """C2. Requested permissions and whether the session holds them."""
    asked = k.t("server", database_name="database_name").withColumn("permission_name", F.explode(F.array(*[F.lit(x) for x in REQUESTED])))
    held = k.t("granted_permissions", permission_name="permission_name").distinct().withColumn("has_permission", F.lit(1))
    return k.out(k.join(asked, held, ["permission_name"], "left").fillna({"has_permission": 0}), "permission_name string, has_permission int")


def schemas(k):
    """C3."""
    s = k.t("sys.schemas", schema_name="name", schema_id="schema_id", principal_id="principal_id").filter(~F.col("schema_name").isin("sys", "INFORMATION_SCHEMA"))
    p = k.t("sys.database_principals", principal_id="principal_id", owner_name="name")
    return k.out(k.join(s, p, ["principal_id"], "left"), "schema_name string, schema_id bigint, owner_name string")


def relations(k):
    """C4."""
    o = _objects(k).filter(F.col("type").isin("U", "V") & ~F.col("shipped")).withColumns({
        "relation_name": F.col("object_name"), "relation_kind": case("type", RELATION), "created_at": millis("create_date"), "modified_at": millis("modify_date"), "is_ms_shipped": F.col("shipped")})
    return k.out(o, "schema_name string, relation_name string, relation_kind string, object_id bigint, created_at string, modified_at string, is_ms_shipped boolean")


def columns(k):
    """C5."""
    o = _objects(k).filter(F.col("type").isin("U", "V") & ~F.col("shipped")).select(*k.by, "object_id", "schema_name", F.col("object_name").alias("relation_name"), case("type", RELATION).alias("relation_kind"))
    ty = k.t("sys.types", user_type_id="user_type_id", data_type="name", type_schema="schema_id")
    ts = k.t("sys.schemas", type_schema="schema_id", data_type_schema="name")
    c = k.t("sys.columns", object_id="object_id", column_id="column_id", column_name="name", ordinal_position="column_id", user_type_id="user_type_id", max_length="max_length", numeric_precision="precision",
            numeric_scale="scale", is_nullable="is_nullable", is_computed="is_computed", is_identity="is_identity", default_id="default_object_id")
    d = k.t("sys.default_constraints", default_id="object_id", default_expression="definition")
    g = k.t("sys.computed_columns", object_id="object_id", column_id="column_id", generation_expression="definition")
    i = k.t("sys.identity_columns", object_id="object_id", column_id="column_id", identity_seed="seed_value", identity_increment="increment_value")
    ty = measured(k.join(ty, ts, ["type_schema"]))  # few rows as a rule: columns need not be dealt by their type
    bare = F.coalesce(F.col("default_id") == 0, F.lit(True))  # most columns have no default, and would all meet in one task
    c = k.join(c.filter(~bare), d, ["default_id"], "left").unionByName(c.filter(bare).withColumn("default_expression", F.lit(None).cast("string")))
    x = k.join(k.join(c, o, ["object_id"]), ty, ["user_type_id"])
    x = k.join(k.join(x, g, ["object_id", "column_id"], "left"), i, ["object_id", "column_id"], "left")
    x = x.withColumn("generation_kind", F.when(F.col("is_computed"), "COMPUTED").when(F.col("is_identity"), "IDENTITY").otherwise("NONE"))
    return k.out(x, COLUMNS)


def constraints(k):
    """C6. Keys, foreign keys and checks; flags the catalog stores negated are turned round."""
    t = _tables(k)
    cols = _cols(k)
    ix = k.t("sys.indexes", object_id="object_id", index_id="index_id", is_enabled=~F.col("is_disabled"))
    ic = k.t("sys.index_columns", object_id="object_id", index_id="index_id", column_id="column_id", ordinal_position="key_ordinal").filter("ordinal_position > 0")
    kc = k.t("sys.key_constraints", constraint_name="name", constraint_kind=F.when(F.rtrim("type") == "PK", "PRIMARY_KEY").otherwise("UNIQUE"), object_id="parent_object_id", index_id="unique_index_id")
    keys = k.join(k.join(k.join(k.join(kc, t, ["object_id"]), ix, ["object_id", "index_id"]), ic, ["object_id", "index_id"]), cols, ["object_id", "column_id"]).withColumn("is_validated", F.lit(True))
    fk = k.t("sys.foreign_keys", fk_id="object_id", constraint_name="name", object_id="parent_object_id", delete_rule="delete_referential_action_desc", update_rule="update_referential_action_desc",
             is_enabled=~F.col("is_disabled"), is_validated=~F.col("is_not_trusted"))
    fc = k.t("sys.foreign_key_columns", fk_id="constraint_object_id", ordinal_position="constraint_column_id", column_id="parent_column_id", ref_id="referenced_object_id", ref_column_id="referenced_column_id")
    rt = t.select(*k.by, F.col("object_id").alias("ref_id"), F.col("schema_name").alias("referenced_schema_name"), F.col("relation_name").alias("referenced_relation_name"))
    rc = cols.select(*k.by, F.col("object_id").alias("ref_id"), F.col("column_id").alias("ref_column_id"), F.col("column_name").alias("referenced_column_name"))
    fks = k.join(k.join(k.join(k.join(k.join(fk, fc, ["fk_id"]), t, ["object_id"]), cols, ["object_id", "column_id"]), rt, ["ref_id"]), rc, ["ref_id", "ref_column_id"]).withColumn("constraint_kind", F.lit("FOREIGN_KEY"))
    ck = k.t("sys.check_constraints", constraint_name="name", object_id="parent_object_id", column_id=F.nullif("parent_column_id", F.lit(0)), check_expression="definition",
             is_enabled=~F.col("is_disabled"), is_validated=~F.col("is_not_trusted"))
    cks = k.join(k.join(ck, t, ["object_id"]), cols, ["object_id", "column_id"], "left").withColumn("constraint_kind", F.lit("CHECK"))
    no = {"is_deferrable": F.lit(False), "is_initially_deferred": F.lit(False)}
    return k.out(keys.withColumns(no), CONSTRAINTS).unionByName(k.out(fks.withColumns(no), CONSTRAINTS)).unionByName(k.out(cks.withColumns(no), CONSTRAINTS))


def indexes(k):
    """C7. Partition counts are aggregated per index before they are joined."""
    i = k.t("sys.indexes", object_id="object_id", index_id="index_id", index_name="name", index_kind="type_desc", type="type", hypothetical="is_hypothetical", is_unique="is_unique", is_primary_key="is_primary_key",
            is_unique_constraint="is_unique_constraint", is_enabled=~F.col("is_disabled"), filter_expression="filter_definition", data_space_id="data_space_id").filter(F.col("type").isin(1, 2) & ~F.col("hypothetical"))
    ic = k.t("sys.index_columns", object_id="object_id", index_id="index_id", column_id="column_id", ordinal_position="index_column_id", is_included="is_included_column",
             is_partition_key=F.col("partition_ordinal") > 0, partition_ordinal=F.nullif("partition_ordinal", F.lit(0)))
    ds = k.t("sys.data_spaces", data_space_id="data_space_id", data_space_name="name")
    ps = k.t("sys.partition_schemes", data_space_id="data_space_id", ranged=F.lit(True))
    pc = k.t("sys.partitions", object_id="object_id", index_id="index_id", n="partition_number").groupBy(*k.by, "object_id", "index_id").agg(F.countDistinct("n").alias("partition_count"))
    x = k.join(k.join(k.join(i, _tables(k), ["object_id"]), ic, ["object_id", "index_id"]), _cols(k), ["object_id", "column_id"])
    x = k.join(k.join(k.join(x, ds, ["data_space_id"], "left"), ps, ["data_space_id"], "left"), pc, ["object_id", "index_id"], "left").fillna({"partition_count": 0})
    return k.out(x.withColumn("partitioning_kind", F.when(F.col("ranged"), "RANGE").otherwise("NONE")), INDEXES)


def sequences(k):
    """C8."""
    q = k.t("sys.sequences", sequence_name="name", schema_id="schema_id", user_type_id="user_type_id", numeric_precision="precision", numeric_scale="scale", start_value="start_value", increment_by="increment",
            min_value="minimum_value", max_value="maximum_value", is_cycling="is_cycling", cache_size="cache_size", observed_value="current_value").withColumn("observed_value_semantics", F.lit("CURRENT_VALUE"))
    ty = k.t("sys.types", user_type_id="user_type_id", data_type="name")
    return k.out(k.join(k.join(q, _schemas(k), ["schema_id"]), ty, ["user_type_id"]), SEQUENCES)


def name_part(name, i: int):
    """The i-th part of a dotted name from the right, brackets removed; null if left out, past the left end or beyond four parts."""
    parts = F.regexp_extract_all(F.concat(F.lit("."), name), F.lit(r"\.(\[(?:[^\]]|\]\])*\]|[^.\[\]]*)"), F.lit(1))
    part = F.get(parts, F.size(parts) - i)
    bare = F.when(part.startswith("["), F.replace(F.regexp_replace(part, r"^\[|\]$", ""), F.lit("]]"), F.lit("]"))).otherwise(part)
    return F.when(F.size(parts) <= 4, F.when(F.size(parts) >= i, F.when(bare != "", bare)))


def synonyms(k):
    """C9."""
    s = k.join(k.t("sys.synonyms", synonym_name="name", schema_id="schema_id", target_reference="base_object_name"), _schemas(k), ["schema_id"])
    n = {"target_object_name": 1, "target_schema_name": 2, "target_catalog_name": 3, "remote_locator": 4}
    return k.out(s.withColumns({a: name_part("target_reference", i) for a, i in n.items()}), SYNONYMS)


def stored_objects(k):
    """C10. Routines and triggers; a definition is hashed as UTF-16LE bytes and never emitted."""
    o = _objects(k)
    r = o.filter(F.col("type").isin(ROUTINE_CODES) & ~F.col("shipped")).drop("schema_id")
    m = k.t("sys.sql_modules", object_id="object_id", definition="definition")
    tr = k.t("sys.triggers", object_id="object_id", is_disabled="is_disabled")
    p = o.select(*k.by, F.col("object_id").alias("parent_object_id"), F.col("schema_name").alias("parent_schema_name"), F.col("object_name").alias("parent_object_name"))
    x = k.join(k.join(k.join(r, m, ["object_id"], "left"), tr, ["object_id"], "left"), p, ["parent_object_id"], "left")
    seen = F.col("definition").isNotNull()
    trig = F.col("type").isin("TR", "TA")
    x = x.withColumns({
        "object_kind": case("type", ROUTINE), "native_object_id": F.col("object_id"),
        "enablement_state": F.when(trig & F.coalesce("is_disabled", F.lit(False)), "DISABLED").when(trig, "ENABLED").otherwise("NOT_APPLICABLE"),
        "definition_visibility": F.when(seen, "VISIBLE_HASHED").otherwise("ENCRYPTED_OR_INVISIBLE"), "definition_component_ordinal": F.when(seen, 1),
        "definition_component_hash": F.sha2(F.encode("definition", "UTF-16LE"), 256), "definition_component_hash_algorithm": F.when(seen, "SHA-256/MSSQL-NVARCHAR-UTF16LE")})
    return k.out(x, "schema_name string, object_name string, object_kind string, native_object_id string, parent_schema_name string, parent_object_name string, enablement_state string, "
                    "definition_visibility string, definition_component_ordinal int, definition_component_hash string, definition_component_hash_algorithm string")


def stored_dependencies(k):
    """C11. Native references of routines; a column is proven only when the catalog names it."""
    o = _objects(k)
    src = o.filter(F.col("type").isin(ROUTINE_CODES) & ~F.col("shipped")).select(*k.by, F.col("object_id").alias("src_id"), F.col("schema_name").alias("source_schema_name"),
                                                                              F.col("object_name").alias("source_object_name"), case("type", ROUTINE).alias("source_object_kind"))
    tgt = o.select(*k.by, F.col("object_id").alias("ref_id"), F.col("schema_name").alias("t_schema"), F.col("object_name").alias("t_name"), case("type", TARGET).alias("target_object_kind"))
    tc = k.t("sys.columns", ref_id="object_id", minor="column_id", target_column_name="name")
    d = k.t("sys.sql_expression_dependencies", src_id="referencing_id", src_minor="referencing_minor_id", ref_id="referenced_id", minor="referenced_minor_id", r_schema="referenced_schema_name", r_name="referenced_entity_name",
            target_database_name="referenced_database_name", target_server_or_link_name="referenced_server_name", native_dependency_kind="referenced_class_desc",
            is_schema_bound="is_schema_bound_reference", is_caller_dependent="is_caller_dependent").filter("src_minor = 0")
    d = k.join(d, src, ["src_id"])
    refers = F.col("ref_id").isNotNull()  # the others meet no object, and would all meet in one task
    none = {n: F.lit(None).cast("string") for n in ("t_schema", "t_name", "target_object_kind", "target_column_name")}
    x = k.join(k.join(d.filter(refers), tgt, ["ref_id"], "left"), tc, ["ref_id", "minor"], "left").unionByName(d.filter(~refers).withColumns(none))
    here = F.col("ref_id").isNotNull() & F.col("target_database_name").isNull() & F.col("target_server_or_link_name").isNull()
    x = x.withColumns({
        "target_schema_name": F.coalesce("r_schema", "t_schema"), "target_object_name": F.coalesce("r_name", "t_name"),
        "column_resolution_state": F.when((F.col("minor") > 0) & F.col("target_column_name").isNotNull(), "PROVEN").otherwise("NOT_PROVEN"),
        "resolution_state": F.when(here, "RESOLVED").otherwise("UNRESOLVED")})
    return k.out(x, "source_schema_name string, source_object_name string, source_object_kind string, target_schema_name string, target_object_name string, target_object_kind string, target_column_name string, "
                    "column_resolution_state string, target_database_name string, target_server_or_link_name string, resolution_state string, native_dependency_kind string, is_schema_bound boolean, is_caller_dependent boolean")


COLLECTORS = [
    Collector("mssql.preflight.identity", "preflight", None, ("database_name",), 5, identity),
    Collector("mssql.preflight.rights", "preflight", None, ("permission_name",), 5, rights),
    Collector("mssql.structure.schemas", "schemas", "schema_name", ("schema_name",), 5, schemas),
    Collector("mssql.structure.relations", "relations", "schema_name", ("schema_name", "relation_name", "relation_kind"), 5, relations),
    Collector("mssql.structure.columns", "columns", "schema_name", ("schema_name", "relation_name", "ordinal_position", "column_name"), 5, columns),
    Collector("mssql.structure.constraints", "constraints", "schema_name", ("schema_name", "relation_name", "constraint_kind", "constraint_name", "ordinal_position", "column_name"), 5, constraints),
    Collector("mssql.structure.indexes", "indexes", "schema_name", ("schema_name", "relation_name", "index_name", "ordinal_position", "column_name"), 5, indexes),
    Collector("mssql.structure.sequences", "sequences", "schema_name", ("schema_name", "sequence_name"), 5, sequences),
    Collector("mssql.structure.synonyms", "synonyms", "schema_name", ("schema_name", "synonym_name"), 5, synonyms),
    Collector("mssql.stored.objects", "stored-objects", "schema_name", ("schema_name", "object_name", "object_kind"), 5, stored_objects),
    Collector("mssql.stored.dependencies", "stored-dependencies", "source_schema_name", ("source_schema_name", "source_object_name", "target_schema_name", "target_object_name"), 5, stored_dependencies),
]
