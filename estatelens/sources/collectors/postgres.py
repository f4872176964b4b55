"""PostgreSQL collectors over landed pg_catalog tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...session import measured
from .base import Catalog, Collector, case

# fixed values: relation kinds, constraint kinds and referential actions
KINDS = {"r": "TABLE", "p": "PARTITIONED_TABLE", "v": "VIEW", "m": "MATERIALIZED_VIEW", "f": "FOREIGN_TABLE"}
CONSTRAINT = {"p": "PRIMARY_KEY", "u": "UNIQUE", "f": "FOREIGN_KEY", "c": "CHECK"}
ACTION = {"a": "NO_ACTION", "r": "RESTRICT", "c": "CASCADE", "n": "SET_NULL", "d": "SET_DEFAULT"}


def _namespaces(k: Catalog):
    return k.t("pg_namespace", ns="oid", schema_name="nspname")


def _relations(k: Catalog):
    r = k.t("pg_class", rel="oid", relation_name="relname", ns="relnamespace", relkind="relkind", persistence="relpersistence", row_security_enabled="relrowsecurity", is_partition="relispartition")
    return k.join(r, _namespaces(k), ["ns"]).drop("ns")


def identity(k):
    """C36."""
    s = k.t("pg_settings", name="name", engine_version="setting").filter("name = 'server_version'")
    return k.out(k.beside(s, k.t("server", database_name="database_name")).withColumn("engine", F.lit("postgresql")),
                 "engine string, engine_version string, database_name string, container_name string")


def schemas(k):
    """C37."""
    n = k.t("pg_namespace", schema_name="nspname", native_schema_oid="oid", owner="nspowner")
    return k.out(k.join(n, k.t("pg_roles", owner="oid", owner_name="rolname"), ["owner"]), "schema_name string, native_schema_oid bigint, owner_name string")


def relations(k):
    """C38."""
    r = _relations(k).filter(F.col("relkind").isin(list(KINDS))).withColumns({"relation_kind": case("relkind", KINDS), "native_relation_oid": F.col("rel")})
    return k.out(r, "schema_name string, relation_name string, relation_kind string, native_relation_oid bigint, persistence string, row_security_enabled boolean, is_partition boolean")


def columns(k):
    """C39. System and dropped attributes are left out."""
    a = k.t("pg_attribute", rel="attrelid", column_name="attname", ordinal_position="attnum", type="atttypid", is_nullable=~F.col("attnotnull"), has_default="atthasdef", identity_kind="attidentity",
            generated_kind="attgenerated", dropped="attisdropped").filter("ordinal_position > 0 and not dropped")
    ty = k.join(k.t("pg_type", type="oid", data_type="typname", ns="typnamespace"), _namespaces(k), ["ns"]).withColumnRenamed("schema_name", "type_schema_name").drop("ns")
    ty = measured(ty)  # few rows as a rule: columns need not be dealt by their type
    r = _relations(k).filter(F.col("relkind").isin(list(KINDS))).withColumn("relation_kind", case("relkind", KINDS))
    x = k.join(k.join(a, r, ["rel"]), ty, ["type"]).withColumn("native_type_oid", F.col("type"))
    return k.out(x, "schema_name string, relation_name string, relation_kind string, column_name string, ordinal_position bigint, type_schema_name string, data_type string, native_type_oid bigint, "
                    "is_nullable boolean, has_default boolean, identity_kind string, generated_kind string")


def constraints(k):
    """C40. Both key arrays are exploded with their positions and meet on position; a check keeps its columns, or none."""
    base = k.t("pg_constraint", con="oid", constraint_name="conname", contype="contype", rel="conrelid", conkey="conkey", confrel="confrelid", confkey="confkey", deltype="confdeltype", updtype="confupdtype",
               is_validated="convalidated", is_deferrable="condeferrable", is_initially_deferred="condeferred").filter(F.col("contype").isin(list(CONSTRAINT)))
    base = k.join(base, _relations(k).select(*k.by, "rel", "schema_name", "relation_name"), ["rel"])
    att = k.t("pg_attribute", rel="attrelid", attnum="attnum", column_name="attname")
    src = base.select(*k.by, "con", "rel", F.posexplode("conkey").alias("pos", "attnum"))
    src = k.join(src, att, ["rel", "attnum"]).select(*k.by, "con", "pos", "column_name")
    ratt = k.t("pg_attribute", confrel="attrelid", attnum="attnum", referenced_column_name="attname")
    ref = base.filter("contype = 'f'").select(*k.by, "con", "confrel", F.posexplode("confkey").alias("pos", "attnum"))
    ref = k.join(ref, ratt, ["confrel", "attnum"]).select(*k.by, "con", "pos", "referenced_column_name")
    rrel = _relations(k).select(*k.by, F.col("rel").alias("confrel"), F.col("schema_name").alias("referenced_schema_name"), F.col("relation_name").alias("referenced_relation_name"))
    x = k.join(base.drop("conkey", "confkey"), src, ["con"], "left").filter("contype = 'c' or column_name is not null")
    x = k.join(k.join(x, rrel, ["confrel"], "left"), ref, ["con", "pos"], "left")
    chk = F.col("contype") == "c"
    x = x.withColumns({
        "constraint_kind": case("contype", CONSTRAINT), "ordinal_position": F.col("pos") + 1, "definition_disclosure": F.lit("OMITTED_NO_RAW_DEFINITION"), "is_enabled": F.lit(True),
        "delete_rule": F.when(~chk, case("deltype", ACTION)), "update_rule": F.when(~chk, case("updtype", ACTION)),
        "referenced_schema_name": F.when(~chk, F.col("referenced_schema_name")), "referenced_relation_name": F.when(~chk, F.col("referenced_relation_name"))})
    return k.out(x, "schema_name string, relation_name string, constraint_name string, constraint_kind string, column_name string, ordinal_position int, referenced_schema_name string, referenced_relation_name string, "
                    "referenced_column_name string, definition_disclosure string, delete_rule string, update_rule string, is_enabled boolean, is_validated boolean, is_deferrable boolean, is_initially_deferred boolean")


def dependencies(k):
    """C41. What views read, by their rewrite rules; a view's edge to itself is dropped."""
    rw = k.t("pg_rewrite", rule="oid", src="ev_class")
    dp = k.t("pg_depend", rule="objid", cls="classid", refcls="refclassid", tgt="refobjid", deptype="deptype").filter("cls = 'pg_rewrite' and refcls = 'pg_class' and deptype = 'n'")
    r = _relations(k)
    s = r.filter(F.col("relkind").isin("v", "m")).select(*k.by, F.col("rel").alias("src"), F.col("schema_name").alias("source_schema_name"), F.col("relation_name").alias("source_relation_name"), case("relkind", KINDS).alias("source_relation_kind"))
    t = r.filter(F.col("relkind").isin(list(KINDS))).select(*k.by, F.col("rel").alias("tgt"), F.col("schema_name").alias("target_schema_name"), F.col("relation_name").alias("target_relation_name"), case("relkind", KINDS).alias("target_relation_kind"))
    x = k.join(k.join(k.join(rw, dp, ["rule"]).filter("src <> tgt"), s, ["src"]), t, ["tgt"])
    x = x.withColumns({"dependency_kind": F.lit("PG_DEPEND_REWRITE_NORMAL"), "relationship_authority": F.lit("CATALOG_DECLARED"), "inferred": F.lit(False)})
    return k.out(x, "source_schema_name string, source_relation_name string, source_relation_kind string, target_schema_name string, target_relation_name string, target_relation_kind string, dependency_kind string, "
                    "relationship_authority string, inferred boolean")


COLLECTORS = [
    Collector("postgresql.preflight.identity", "preflight", None, ("engine", "database_name"), 5, identity),
    Collector("postgresql.structure.schemas", "schemas", "schema_name", ("schema_name",), 5, schemas),
    Collector("postgresql.structure.relations", "relations", "schema_name", ("schema_name", "relation_name", "relation_kind"), 5, relations),
    Collector("postgresql.structure.columns", "columns", "schema_name", ("schema_name", "relation_name", "ordinal_position", "column_name"), 5, columns),
    Collector("postgresql.structure.constraints", "constraints", "schema_name", ("schema_name", "relation_name", "constraint_kind", "constraint_name", "ordinal_position", "column_name"), 5, constraints),
    Collector("postgresql.structure.dependencies", "dependencies", "source_schema_name", ("source_schema_name", "source_relation_name", "target_schema_name", "target_relation_name"), 5, dependencies),
]
# fixed values: what this pack declares it cannot see
BLIND_SPOTS = [
    ("CHECK_DEFINITION_CONTENT_OMITTED", "Check constraint presence, columns and validation state are retained; definition text and literal content are not persisted."),
    ("RELATION_DEPENDENCIES_ONLY", "Dependency evidence is limited to catalog-declared view and materialized-view relation dependencies in scoped schemas."),
    ("NO_SEMANTIC_OR_INFERRED_RELATIONSHIPS", "Business semantics, candidate foreign keys and relationships inferred from names or values are outside this pack."),
]
