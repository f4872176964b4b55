"""Stored-logic objects, edges, lineage and impact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import escaped, is_hash, packed, unpacked
from ..functions.scalars import int_div, lit_null
from ..session import measured

PART_BLOCK = 4096
META = ["object_kind", "native_object_id", "parent_schema_name", "parent_object_name", "enablement_state", "definition_visibility", "definition_component_hash_algorithm"]


def text_id(*cols) -> Column:
    """SHA-256 id over the named parts; null keeps a marker of its own."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(escaped(F.col(x).cast("string") if isinstance(x, str) else x.cast("string")), F.lit("\u0000null")) for x in cols]), 256)


def stored_objects(parts: DataFrame, keys: list[str] = ["schema_name", "object_name", "object_kind"]) -> DataFrame:
    """G3. One row per object: component count and definition fingerprint.

    Components fold by blocks of ordinals, then blocks fold by object, so a very long definition is hashed by many
    tasks. Encrypted or invisible objects have no fingerprint.
    """
    meta = [m for m in META if m not in keys and m in parts.columns]
    seen = F.col("definition_visibility") == "VISIBLE_HASHED"
    item = F.when(seen, F.struct(F.col("definition_component_ordinal").alias("o"), F.col("definition_component_hash").alias("h")))
    b = parts.withColumn("_b", int_div(F.coalesce("definition_component_ordinal", F.lit(0)), F.lit(PART_BLOCK))).groupBy(*keys, "_b").agg(
        F.array_sort(F.collect_list(item)).alias("_i"), F.count_if(seen).alias("_n"), *[F.max(m).alias(m) for m in meta])
    line = F.array_join(F.transform("_i", lambda x: F.concat(x["o"].cast("string"), F.lit(":"), x["h"])), ",")
    b = b.withColumn("_d", F.sha2(line, 256))
    g = b.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_b", "_d"))), lambda x: x["_d"]), ",").alias("_f"),
        F.sum("_n").cast("long").alias("definition_component_count"), *[F.max(m).alias(m) for m in meta])
    g = g.withColumn("definition_fingerprint_sha256", F.when(seen, F.sha2("_f", 256))).drop("_f")
    g = g.withColumn("object_id", text_id(*keys))
    return g.withColumn("object_sha256", text_id("object_id", "definition_fingerprint_sha256", "definition_component_count", *meta))


def metadata_conflicts(parts: DataFrame, keys: list[str] = ["schema_name", "object_name", "object_kind"]) -> DataFrame:
    """G3. Objects whose parts disagree about the object."""
    meta = [m for m in META if m not in keys and m in parts.columns]
    return parts.select(*keys, *meta).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("variants")).filter("variants > 1")


EDGE = ["source_schema_name", "source_object_name", "source_object_kind", "target_schema_name", "target_object_name", "target_object_kind"]


def _with_ids(deps: DataFrame) -> DataFrame:
    return deps.withColumn("source_object_id", text_id(*EDGE[:3])).withColumn("target_object_id", text_id(*EDGE[3:]))


def object_edges(deps: DataFrame) -> DataFrame:
    """G4. Resolved native references between objects; repeats count once."""
    d = _with_ids(deps.filter("resolution_state = 'RESOLVED'").select(*EDGE, "native_dependency_kind").distinct())  # ids follow from the names
    return d.select("source_object_id", "target_object_id", *EDGE, "native_dependency_kind").withColumn("edge_sha256", text_id(*EDGE, "native_dependency_kind"))


def column_edges(deps: DataFrame) -> DataFrame:
    """G4. Resolved references whose target column the catalog proves."""
    d = _with_ids(deps.filter("resolution_state = 'RESOLVED' and column_resolution_state = 'PROVEN'"))
    return d.select("source_object_id", "target_object_id", *EDGE, "target_column_name", "native_dependency_kind").withColumn(
        "edge_sha256", text_id(*EDGE, "target_column_name", "native_dependency_kind"))


def dependency_gaps(deps: DataFrame) -> DataFrame:
    """G4. References the catalog could not resolve."""
    d = _with_ids(deps.filter("resolution_state = 'UNRESOLVED'")).select("source_object_id", *EDGE, "native_dependency_kind")
    return d.withColumn("gap_sha256", text_id(*EDGE, "native_dependency_kind"))


def orphan_edges(deps: DataFrame, objects: DataFrame) -> DataFrame:
    """References whose source is not a known stored object."""
    o = objects.select(F.col("schema_name").alias(EDGE[0]), F.col("object_name").alias(EDGE[1]), F.col("object_kind").alias(EDGE[2]))
    return deps.join(o, EDGE[:3], "left_anti")


def lineage(edges: DataFrame, columns: DataFrame, inferred: DataFrame | None = None) -> DataFrame:
    """G5. Relationships in three classes that are never promoted into each other."""
    keep = ["source_object_id", "target_schema_name", "target_object_name", "target_object_kind"]
    def cls(df, name, gran, col):
        return df.select(F.lit(name).alias("relationship_class"), F.lit(gran).alias("granularity"), *keep, col.alias("target_column_name"), F.col("edge_sha256").alias("evidence_sha256"))
    out = cls(edges, "PROVEN_OBJECT_NATIVE", "OBJECT", lit_null()).unionByName(cls(columns, "PROVEN_COLUMN_NATIVE", "TARGET_COLUMN", F.col("target_column_name")))
    return out if inferred is None else out.unionByName(cls(inferred, "INFERRED_OBJECT_PARSER", "OBJECT", lit_null()))


def lineage_blind_spots(edges: DataFrame, columns: DataFrame, gaps: DataFrame, parser_gaps: DataFrame | None = None) -> DataFrame:
    """J17 and G5. Object edges with no column edge, unresolved references, and what text analysis could not read."""
    pair = ["source_object_id", "target_schema_name", "target_object_name", "target_object_kind"]
    known = columns.select(packed(pair[0]).alias(pair[0]), *pair[1:]).distinct()
    a = edges.select(packed(pair[0]).alias(pair[0]), *pair[1:], packed("edge_sha256").alias("edge_sha256")).join(known, pair, "left_anti").select(
        F.lit("COLUMN_RELATIONSHIP_UNKNOWN").alias("blind_spot_class"), unpacked("source_object_id").alias("source_object_id"), unpacked("edge_sha256").alias("evidence_sha256"))
    b = gaps.select(F.lit("UNKNOWN_NATIVE_RELATIONSHIP").alias("blind_spot_class"), "source_object_id", F.col("gap_sha256").alias("evidence_sha256"))
    out = a.unionByName(b)
    if parser_gaps is None:
        return out
    return out.unionByName(parser_gaps.select(
        F.when(F.col("gap_state") == "DYNAMIC_SQL_BLIND_SPOT", "DYNAMIC_RELATIONSHIP_UNKNOWN").otherwise("UNSUPPORTED_RELATIONSHIP_UNKNOWN").alias("blind_spot_class"),
        "source_object_id", F.col("gap_sha256").alias("evidence_sha256")))


def impact(changes: DataFrame, before: DataFrame, after: DataFrame, approved: DataFrame) -> DataFrame:
    """J16 and W8. Approved BI columns reached by proven edges of changed objects, best class first.

    approved: candidate_id, schema_name, relation_name, column_name. A column edge must name the column; an object
    edge touches all of the relation's columns. Each candidate keeps one impact: the column class wins, then the
    least (source, class, target) order. Best-of is a combinable aggregate, so a hot relation does not gather, and it is
    worked out and written down per snapshot, so that the shuffles of both are never held at once. An edge of both counts
    twice, which no least value minds.
    """
    ch = measured(changes.select(packed("object_id").alias("_s")).distinct())
    # per target only the best edge can win, so edges shrink to one row per target before they meet the candidates
    best = measured(_best_edges(before, ch)).unionByName(measured(_best_edges(after, ch)))
    at = ["target_schema_name", "target_object_name", "target_column_name"]
    a = approved.select("candidate_id", *[F.col(x).alias(n) for x, n in zip(("schema_name", "relation_name", "column_name"), at)])
    least = lambda n: [F.min("_h").alias(n + "h"), F.min("_t").alias(n + "t")]
    by_column, by_object = best.filter("_column").groupBy(*at).agg(*least("k")), best.filter("not _column").groupBy(*at[:2]).agg(*least("o"))
    j = a.join(by_column, at, "left").join(by_object, at[:2], "left")
    text = lambda n: F.least(F.when(F.col(n + "h").isNotNull(), F.struct(unpacked(F.col(n + "h.s")).alias("s"), unpacked(F.col(n + "h.e")).alias("e"))), F.col(n + "t"))
    j = j.filter("coalesce(kh.s, kt.s, oh.s, ot.s) is not null").withColumns({"k": text("k"), "o": text("o")})
    return j.select(
        "candidate_id", *at, F.when(F.col("k").isNotNull(), "AFFECTED_NATIVE_COLUMN").otherwise("POTENTIALLY_AFFECTED_NATIVE_OBJECT").alias("impact_class"),
        F.coalesce("k", "o")["s"].alias("source_object_id"), F.coalesce("k", "o")["e"].alias("evidence_sha256"))


def _best_edges(rel: DataFrame, ch: DataFrame) -> DataFrame:
    """Per target column of column edges, and per target of object edges, the least (source, evidence) of the changed objects ``ch``
    (packed ``_s``): ``_h`` of packed hashes, ``_t`` of edges with any other id, in their own order."""
    of_column = F.col("relationship_class") == "PROVEN_COLUMN_NATIVE"
    r = rel.filter(F.col("relationship_class").isin("PROVEN_OBJECT_NATIVE", "PROVEN_COLUMN_NATIVE")).select(
        of_column.alias("_column"), "target_schema_name", "target_object_name", F.when(of_column, F.col("target_column_name")).alias("target_column_name"),
        packed("source_object_id").alias("_s"), packed("evidence_sha256").alias("_e")).join(ch, "_s", "left_semi")
    hashed = is_hash("_s") & is_hash("_e")
    return r.groupBy("_column", "target_schema_name", "target_object_name", "target_column_name").agg(
        F.min(F.when(hashed, F.struct(F.col("_s").alias("s"), F.col("_e").alias("e")))).alias("_h"),
        F.min(F.when(~hashed, F.struct(unpacked("_s").alias("s"), unpacked("_e").alias("e")))).alias("_t"))
