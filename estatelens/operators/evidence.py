"""Evidence tables: inventory, relationship list, store, review steps, bindings, counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import packed, unpacked, with_hash
from ..functions.scalars import lit_null
from ..session import measured
from .rules import ref_columns


def union_branches(*branches: DataFrame) -> DataFrame:
    """U1. UNION ALL by name; a column a branch lacks is a typed null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), branches)


def distinct_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """U2."""
    return df.select(*cols).distinct()


def inventory(categories: dict[str, DataFrame], bindings: DataFrame) -> DataFrame:
    """U3 with J14. Every object of every category, its hash, its JSON detail and its query binding.

    Each frame carries query_id and object_sha256; bindings: query_id, query_sha256, source_reference_url.
    """
    def one(cat, df):
        names = sorted(x for x in df.columns if x not in ("query_id", "object_sha256"))
        return df.select(F.upper(F.lit(cat)).alias("object_kind"), "object_sha256", *ref_columns(df, cat)[1:3], ref_columns(df, cat)[4],
                         F.to_json(F.struct(*names)).alias("detail_json"), "query_id")
    rows = reduce(DataFrame.unionByName, [one(k, d) for k, d in categories.items() if k != "preflight"])
    return bind_queries(rows, bindings)


def bind_queries(rows: DataFrame, bindings: DataFrame) -> DataFrame:
    """J14. Query hash and provenance by query id; of a doubled binding the least, so no row doubles (see ``binding_violations``)."""
    rest = [x for x in bindings.columns if x != "query_id"]
    one = bindings.groupBy("query_id").agg(F.min(F.struct(*rest)).alias("_b")).select("query_id", "_b.*")
    return rows.join(measured(one), ["query_id"], "left")


def binding_violations(rows: DataFrame, bindings: DataFrame) -> DataFrame:
    """J14 check. Query ids that are bound never or more than once."""
    b = bindings.groupBy("query_id").agg(F.count(F.lit(1)).alias("bindings"))
    used = rows.select("query_id").distinct()
    return used.join(b, "query_id", "full_outer").withColumn("bindings", F.coalesce("bindings", F.lit(0)).cast("long")).filter("bindings <> 1")


def relationship_list(constraints: DataFrame, synonyms: DataFrame, dependencies: DataFrame) -> DataFrame:
    """U4. Declared foreign keys, synonym targets and view dependencies with their authority."""
    fk = constraints.filter("constraint_kind = 'FOREIGN_KEY'").select(
        F.lit("FOREIGN_KEY").alias("relationship_kind"), F.lit("CATALOG_DECLARED").alias("relationship_authority"), F.lit(False).alias("inferred"),
        F.col("constraint_name").alias("relationship_name"), F.col("schema_name").alias("from_schema_name"), F.col("relation_name").alias("from_object_name"),
        F.col("column_name").alias("from_column_name"), F.col("referenced_schema_name").alias("to_schema_name"),
        F.col("referenced_relation_name").alias("to_object_name"), F.col("referenced_column_name").alias("to_column_name"))
    sy = synonyms.select(
        F.lit("SYNONYM_TARGET").alias("relationship_kind"), F.lit("CATALOG_DECLARED").alias("relationship_authority"), F.lit(False).alias("inferred"),
        F.col("synonym_name").alias("relationship_name"), F.col("schema_name").alias("from_schema_name"), F.col("synonym_name").alias("from_object_name"),
        lit_null().alias("from_column_name"), F.col("target_schema_name").alias("to_schema_name"),
        F.coalesce("target_object_name", "target_reference").alias("to_object_name"), lit_null().alias("to_column_name"))
    dp = dependencies.select(
        F.col("dependency_kind").alias("relationship_kind"), "relationship_authority", "inferred", lit_null().alias("relationship_name"),
        F.col("source_schema_name").alias("from_schema_name"), F.col("source_relation_name").alias("from_object_name"), lit_null().alias("from_column_name"),
        F.col("target_schema_name").alias("to_schema_name"), F.col("target_relation_name").alias("to_object_name"), lit_null().alias("to_column_name"))
    return fk.unionByName(sy).unionByName(dp)


def profile_facts(p: DataFrame) -> DataFrame:
    """Column profiles as evidence rows with their content hash as id."""
    keep = ["target_id", "row_count", "null_count", "distinct_count"]
    return with_hash(p.select(*keep), out="evidence_id", nfc=False).select(
        "evidence_id", F.lit("COLUMN_PROFILE").alias("fact_kind"), F.lit("OBSERVED").alias("observation_kind"),
        F.col("target_id").alias("source_id"), lit_null().alias("target_id"), lit_null().alias("confidence"), lit_null("long").alias("confidence_bps"))


def overlap_facts(o: DataFrame) -> DataFrame:
    """An overlap with its metrics (J3) as observation, computation and, if eligible, candidate rows."""
    obs = with_hash(o, ["source_id", "target_id", "source_non_null_count", "source_distinct_count", "target_distinct_count", "matched_distinct_count"], "_obs", nfc=False)
    cmp_ = with_hash(obs, ["_obs", "overlap_bps", "target_coverage_bps", "eligible", "confidence"], "_cmp", nfc=False)
    cand = with_hash(cmp_, ["_obs", "_cmp", "source_id", "target_id", "confidence", "overlap_bps"], "_cand", nfc=False)
    def row(idc, fact, kind, conf):
        return F.struct(F.col(idc).alias("evidence_id"), F.lit(fact).alias("fact_kind"), F.lit(kind).alias("observation_kind"),
                        (F.col("confidence") if conf else lit_null()).alias("confidence"),
                        (F.col("overlap_bps") if conf == 2 else lit_null("long")).alias("confidence_bps"))
    rows = F.array_compact(F.array(
        row("_obs", "RELATIONSHIP_OVERLAP", "OBSERVED", 0), row("_cmp", "RELATIONSHIP_SCORE", "COMPUTED", 1),
        F.when(F.col("eligible"), row("_cand", "RELATIONSHIP_CANDIDATE", "INFERRED", 2))))
    return cand.select("source_id", "target_id", F.explode(rows).alias("r")).select(
        "r.evidence_id", "r.fact_kind", "r.observation_kind", "source_id", "target_id", "r.confidence", "r.confidence_bps")


def evidence_store(profiles: DataFrame, overlaps: DataFrame) -> DataFrame:
    """U5. All evidence under one id column."""
    return profile_facts(profiles).unionByName(overlap_facts(overlaps))


def review_steps(store: DataFrame) -> DataFrame:
    """U8. One step per column profile and per relationship candidate."""
    s = store.filter(F.col("fact_kind").isin("COLUMN_PROFILE", "RELATIONSHIP_CANDIDATE")).select(
        F.when(F.col("fact_kind") == "COLUMN_PROFILE", "REVIEW_COLUMN_PROFILE").otherwise("REVIEW_RELATIONSHIP_CANDIDATE").alias("action"),
        "source_id", "target_id", "confidence", "evidence_id", F.lit("REVIEW_REQUIRED").alias("review_state"), F.lit("NONE").alias("execution_authority"))
    return with_hash(s, out="step_sha256", nfc=False)


def dangling_refs(items: DataFrame, item_id: str, refs: str, known: DataFrame, known_id: str) -> DataFrame:
    """J13. References to evidence that does not exist."""
    r = items.select(item_id, F.explode(refs).alias("evidence_ref"))
    return r.join(known.select(F.col(known_id).alias("evidence_ref")), "evidence_ref", "left_anti")


def control_binding(evidence: DataFrame, reservations: DataFrame, receipts: DataFrame) -> DataFrame:
    """J12. Evidence that does not meet exactly one reservation and one receipt of its probe, with equal state.

    evidence: evidence_id, probe_key, receipt_state; reservations: probe_key; receipts: probe_key, result_state.
    """
    r = reservations.groupBy("probe_key").agg(F.count(F.lit(1)).alias("reservation_count"))
    t = receipts.groupBy("probe_key").agg(F.count(F.lit(1)).alias("receipt_count"), F.min("result_state").alias("result_state"))
    j = evidence.join(r, "probe_key", "left").join(t, "probe_key", "left")
    n = lambda x: F.coalesce(F.col(x), F.lit(0))
    reason = (
        F.when(n("reservation_count") == 0, "RESERVATION_MISSING").when(n("reservation_count") > 1, "RESERVATION_AMBIGUOUS")
        .when(n("receipt_count") == 0, "RECEIPT_MISSING").when(n("receipt_count") > 1, "RECEIPT_AMBIGUOUS")
        .when(~F.col("result_state").eqNullSafe(F.col("receipt_state")), "STATE_MISMATCH"))
    return j.withColumn("violation", reason).filter("violation is not null").select("evidence_id", "probe_key", "violation")


def dedupe_edges(edges: DataFrame, hash_col: str = "edge_sha256") -> DataFrame:
    """U6. Edges repeat freely and count once."""
    return edges.dropDuplicates([hash_col])


def duplicate_hashes(df: DataFrame, hash_col: str) -> DataFrame:
    """U6. Elsewhere a repeated hash is an error."""
    return df.groupBy(hash_col).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def curated_candidates(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """J21. Candidates with exactly one decision, which approves; ``undecided`` reports those without exactly one."""
    one = decisions.groupBy("candidate_sha256").agg(F.count(F.lit(1)).alias("_n"), F.min("decision").alias("decision"))
    return candidates.join(one.filter("_n = 1 AND decision = 'APPROVED'").drop("_n"), "candidate_sha256")


def undecided(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """J21. Candidates without exactly one decision."""
    n = decisions.groupBy("candidate_sha256").agg(F.count(F.lit(1)).alias("decisions"))
    return candidates.select("candidate_sha256").join(n, "candidate_sha256", "left").withColumn(
        "decisions", F.coalesce("decisions", F.lit(0)).cast("long")).filter("decisions <> 1")


def candidate_counts(cands: DataFrame, col: str = "candidate_type") -> DataFrame:
    """A24."""
    return cands.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def one_row(*singles: DataFrame) -> DataFrame:
    """Columns of several one-row frames side by side, by union and max rather than a cross join."""
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), singles)
    return u.agg(*[F.max(x).alias(x) for x in u.columns])


def report_summary(profiles: DataFrame, overlaps: DataFrame) -> DataFrame:
    """A25. Counts of a profile-and-relationship run; both inputs reduce to one row before they meet."""
    p = profiles.agg(F.count(F.lit(1)).alias("profiled_columns"), F.count_if(F.col("null_count") > 0).alias("columns_with_nulls"))
    o = overlaps.agg(
        F.count(F.lit(1)).alias("evaluated_pairs"), F.count_if("eligible").alias("candidates"),
        F.count_if(F.col("confidence") == "HIGH").alias("high_confidence_candidates"), F.count_if(~F.col("eligible")).alias("low_confidence_rejected"))
    return one_row(p, o).withColumn(
        "plan_steps", F.col("profiled_columns") + F.col("candidates"))


def report_blind_spots(tables: DataFrame, max_rows: int, keys: list[str]) -> DataFrame:
    """A25. Flags per database: a bounded sample, no declared link, no KPI.

    tables: keys, sampled_rows, declared_links, kpis, one row per table.
    """
    g = tables.groupBy(*keys).agg(F.max("sampled_rows").alias("m"), F.sum("declared_links").alias("l"), F.sum("kpis").alias("k"))
    return g.select(*keys, F.array_compact(F.array(
        F.when(F.col("m") >= max_rows, "profiles-are-bounded-samples-not-full-population"),
        F.when(F.col("l") == 0, "no-declared-foreign-keys"), F.when(F.col("k") == 0, "kpi-semantics-require-user-confirmation"))).alias("blind_spots"))


def receipt_counts(receipts: DataFrame, keys: list[str] = ["result_state"]) -> DataFrame:
    """A26. Receipts per state; with other keys, probes per table, hypothesis or object."""
    return receipts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def stored_summary(objects: DataFrame, keys: list[str] = []) -> DataFrame:
    """A30."""
    def n(col, v):
        return F.count_if(F.col(col) == v)
    return objects.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("object_count"), n("object_kind", "PROCEDURE").alias("procedures"), n("object_kind", "FUNCTION").alias("functions"),
        n("object_kind", "TRIGGER").alias("triggers"), n("definition_visibility", "VISIBLE_HASHED").alias("visible_hashed"),
        n("definition_visibility", "ENCRYPTED_OR_INVISIBLE").alias("encrypted_or_invisible"))


def impact_rows(changes: DataFrame, affected: DataFrame) -> DataFrame:
    """U9. Changed stored objects and affected approved BI columns as one report table."""
    a = changes.select(F.lit("CHANGED_STORED_OBJECT").alias("record_kind"), F.lit("REVIEW_REQUIRED").alias("review_state"),
                       F.col("object_id").alias("source_object_id"), "change_type")
    b = affected.select(F.lit("AFFECTED_APPROVED_BI").alias("record_kind"), F.lit("REVIEW_REQUIRED").alias("review_state"),
                        "source_object_id", "candidate_id", "target_schema_name", "target_object_name", "target_column_name", "impact_class")
    return union_branches(a, b)


def impact_blind_spots(blind: DataFrame, changes: DataFrame) -> DataFrame:
    """U9. Lineage blind spots flagged when their source object changed."""
    ids = [x for x in ("source_object_id", "evidence_sha256") if x in blind.columns]
    ch = measured(changes.select(packed("object_id").alias("source_object_id"), F.lit(True).alias("_c")).distinct())
    flagged = blind.withColumns({x: packed(x) for x in ids}).join(ch, "source_object_id", "left").withColumn("impact_relevant", F.col("_c").isNotNull()).drop("_c")
    return flagged.withColumns({x: unpacked(x) for x in ids})
