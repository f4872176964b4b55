"""Snapshot comparison and reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import TARGET
from ..functions.scalars import c, flags, lit_null


def structural_drift(before: DataFrame, after: DataFrame, keys: list[str], hash_col: str = "object_sha256") -> DataFrame:
    """J10. One row per object key with its change class. Keys are unique per snapshot; see ``key_collisions``."""
    b = before.select(*keys, F.col(hash_col).alias("before_sha256"))
    a = after.select(*keys, F.col(hash_col).alias("after_sha256"))
    return b.join(a, keys, "full_outer").withColumn(
        "change", F.when(F.col("before_sha256").isNull(), "ADDED").when(F.col("after_sha256").isNull(), "REMOVED")
        .when(F.col("before_sha256") != F.col("after_sha256"), "CHANGED").otherwise("UNCHANGED"))


def key_collisions(snapshot: DataFrame, keys: list[str]) -> DataFrame:
    """Object keys that occur more than once in a snapshot."""
    return snapshot.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def drift_accounting(drift: DataFrame, keys: list[str]) -> DataFrame:
    """J10 totals per scope. Each side must be explained by its classes, or the run is invalid."""
    n = lambda *k: F.count_if(F.col("change").isin(*k))
    g = drift.groupBy(*keys).agg(
        n("ADDED").alias("added"), n("REMOVED").alias("removed"), n("CHANGED").alias("changed"), n("UNCHANGED").alias("unchanged"),
        F.count("before_sha256").alias("baseline_objects"), F.count("after_sha256").alias("current_objects"))
    left = F.col("baseline_objects") - (F.col("removed") + F.col("changed") + F.col("unchanged"))
    right = F.col("current_objects") - (F.col("added") + F.col("changed") + F.col("unchanged"))
    return g.withColumn("unexplained_changes", left + right).withColumn(
        "status", F.when(F.col("added") + F.col("removed") + F.col("changed") == 0, "UNCHANGED").otherwise("DRIFT"))


def disappearance(state, visibility, reason):
    """The absence rule: only a complete, visible re-run shows a removal; otherwise visibility was lost."""
    s = c(state)
    seen = (s == "SUCCEEDED") & (c(visibility) == "VISIBLE_COMPLETE")
    cls = F.when(seen, "REMOVED").when(s.isin("DENIED", "UNSUPPORTED"), s).otherwise("UNKNOWN")
    sem = F.when(seen, "OBSERVED_REMOVAL").otherwise("VISIBILITY_LOSS")
    why = F.when(seen, lit_null()).when(s.isin("DENIED", "UNSUPPORTED"), c(reason)).otherwise(F.coalesce(c(reason), F.lit("CURRENT_VISIBILITY_UNKNOWN")))
    return F.struct(cls.alias("classification"), sem.alias("semantics"), why.alias("reason_code"))


def _changed(before: DataFrame, after: DataFrame, id_col: str, hash_col: str, keep: list[str]) -> DataFrame:
    b = before.select(id_col, F.col(hash_col).alias("before_sha256"), *keep)
    a = after.select(id_col, F.col(hash_col).alias("after_sha256"))
    return b.join(a, id_col, "full_outer").filter(~F.col("before_sha256").eqNullSafe(F.col("after_sha256")))


def coverage_diff(before: DataFrame, after: DataFrame, query_coverage: DataFrame, id_col: str = "object_id", hash_col: str = "entry_sha256") -> DataFrame:
    """J11, coverage surface. An entry that vanished is classified by the current run of its own query.

    query_coverage: query_id, state, visibility, reason_code of the current snapshot.
    """
    d = _changed(before, after, id_col, hash_col, ["query_id"])
    q = query_coverage.select("query_id", F.col("state").alias("_s"), F.col("visibility").alias("_v"), F.col("reason_code").alias("_r"))
    d = d.join(q, ["query_id"], "left")
    obs = F.struct(F.when(F.col("before_sha256").isNull(), "ADDED").otherwise("CHANGED").alias("classification"),
                   F.when(F.col("before_sha256").isNull(), "CURRENT_OBSERVATION").otherwise("EVIDENCE_CHANGED").alias("semantics"), lit_null().alias("reason_code"))
    x = F.when(F.col("after_sha256").isNull(), disappearance("_s", "_v", "_r")).otherwise(obs)
    return d.select(id_col, x.alias("x"), "before_sha256", "after_sha256").select(id_col, "x.*", "before_sha256", "after_sha256")


def evidence_diff(before: DataFrame, after: DataFrame, targets: DataFrame, baseline_coverage: DataFrame, current_coverage: DataFrame, query_coverage: DataFrame,
                  id_col: str, hash_col: str) -> DataFrame:
    """J11, any other surface. Evidence is never REMOVED; what its targets lost decides the class.

    targets: id_col, target_id, one row per visibility target of an item. Coverage frames: target_id (and query_id
    for the baseline).
    Loss takes priority DENIED, UNSUPPORTED, UNKNOWN; with no loss and all targets still visible it was not re-observed.
    Targets are de-duplicated and each lost target is classified once before evidence rows meet it.
    """
    d = _changed(before, after, id_col, hash_col, []).withColumn("gone", F.col("after_sha256").isNull())
    q = query_coverage.select("query_id", F.col("state").alias("_s"), F.col("visibility").alias("_v"), F.col("reason_code").alias("_r"))
    rank = F.when(F.col("l.classification") == "DENIED", 0).when(F.col("l.classification") == "UNSUPPORTED", 1).otherwise(2)
    lost = (
        baseline_coverage.select("target_id", "query_id").join(q, ["query_id"], "left").select("target_id", disappearance("_s", "_v", "_r").alias("l"))
        .filter("l.classification <> 'REMOVED'").groupBy("target_id").agg(F.min(F.struct(rank.alias("k"), F.col("l"))).alias("loss"))
    )
    seen = current_coverage.select("target_id", F.lit(True).alias("_seen")).distinct()
    t = d.filter("gone").select(id_col).join(targets.select(id_col, "target_id").distinct(), id_col).join(lost, "target_id", "left").join(seen, "target_id", "left")
    t = t.groupBy(id_col).agg(F.min("loss").alias("loss"), F.bool_and(F.coalesce("_seen", F.lit(False))).alias("all_seen"))
    quiet = F.struct(
        F.lit("UNKNOWN").alias("classification"), F.when(F.coalesce("all_seen", F.lit(False)), "EVIDENCE_NOT_REOBSERVED").otherwise("VISIBILITY_UNKNOWN").alias("semantics"),
        F.when(F.coalesce("all_seen", F.lit(False)), "CURRENT_EVIDENCE_INCOMPLETE").otherwise("CURRENT_VISIBILITY_UNKNOWN").alias("reason_code"))
    obs = F.struct(F.when(F.col("before_sha256").isNull(), "ADDED").otherwise("CHANGED").alias("classification"),
                   F.when(F.col("before_sha256").isNull(), "CURRENT_OBSERVATION").otherwise("EVIDENCE_CHANGED").alias("semantics"), lit_null().alias("reason_code"))
    x = F.when(~F.col("gone"), obs).when(F.col("loss").isNotNull(), F.col("loss.l")).otherwise(quiet)
    return d.join(t, id_col, "left").select(id_col, x.alias("x"), "before_sha256", "after_sha256").select(id_col, "x.*", "before_sha256", "after_sha256")


SURFACES = ["coverage", "profiles", "relationships", "hypotheses", "roles", "clusters"]


def target_key(table_only: bool = False) -> Column:
    """Text that names a target (fields of contracts.TARGET); with ``table_only`` the table that holds it."""
    names = [f.name for f in TARGET.fields]
    shown = {"kind": F.lit("TABLE"), "schema_name": F.col("schema_name"), "relation_name": F.col("relation_name")} if table_only else {n: F.col(n) for n in names}
    return F.concat_ws("\u001f", *[F.coalesce(shown[n].cast("string"), F.lit("\u0000")) if n in shown else F.lit("\u0000") for n in names])


def covered_targets(entries: DataFrame) -> DataFrame:
    """(target_id, query_id) that coverage entries speak for: each entry's own target and the table that holds it, so a
    table is visible through any of its columns and loses visibility with any of them."""
    both = F.array_distinct(F.array(target_key(), target_key(table_only=True)))
    return entries.select(F.explode(both).alias("target_id"), "query_id").distinct()


def surface_diff(before: dict[str, DataFrame], after: dict[str, DataFrame], targets: DataFrame, baseline_entries: DataFrame, current_entries: DataFrame, query_coverage: DataFrame) -> DataFrame:
    """J11. All surfaces in one result: surface, id, classification, semantics, reason_code, before_sha256, after_sha256.

    before, after: surface -> (id, sha256), the coverage surface with query_id. targets: surface, id and the fields of
    contracts.TARGET, the visibility targets of the items. Coverage entries: TARGET fields and query_id. All surfaces but
    coverage go through one job; an item is its surface and id. A surface that a side lacks is empty there.
    """
    def side(frames):
        return reduce(DataFrame.unionByName, [d.select(F.struct(F.lit(s).alias("surface"), F.col("id").cast("string").alias("id")).alias("item"), "sha256") for s, d in frames.items() if s != "coverage"])

    keyed = targets.select(F.struct("surface", F.col("id").cast("string").alias("id")).alias("item"), target_key().alias("target_id"))
    rest = evidence_diff(side(before), side(after), keyed, covered_targets(baseline_entries), covered_targets(current_entries), query_coverage, "item", "sha256")
    out = rest.select("item.surface", "item.id", "classification", "semantics", "reason_code", "before_sha256", "after_sha256")
    if "coverage" in before and "coverage" in after:
        own = coverage_diff(before["coverage"], after["coverage"], query_coverage, "id", "sha256")
        out = out.unionByName(own.select(F.lit("coverage").alias("surface"), F.col("id").cast("string").alias("id"), "classification", "semantics", "reason_code", "before_sha256", "after_sha256"))
    return out


def diff_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("classification").agg(F.count(F.lit(1)).alias("n"))


def object_changes(before: DataFrame, after: DataFrame, id_col: str = "object_id", hash_col: str = "object_sha256") -> DataFrame:
    """J15. Added, removed and modified stored objects."""
    return _changed(before, after, id_col, hash_col, []).withColumn(
        "change_type", F.when(F.col("before_sha256").isNull(), "ADDED").when(F.col("after_sha256").isNull(), "REMOVED").otherwise("MODIFIED"))


def reconcile_actions(actions: DataFrame) -> DataFrame:
    """J19 per action: does the observed state match the expected one before, after, or neither?

    actions: plan_id, action_id, before_hash, after_hash, observed_hash, read_error_code, owner.
    """
    err = F.col("read_error_code").isNotNull()
    rel = (
        F.when(err & F.col("before_hash").isNull(), "before").when(err & F.col("after_hash").isNull(), "after").when(err, "missing")
        .when(F.col("observed_hash").eqNullSafe(F.col("after_hash")), "after").when(F.col("observed_hash").eqNullSafe(F.col("before_hash")), "before").otherwise("diverged"))
    return actions.withColumn("relation", rel)


def reconcile_plans(actions: DataFrame) -> DataFrame:
    """J19 per plan: committed, safe to retry, partial, diverged, or manual review when someone else committed."""
    r = reconcile_actions(actions)
    n = lambda k: F.count_if(F.col("relation") == k)
    g = r.groupBy("plan_id").agg(
        F.count(F.lit(1)).alias("actions"), n("after").alias("after_count"), n("before").alias("before_count"),
        F.count_if((F.col("relation") == "after") & (F.coalesce("owner", F.lit("owned")) != "owned")).alias("_foreign"))
    cls = (
        F.when(F.col("_foreign") > 0, "manual_review").when(F.col("after_count") == F.col("actions"), "committed_equivalent")
        .when(F.col("before_count") == F.col("actions"), "unchanged_safe_to_retry")
        .when(F.col("after_count") + F.col("before_count") == F.col("actions"), "partial").otherwise("diverged"))
    g = g.withColumn("classification", cls)
    return g.drop("_foreign").withColumn("retry_allowed", cls_is("unchanged_safe_to_retry")).withColumn(
        "compensation_allowed", cls_is("partial")).withColumn("manual_review_required", F.col("classification").isin("manual_review", "diverged"))


def cls_is(v):
    return F.col("classification") == v


def version_change(pairs: DataFrame) -> DataFrame:
    """U7. Schemas and capabilities gained and lost between two registrations, and why a review is due.

    pairs: {before,after}_{registry_version,pack_version,query_pack_version,normalizer_version,schemas,capabilities}.
    """
    d = lambda a, b, k: F.array_sort(F.array_except(f"{a}_{k}", f"{b}_{k}"))
    out = pairs.withColumns({
        "added_schemas": d("after", "before", "schemas"), "removed_schemas": d("before", "after", "schemas"),
        "added_capabilities": d("after", "before", "capabilities"), "removed_capabilities": d("before", "after", "capabilities")})
    ne = lambda k: ~F.col("before_" + k).eqNullSafe(F.col("after_" + k))
    some = lambda k: (F.size("added_" + k) > 0) | (F.size("removed_" + k) > 0)
    return out.withColumn("review_reasons", F.array_sort(flags(
        (ne("registry_version"), "REGISTRY_VERSION_CHANGE"), (some("schemas"), "SCHEMA_SCOPE_CHANGE"), (ne("pack_version"), "CAPABILITY_PACK_VERSION_CHANGE"),
        (ne("query_pack_version"), "QUERY_PACK_VERSION_CHANGE"), (ne("normalizer_version"), "NORMALIZER_VERSION_CHANGE"),
        (some("capabilities"), "CAPABILITY_ENABLEMENT_CHANGE"))))
