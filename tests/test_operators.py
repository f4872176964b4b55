"""Small fixtures with hand-computed rows, brute-force checks and invariants."""

import math
import random

import pytest
from pyspark.sql import functions as F

from estatelens.contracts import EXTRACT_SCHEMAS
from estatelens.functions import hashing as H
from estatelens.functions import scans
from estatelens.operators import catalog, coverage, decisions, drift, evidence, graph, lineage, logs, metrics, profiling, relationships, rules, sqltext


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- profiling --------------------------------------------------------------------------------------------
def upper_median(v):
    return sorted(v)[len(v) // 2]


def rank_q(v, p):
    return sorted(v)[math.floor((len(v) - 1) * p)]


@pytest.mark.parametrize("n,rounds", [(1, 1), (2, 1), (5, 2), (97, 1), (1000, 2)])
def test_quantiles_match_brute_force(spark, n, rounds):
    rnd = random.Random(n)
    vals = [round(rnd.choice([rnd.uniform(-50, 50), 7.0]), 2) for _ in range(n)]
    hist = spark.createDataFrame([(v,) for v in vals], "v double").groupBy(F.lit("c").alias("k"), "v").agg(F.count(F.lit(1)).alias("n"))
    got = profiling.histogram_quantiles(hist, ["k"], "v", "n", {"m": "median", "q1": 0.25, "q3": 0.75}, rounds=rounds, coarse=4, fine=4).first()
    assert (got.m, got.q1, got.q3) == (upper_median(vals), rank_q(vals, 0.25), rank_q(vals, 0.75))


def test_quantiles_with_a_hot_value(spark):
    vals = [1.0] * 500 + [float(i) for i in range(2, 202)]
    hist = spark.createDataFrame([(v,) for v in vals], "v double").groupBy(F.lit("c").alias("k"), "v").agg(F.count(F.lit(1)).alias("n"))
    got = profiling.histogram_quantiles(hist, ["k"], "v", "n", {"m": "median", "q3": 0.75}).first()
    assert (got.m, got.q3) == (upper_median(vals), rank_q(vals, 0.75))


def test_profile_table_counts_nulls_and_types(spark):
    df = spark.createDataFrame([(1, "a", 2.0, True), (2, None, -0.0, None), (2, "b" * 100, 0.0, False)], "i int, s string, d double, b boolean")
    got = {r.column_name: r for r in profiling.profile_table(df).collect()}
    assert (got["i"].row_count, got["i"].null_count, got["i"].distinct_count, got["i"].minimum, got["i"].maximum) == (3, 0, 2, "1", "2")
    assert (got["s"].null_count, got["s"].distinct_count, got["s"].minimum) == (1, 2, None)
    assert got["d"].distinct_count == 2 and got["b"].type_family == "BOOLEAN" and got["b"].null_count == 1
    assert profiling.profile_violations(profiling.profile_table(df)).count() == 0


def test_empty_table_profile(spark):
    df = spark.createDataFrame([], "i int, s string")
    got = profiling.quality_metrics(profiling.profile_table(df)).collect()
    assert {r.row_count for r in got} == {0} and {r.null_rate_bps for r in got} == {0}
    assert all(not r.key_eligible and [c.reason_code for c in r.counterevidence] == ["EMPTY_BOUNDED_SCOPE"] for r in got)


def test_screened_profile_is_exact_for_keys(spark):
    df = spark.range(2000).withColumn("g", F.col("id") % 3)
    got = {r.column_name: r for r in profiling.profile_table(df, distinct="screened").collect()}
    assert got["id"].distinct_exact and got["id"].distinct_count == 2000 and not got["g"].distinct_exact


def test_anomaly_rules(spark):
    p = spark.createDataFrame([
        ("t", "serial_no", 10, 3, 5, 2, "NUMERIC", -1.0, 100.0, 5.0, 1.0, 2.0), ("t", "x", 10, 1, 9, 0, "NUMERIC", 0.0, 4.9, 2.0, 1.0, 2.0)],
        "table_name string, column_name string, sampled long, nulls long, distinct_sampled long, duplicate_sampled long, type_family string, min_value double, max_value double, median_value double, q1 double, q3 double")
    got = {(r.column_name, r.anomaly_type, r.severity) for r in profiling.anomalies(p).collect()}
    assert got == {("serial_no", "missing_values", "high"), ("serial_no", "negative_values", "high"), ("serial_no", "duplicate_values", "medium"),
                   ("serial_no", "extreme_values", "medium"), ("x", "missing_values", "medium")}


def test_bounded_scan_limit(spark):
    with pytest.raises(ValueError):
        profiling.first_rows(spark.range(5), 0)
    assert profiling.first_rows(spark.range(20_000), 15_000).count() == 15_000


# --- hashing ------------------------------------------------------------------------------------------------
def test_canonical_text_separates_null_and_empty_and_folds_forms(spark):
    df = spark.createDataFrame([("",), (None,), ("é",), ("é",), ("a\r\nb",), ("a\nb",)], "s string")
    h = [r.object_sha256 for r in H.with_hash(df).collect()]
    assert h[0] != h[1] and h[2] == h[3] and h[4] == h[5]


def test_negative_zero_and_observation_fields(spark):
    df = spark.createDataFrame([(0.0, "x"), (-0.0, "y")], "d double, observedAt string")
    assert len({r.object_sha256 for r in H.with_hash(df).collect()}) == 1


def test_digest_ignores_order_and_partitioning_but_counts_copies(spark):
    df = spark.range(1000).withColumn("k", F.lit("a")).withColumn("v", F.col("id") % 7)
    d = lambda x: H.table_digest(H.with_hash(x, ["v"]), ["k"]).first()
    a, b = d(df), d(df.repartition(7).orderBy(F.rand(1)))
    assert a == b and a.row_count == 1000
    assert d(df.unionByName(df.limit(1))).digest_sha256 != a.digest_sha256


def test_tamper(spark):
    df = H.with_hash(spark.range(5).withColumn("s", F.lit("a")), ["id", "s"])
    assert [r.id for r in H.verify_hash(df.withColumn("s", F.when(F.col("id") == 3, "b").otherwise(F.col("s"))), ["id", "s"]).collect()] == [3]


# --- scans ---------------------------------------------------------------------------------------------
def test_blocked_scans_equal_plain_windows(spark):
    from pyspark.sql import Window
    df = spark.range(500).select((F.col("id") % 2 * F.col("id") % 3).alias("k"), F.col("id").alias("s"), F.when(F.col("id") % 5 == 0, F.col("id")).alias("v"))
    w = Window.partitionBy("k").orderBy("s")
    want = df.withColumn("rn", F.row_number().over(w)).withColumn("l", F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    got = scans.blocked_row_number(df, ["k"], ["s"], F.floor(F.col("s") / 13), "rn")
    got = scans.blocked_last(got, ["k"], "s", F.floor(F.col("s") / 17), F.col("v"), "l")
    assert rows(got.select("k", "s", "rn", "l")) == rows(want.select("k", "s", F.col("rn").cast("long"), "l"))


def test_canonical_text_tells_parts_apart(spark):
    df = spark.createDataFrame([("1\x1fb=2", "3"), ("1", "2\x1fb=3"), ("\x00null", "x"), (None, "x"), ("\\", "\x1f"), ("\\\x1f", "")], "a string, b string")
    assert H.with_hash(df).select("object_sha256").distinct().count() == 6


# --- relationships ----------------------------------------------------------------------------------------------
def test_overlap_keeps_negative_evidence(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "x int")
    b = spark.createDataFrame([(3,), (3,)], "y int")
    o = relationships.overlap_metrics(relationships.relationship_overlap(a, "x", b, "y")).first()
    assert (o.source_non_null_count, o.source_distinct_count, o.target_non_null_count, o.target_distinct_count, o.matched_distinct_count) == (3, 2, 2, 1, 0)
    assert o.confidence == "LOW" and [c.reason_code for c in o.counterevidence] == ["TARGET_NOT_UNIQUE", "SOURCE_VALUES_UNMATCHED"]
    empty = relationships.overlap_metrics(relationships.relationship_overlap(a.limit(0), "x", b, "y")).first()
    assert empty.overlap_bps == 0 and [c.reason_code for c in empty.counterevidence][-1] == "SOURCE_HAS_NO_DISTINCT_VALUES"
    assert relationships.overlap_violations(relationships.relationship_overlap(a, "x", b, "y")).count() == 0


def test_candidate_pairs_skip_declared_composite_and_self(spark):
    prof = spark.createDataFrame([("s", "a", "id", "int"), ("s", "b", "id", "int"), ("s", "c", "id", "text"), ("s", "d", "id", "int")],
                                 "schema_name string, relation_name string, column_name string, native_type string")
    con = spark.createDataFrame([
        ("s", "a", "pk", "PRIMARY_KEY", "id", None, None, None), ("s", "b", "u", "UNIQUE", "id", None, None, None), ("s", "b", "u", "UNIQUE", "z", None, None, None),
        ("s", "d", "fk", "FOREIGN_KEY", "id", "s", "a", "id")],
        "schema_name string, relation_name string, constraint_name string, constraint_kind string, column_name string, referenced_schema_name string, referenced_relation_name string, referenced_column_name string")
    got = [(r.source_relation_name, r.target_relation_name) for r in relationships.candidate_pairs(prof, con).collect()]
    assert got == [("b", "a")]


# --- coverage and drift -----------------------------------------------------------------------------------------
def test_absence_needs_a_complete_visible_run(spark):
    b = spark.createDataFrame([(i, f"q{i}", "h") for i in range(5)], "object_id int, query_id string, entry_sha256 string")
    q = spark.createDataFrame([
        ("q0", "SUCCEEDED", "VISIBLE_COMPLETE", None), ("q1", "DENIED", "INVISIBLE", "NO_RIGHT"), ("q2", "UNSUPPORTED", "NOT_APPLICABLE", "NO_VIEW"), ("q3", "PARTIAL", "VISIBLE_PARTIAL", None)],
        "query_id string, state string, visibility string, reason_code string")
    got = {r.object_id: (r.classification, r.semantics, r.reason_code) for r in drift.coverage_diff(b, b.limit(0), q).collect()}
    assert got == {0: ("REMOVED", "OBSERVED_REMOVAL", None), 1: ("DENIED", "VISIBILITY_LOSS", "NO_RIGHT"), 2: ("UNSUPPORTED", "VISIBILITY_LOSS", "NO_VIEW"),
                   3: ("UNKNOWN", "VISIBILITY_LOSS", "CURRENT_VISIBILITY_UNKNOWN"), 4: ("UNKNOWN", "VISIBILITY_LOSS", "CURRENT_VISIBILITY_UNKNOWN")}


def test_empty_is_verified_only_on_success(spark):
    x = spark.createDataFrame([("s", "a", "SUCCEEDED", 0), ("s", "b", "DENIED", 0), ("s", "c", "SUCCEEDED", 3)], "snapshot_id string, query_id string, state string, row_count long")
    assert coverage.coverage_ledger(x).first().verified_empty_queries == 1


def test_drift_accounting_balances(spark):
    b = spark.range(50).select(F.lit("s").alias("s"), "id", F.lit("h").alias("object_sha256"))
    a = spark.range(20, 70).select(F.lit("s").alias("s"), "id", F.when(F.col("id") < 30, "x").otherwise("h").alias("object_sha256"))
    r = drift.drift_accounting(drift.structural_drift(b, a, ["s", "id"]), ["s"]).first()
    assert (r.added, r.removed, r.changed, r.unchanged, r.unexplained_changes, r.status) == (20, 20, 10, 20, 0, "DRIFT")


@pytest.mark.parametrize("relations,owner,want", [
    (["a", "a"], "owned", "committed_equivalent"), (["b", "b"], "owned", "unchanged_safe_to_retry"), (["a", "b"], "owned", "partial"), (["a", "z"], "owned", "diverged"), (["a", "b"], "other", "manual_review")])
def test_reconcile(spark, relations, owner, want):
    a = spark.createDataFrame([("p", str(i), "b", "a", o, None, owner) for i, o in enumerate(relations)],
                              "plan_id string, action_id string, before_hash string, after_hash string, observed_hash string, read_error_code string, owner string")
    assert drift.reconcile_plans(a).first().classification == want


# --- logs -----------------------------------------------------------------------------------------------------
def test_retention_keeps_an_old_last_known_good(spark):
    log = spark.createDataFrame([("s", i, "SUCCEEDED" if i == 1 else "FAILED") for i in range(1, 11)], "source string, seq long, outcome_state string")
    assert [r.seq for r in logs.retained(log, ["source"], 4).orderBy("seq").collect()] == [1, 8, 9, 10]


def test_chain(spark):
    base = spark.createDataFrame([("l", 1, "e1"), ("l", 2, "e2"), ("l", 3, "e3"), ("l", 5, "e5")], "l string, seq long, entry_hash string")
    log = base.withColumn("previous_hash", F.when(F.col("seq") == 1, logs.genesis(["l"])).when(F.col("seq") == 2, "e1").otherwise("wrong"))
    assert rows(logs.verify_chain(log, ["l"])) == [("l", 3, "CHAIN_BROKEN"), ("l", 5, "SEQUENCE_GAP")]


def test_hypothesis_fold(spark):
    ev = [("h", 1, "SUCCEEDED", "NO_GAIN"), ("h", 2, "SUCCEEDED", "COUNTERS"), ("h", 3, "SUCCEEDED", "COUNTERS"), ("h", 4, "SUCCEEDED", "SUPPORTS"), ("g", 1, "UNKNOWN", "UNKNOWN")]
    df = spark.createDataFrame(ev, "hypothesis_id string, seq long, result_state string, signal string")
    got = {(r.hypothesis_id, r.seq): (r.status, r.consecutive_no_gain, r.consecutive_counterevidence) for r in logs.hypothesis_ledger(df).collect()}
    assert got == {("h", 1): ("OPEN", 1, 0), ("h", 2): ("COUNTEREVIDENCE_CANDIDATE", 0, 1), ("h", 3): ("STOPPED", 0, 2), ("h", 4): ("SUPPORTED_CANDIDATE", 0, 0), ("g", 1): ("AWAITING_RECONCILIATION", 0, 0)}
    fin = {r.hypothesis_id: (r.status, r.terminal_reason, r.seq) for r in logs.hypothesis_final(logs.hypothesis_ledger(df)).collect()}
    assert fin == {"h": ("STOPPED", "REPEATED_COUNTEREVIDENCE", 3), "g": ("AWAITING_RECONCILIATION", "UNKNOWN_OUTCOME", 1)}


# --- decisions --------------------------------------------------------------------------------------------------
def greedy(cands, h_cap, t_cap, run):
    n_h, n_t, out = {}, {}, []
    for c, g, h, t in sorted(cands, key=lambda x: (-x[1], x[0])):
        if len(out) < run and n_h.get(h, 0) < h_cap and n_t.get(t, 0) < t_cap:
            out.append(c)
            n_h[h], n_t[t] = n_h.get(h, 0) + 1, n_t.get(t, 0) + 1
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_nested_budget_equals_greedy(spark, seed):
    r = random.Random(seed)
    cands = []
    for i in range(200):
        t = r.randint(0, 4)
        cands.append((f"c{i:03d}", r.randint(0, 50), f"{t}/{r.randint(0, 3)}", str(t)))
    df = spark.createDataFrame(cands, "candidate_id string, expected_gain_bps long, hypothesis_id string, table_key string")
    got = sorted(x.candidate_id for x in decisions.budgeted_selection(df, 2, 5, 17).collect())
    assert got == greedy(cands, 2, 5, 17)


@pytest.mark.parametrize("seed", [1, 2])
def test_object_cap_equals_greedy(spark, seed):
    r = random.Random(seed)
    cands = [(f"c{i:03d}", r.randint(0, 30), sorted({f"o{r.randint(0, 9)}", f"o{r.randint(0, 9)}"})) for i in range(80)]
    used, want = {}, []
    for c, g, obj in sorted(cands, key=lambda x: (-x[1], x[0])):
        if all(used.get(o, 0) < 3 for o in obj):
            want.append(c)
            for o in obj:
                used[o] = used.get(o, 0) + 1
    df = spark.createDataFrame(cands, "candidate_id string, expected_gain_bps long, objects array<string>")
    assert sorted(x.candidate_id for x in decisions.object_capped_selection(df, 3).collect()) == sorted(want)


# --- graph ------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("seed,edges", [(1, 30), (2, 60), (3, 0)])
def test_components_equal_union_find(spark, seed, edges):
    r = random.Random(seed)
    nodes = [f"n{i:02d}" for i in range(60)]
    links = [(r.choice(nodes), r.choice(nodes)) for _ in range(edges)] + [("n00", "gone")]
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        if a in parent and b in parent:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    l = spark.createDataFrame([(a, b, "PROPOSAL_ONLY") for a, b in links] + [("n01", "n59", "COUNTEREVIDENCE_ONLY")], "src string, dst string, status string")
    got = {x.node: x.component for x in graph.clusters(spark.createDataFrame([(n,) for n in nodes], "node string"), l).collect()}
    assert got == {n: find(n) for n in nodes}


def test_long_chain_converges(spark):
    n = spark.range(300).select(F.format_string("n%04d", "id").alias("node"))
    e = spark.range(299).select(F.format_string("n%04d", "id").alias("src"), F.format_string("n%04d", F.col("id") + 1).alias("dst"))
    assert graph.connected_components(n, e).select("component").distinct().count() == 1


def test_levels_cycles_and_dangling(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcdefg"], "node string")
    dep = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "e"), ("e", "d"), ("f", "d"), ("g", "zz"), ("a", "a")], "node string, needs string")
    got = {r.node: r.level for r in graph.dependency_levels(nodes, dep).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "g": 0, "d": None, "e": None, "f": None}
    assert rows(graph.dangling_needs(nodes, dep)) == [("g", "zz")] and rows(graph.self_needs(dep)) == [("a",)]


# --- text -------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("sql,want", [
    ("SELECT a FROM all_objects", "ALLOWED"), ("SELECT a FROM (SELECT b FROM all_tables) x", "ALLOWED"), ("select a from ALL_TABLES;", "ALLOWED"),
    ("SELECT a /* x /* y */ z */ FROM all_tables", "ALLOWED"), ("SELECT a /* x /* y */ FROM all_tables", "LEXICAL_INVALID"), ("SELECT 'it''s; drop' FROM all_tables", "ALLOWED"),
    ("SELECT * FROM all_tables", "WILDCARD_DENIED"), ("DELETE FROM all_tables", "SELECT_ONLY_DENIED"), ("SELECT a FROM all_tables; SELECT b FROM all_tables", "MULTI_STATEMENT_DENIED"),
    ("SELECT a INTO b FROM all_tables", "MUTATION_DENIED"), ("SELECT a FROM hr.people", "ROW_SOURCE_DENIED"), ("SELECT 1", "CATALOG_SOURCE_MISSING"), ("SELECT a FROM 'x'", "SOURCE_BOUNDARY_DENIED"),
    ("SELECT -- FROM secret\n a FROM all_tables", "ALLOWED"), ("SELECT count(*) FROM all_tables", "ALLOWED"), ("", "SQL_INVALID"), ("SELECT 'x", "LEXICAL_INVALID")])
def test_sql_audit(spark, sql, want):
    df = spark.createDataFrame([(sql, "oracle")], "s string, engine string")
    assert sqltext.audit_sql(df, "s").first().verdict == want


def test_disclosure(spark):
    df = spark.createDataFrame([("nothing here",), ("key sk-abcdefghijklmnopqrstuvwx",), ("-----BEGIN RSA PRIVATE KEY-----",), ("see postgres://u:p@h/d",), ("please select a\nfrom b",)], "t string")
    got = [r.t_flags for r in rules.disclosure_scan(df, ["t"]).collect()]
    assert got == [[], ["SECRET_VALUE"], ["SECRET_VALUE"], ["CONNECTION_STRING"], ["RAW_SQL"]]


def test_routing(spark):
    df = spark.createDataFrame([("What are the largest tables?",), ("show the scheduler",), ("show object HR.PEOPLE",), ("hello",)], "t string")
    got = [(r.family, r.mentioned_object) for r in rules.route_intent(df, "t").collect()]
    assert got == [("largest_tables", None), ("scheduler_mv_refresh", None), ("object_inventory_validity", "HR.PEOPLE"), (None, None)]


def test_contract(spark):
    spec = EXTRACT_SCHEMAS["rights"]
    df = spark.createDataFrame([("a", 1, "x")], "permission_name string, has_permission long, extra string")
    assert rules.column_contract(df, spec) == ["TYPE:has_permission", "UNEXPECTED:extra"]


# --- lineage ----------------------------------------------------------------------------------------------------
def test_column_impact_beats_object_impact(spark):
    lin = spark.createDataFrame([
        ("PROVEN_OBJECT_NATIVE", "p1", "s", "t", None, "e1"), ("PROVEN_COLUMN_NATIVE", "p2", "s", "t", "a", "e2"), ("INFERRED_OBJECT_PARSER", "p1", "s", "u", None, "e3"), ("PROVEN_OBJECT_NATIVE", "p9", "s", "w", None, "e4")],
        "relationship_class string, source_object_id string, target_schema_name string, target_object_name string, target_column_name string, evidence_sha256 string")
    ch = spark.createDataFrame([("p1",), ("p2",)], "object_id string")
    app = spark.createDataFrame([("k1", "s", "t", "a"), ("k2", "s", "t", "b"), ("k3", "s", "u", "c"), ("k4", "s", "w", "d")], "candidate_id string, schema_name string, relation_name string, column_name string")
    got = {r.candidate_id: (r.impact_class, r.source_object_id) for r in lineage.impact(ch, lin, lin.limit(0), app).collect()}
    assert got == {"k1": ("AFFECTED_NATIVE_COLUMN", "p2"), "k2": ("POTENTIALLY_AFFECTED_NATIVE_OBJECT", "p1")}


def test_definition_fingerprint_ignores_row_order(spark):
    parts = [("s", "o", "PROCEDURE", "1", "VISIBLE_HASHED", i, f"h{i}") for i in range(1, 30)]
    spec = "schema_name string, object_name string, object_kind string, native_object_id string, definition_visibility string, definition_component_ordinal int, definition_component_hash string"
    a = lineage.stored_objects(spark.createDataFrame(parts, spec)).first()
    b = lineage.stored_objects(spark.createDataFrame(parts[::-1], spec).repartition(5)).first()
    assert a.definition_fingerprint_sha256 == b.definition_fingerprint_sha256 and a.definition_component_count == 29


# --- evidence, catalog --------------------------------------------------------------------------------------------
def test_results_do_not_depend_on_partitioning(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    for op in (lambda x: profiling.profile_table(x), lambda x: profiling.sample_profile(x, ["o_totalprice", "o_orderstatus"])):
        assert rows(op(d)) == rows(op(d.repartition(7).orderBy(F.rand(3))))


def test_name_resolution(spark):
    f = spark.createDataFrame([("relations", "A", "T1"), ("relations", "B", "T1"), ("relations", "A", "T2"), ("columns", "A", "T3")], "category string, schema_name string, object_name string")
    w = spark.createDataFrame([("t1",), ("a.t1",), ("t2",), ("t3",)], "name string")
    assert {r.name: r.status for r in catalog.resolve(f, w).collect()} == {"t1": "AMBIGUOUS", "a.t1": "RESOLVED", "t2": "RESOLVED", "t3": "NOT_FOUND"}


def test_search_is_literal(spark):
    f = spark.createDataFrame([("relations", "A", "R_1", "R_1", None, None, "q", "{}"), ("relations", "A", "RX1", "RX1", None, None, "q", "{}")],
                              "category string, schema_name string, relation_name string, object_name string, object_kind string, column_name string, query_id string, detail_json string")
    assert [r.object_name for r in catalog.search(f, "r_1").collect()] == ["R_1"]


def test_metric_query_pushes_filters(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    m = metrics.metric_query(e, "value", equals={"event_type": "view"}, group_by=["user_id"], row_limit=None)
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,view)" in plan and "props" not in plan


def test_undecided_candidates(spark):
    c = spark.createDataFrame([("a",), ("b",), ("c",)], "candidate_sha256 string")
    d = spark.createDataFrame([("a", "APPROVED"), ("b", "APPROVED"), ("b", "REJECTED")], "candidate_sha256 string, decision string")
    assert rows(evidence.undecided(c, d)) == [("b", 2), ("c", 0)]
