"""Drift, logs, lineage, graph and reconciliation bound to the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scans import blocked_row_number
from ..operators import drift as D
from ..operators import evidence as E
from ..operators import graph as G
from ..operators import lineage as N
from ..operators import logs as L
from ..session import measured
from .base import Registry, load, stringify
from .estate import ctes, estate, portable

R = Registry()

# --- two snapshots of orders ----------------------------------------------------------------------------
SNAP = {
    "s_before": """SELECT o_custkey, o_orderkey, 'q.' || o_orderstatus AS query_id, sha2(CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS STRING), 256) AS object_sha256
       FROM {orders} WHERE o_orderpriority <> '5-LOW'""",
    "s_after": """SELECT o_custkey, o_orderkey, 'q.' || o_orderstatus AS query_id,
       sha2(CAST(CAST(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice + 1 ELSE o_totalprice END AS DECIMAL(18, 2)) AS STRING), 256) AS object_sha256
       FROM {orders} WHERE o_orderpriority <> '2-HIGH' AND o_orderpriority <> '3-MEDIUM'""",
    "s_queries": """SELECT 'q.' || o_orderstatus AS query_id, CASE o_orderstatus WHEN 'F' THEN 'SUCCEEDED' WHEN 'O' THEN 'DENIED' ELSE 'TIMEOUT' END AS state,
       CASE o_orderstatus WHEN 'F' THEN 'VISIBLE_COMPLETE' WHEN 'O' THEN 'INVISIBLE' ELSE 'UNKNOWN' END AS visibility,
       CASE o_orderstatus WHEN 'O' THEN 'ACCESS_DENIED' END AS reason_code FROM {orders} GROUP BY o_orderstatus""",
}
_SC = ctes("s_before", "s_after", "s_queries", texts=SNAP)
_DRIFT = """(SELECT coalesce(b.o_custkey, a.o_custkey) AS o_custkey, coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, b.object_sha256 AS before_sha256, a.object_sha256 AS after_sha256,
   CASE WHEN b.object_sha256 IS NULL THEN 'ADDED' WHEN a.object_sha256 IS NULL THEN 'REMOVED' WHEN a.object_sha256 <> b.object_sha256 THEN 'CHANGED' ELSE 'UNCHANGED' END AS change
   FROM s_before b FULL JOIN s_after a ON a.o_orderkey = b.o_orderkey)"""


def _snap(spark, sf, *names):
    return [portable(spark, sf, SNAP[n]) for n in names]


@R.add("structural_drift", _SC + "SELECT * FROM " + _DRIFT)
def structural_drift(spark, sf):
    b, a = _snap(spark, sf, "s_before", "s_after")
    return D.structural_drift(b, a, ["o_custkey", "o_orderkey"])


@R.add("drift_accounting", _SC + f"""SELECT *, 0::BIGINT AS unexplained_changes, CASE WHEN added + removed + changed = 0 THEN 'UNCHANGED' ELSE 'DRIFT' END AS status FROM (SELECT o_custkey,
   count(*) FILTER (WHERE change = 'ADDED') AS added, count(*) FILTER (WHERE change = 'REMOVED') AS removed, count(*) FILTER (WHERE change = 'CHANGED') AS changed,
   count(*) FILTER (WHERE change = 'UNCHANGED') AS unchanged, count(before_sha256) AS baseline_objects, count(after_sha256) AS current_objects FROM {_DRIFT} GROUP BY 1)""")
def drift_accounting(spark, sf):
    b, a = _snap(spark, sf, "s_before", "s_after")
    return D.drift_accounting(D.structural_drift(b, a, ["o_custkey", "o_orderkey"]), ["o_custkey"])


@R.add("key_collisions", "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def key_collisions(spark, sf):
    return D.key_collisions(load(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


_CLS = """CASE WHEN a.h IS NOT NULL AND b.h IS NULL THEN 'ADDED' WHEN a.h IS NOT NULL THEN 'CHANGED' WHEN state = 'SUCCEEDED' AND visibility = 'VISIBLE_COMPLETE' THEN 'REMOVED'
   WHEN state IN ('DENIED', 'UNSUPPORTED') THEN state ELSE 'UNKNOWN' END AS classification,
   CASE WHEN a.h IS NOT NULL AND b.h IS NULL THEN 'CURRENT_OBSERVATION' WHEN a.h IS NOT NULL THEN 'EVIDENCE_CHANGED' WHEN state = 'SUCCEEDED' AND visibility = 'VISIBLE_COMPLETE' THEN 'OBSERVED_REMOVAL'
   ELSE 'VISIBILITY_LOSS' END AS semantics,
   CASE WHEN a.h IS NOT NULL OR state = 'SUCCEEDED' THEN NULL WHEN state IN ('DENIED', 'UNSUPPORTED') THEN reason_code ELSE coalesce(reason_code, 'CURRENT_VISIBILITY_UNKNOWN') END AS reason_code"""


@R.add("coverage_diff", _SC + f"""SELECT coalesce(b.o_orderkey, a.o_orderkey) AS object_id, {_CLS}, b.h AS before_sha256, a.h AS after_sha256
   FROM (SELECT o_orderkey, query_id, object_sha256 AS h FROM s_before) b FULL JOIN (SELECT o_orderkey, object_sha256 AS h FROM s_after) a ON a.o_orderkey = b.o_orderkey
   LEFT JOIN s_queries q ON q.query_id = b.query_id WHERE a.h IS DISTINCT FROM b.h""")
def coverage_diff(spark, sf):
    b, a, q = _snap(spark, sf, "s_before", "s_after", "s_queries")
    ren = lambda d: d.withColumnRenamed("o_orderkey", "object_id").withColumnRenamed("object_sha256", "entry_sha256")
    return D.coverage_diff(ren(b), ren(a), q)


EVID = {  # evidence of a customer rests on its orders: a customer is a cluster, its orders are the visibility targets
    "v_before": """SELECT o_custkey AS item_id, sha2(CAST(SUM(CAST(o_totalprice AS DECIMAL(18, 2))) AS STRING), 256) AS item_sha256 FROM {orders} WHERE o_orderpriority <> '5-LOW' GROUP BY o_custkey""",
    "v_after": """SELECT o_custkey AS item_id, sha2(CAST(SUM(CAST(o_totalprice AS DECIMAL(18, 2))) AS STRING), 256) AS item_sha256 FROM {orders}
       WHERE o_orderpriority <> '5-LOW' GROUP BY o_custkey HAVING MAX(o_totalprice) < 400000 AND MIN(o_totalprice) > 30000""",
    "v_targets": "SELECT o_custkey AS item_id, o_orderkey AS target_id, 'q.' || o_orderstatus AS query_id FROM {orders} WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 150000",
    "v_current": "SELECT o_orderkey AS target_id FROM {orders} WHERE o_orderstatus = 'F' AND o_totalprice > 155000",
}


@R.add("evidence_diff", _SC + ", " + ctes(*EVID, texts=EVID)[5:] + f""", l AS (SELECT item_id, bool_or(q.state = 'DENIED') AS denied, bool_or(q.state = 'TIMEOUT') AS timeout,
    bool_and(c.target_id IS NOT NULL) AS all_seen, count(*) AS n FROM v_targets t LEFT JOIN s_queries q USING (query_id) LEFT JOIN v_current c USING (target_id) GROUP BY 1)
  SELECT coalesce(b.item_id, a.item_id) AS item_id, CASE WHEN a.item_sha256 IS NOT NULL AND b.item_sha256 IS NULL THEN 'ADDED' WHEN a.item_sha256 IS NOT NULL THEN 'CHANGED' WHEN denied THEN 'DENIED' ELSE 'UNKNOWN' END AS classification,
   CASE WHEN a.item_sha256 IS NOT NULL AND b.item_sha256 IS NULL THEN 'CURRENT_OBSERVATION' WHEN a.item_sha256 IS NOT NULL THEN 'EVIDENCE_CHANGED' WHEN denied OR timeout THEN 'VISIBILITY_LOSS'
    WHEN all_seen THEN 'EVIDENCE_NOT_REOBSERVED' ELSE 'VISIBILITY_UNKNOWN' END AS semantics,
   CASE WHEN a.item_sha256 IS NOT NULL THEN NULL WHEN denied THEN 'ACCESS_DENIED' WHEN timeout THEN 'CURRENT_VISIBILITY_UNKNOWN' WHEN all_seen THEN 'CURRENT_EVIDENCE_INCOMPLETE' ELSE 'CURRENT_VISIBILITY_UNKNOWN' END AS reason_code,
   b.item_sha256 AS before_sha256, a.item_sha256 AS after_sha256 FROM v_before b FULL JOIN v_after a ON a.item_id = b.item_id LEFT JOIN l ON l.item_id = b.item_id WHERE a.item_sha256 IS DISTINCT FROM b.item_sha256""")
def evidence_diff(spark, sf):
    b, a, t, cur = [portable(spark, sf, x) for x in EVID.values()]
    q = portable(spark, sf, SNAP["s_queries"])
    return D.evidence_diff(b, a, t, t, cur, q, "item_id", "item_sha256")


SURF = {  # customers are tables, their orders columns; items rest on tables or on single columns
    "f_before": """SELECT CASE o_custkey % 5 WHEN 0 THEN 'profiles' WHEN 1 THEN 'relationships' WHEN 2 THEN 'hypotheses' WHEN 3 THEN 'roles' ELSE 'clusters' END AS surface, CAST(o_custkey AS STRING) AS id,
       sha2(CAST(SUM(CAST(o_totalprice AS DECIMAL(18, 2))) AS STRING), 256) AS sha256 FROM {orders} WHERE o_orderpriority <> '5-LOW' GROUP BY o_custkey""",
    "f_after": """SELECT CASE o_custkey % 5 WHEN 0 THEN 'profiles' WHEN 1 THEN 'relationships' WHEN 2 THEN 'hypotheses' WHEN 3 THEN 'roles' ELSE 'clusters' END AS surface, CAST(o_custkey AS STRING) AS id,
       sha2(CAST(SUM(CAST(o_totalprice AS DECIMAL(18, 2))) AS STRING), 256) AS sha256 FROM {orders} WHERE o_orderpriority <> '5-LOW' GROUP BY o_custkey HAVING MAX(o_totalprice) < 400000 AND MIN(o_totalprice) > 30000""",
    "f_targets": """SELECT DISTINCT CASE o_custkey % 5 WHEN 0 THEN 'profiles' WHEN 1 THEN 'relationships' WHEN 2 THEN 'hypotheses' WHEN 3 THEN 'roles' ELSE 'clusters' END AS surface, CAST(o_custkey AS STRING) AS id,
       CASE WHEN o_custkey % 2 = 0 THEN 'TABLE' ELSE 'COLUMN' END AS kind, 'T_' || CAST(o_custkey AS STRING) AS relation_name,
       CASE WHEN o_custkey % 2 = 1 THEN 'C_' || CAST(o_orderkey AS STRING) END AS column_name FROM {orders} WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 100000""",
    "f_base": """SELECT 'T_' || CAST(o_custkey AS STRING) AS relation_name, 'C_' || CAST(o_orderkey AS STRING) AS column_name, 'q.' || o_orderstatus AS query_id FROM {orders} WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 150000""",
    "f_now": """SELECT 'T_' || CAST(o_custkey AS STRING) AS relation_name, 'C_' || CAST(o_orderkey AS STRING) AS column_name, 'q.' || o_orderstatus AS query_id FROM {orders} WHERE o_orderstatus = 'F' AND o_totalprice > 155000""",
}


@R.add("surface_diff", _SC + ", " + ctes(*SURF, texts=SURF)[5:] + f""", l AS (SELECT surface, id, bool_or(lost_d) AS denied, bool_or(lost_t) AS timeout, bool_and(seen) AS all_seen FROM (
    SELECT surface, id, EXISTS (SELECT 1 FROM f_base b JOIN s_queries q USING (query_id) WHERE b.relation_name = t.relation_name AND (t.kind = 'TABLE' OR b.column_name = t.column_name) AND q.state = 'DENIED') AS lost_d,
      EXISTS (SELECT 1 FROM f_base b JOIN s_queries q USING (query_id) WHERE b.relation_name = t.relation_name AND (t.kind = 'TABLE' OR b.column_name = t.column_name) AND q.state = 'TIMEOUT') AS lost_t,
      EXISTS (SELECT 1 FROM f_now n WHERE n.relation_name = t.relation_name AND (t.kind = 'TABLE' OR n.column_name = t.column_name)) AS seen FROM f_targets t) GROUP BY ALL)
  SELECT coalesce(b.surface, a.surface) AS surface, coalesce(b.id, a.id) AS id, CASE WHEN a.sha256 IS NOT NULL AND b.sha256 IS NULL THEN 'ADDED' WHEN a.sha256 IS NOT NULL THEN 'CHANGED' WHEN denied THEN 'DENIED' ELSE 'UNKNOWN' END AS classification,
   CASE WHEN a.sha256 IS NOT NULL AND b.sha256 IS NULL THEN 'CURRENT_OBSERVATION' WHEN a.sha256 IS NOT NULL THEN 'EVIDENCE_CHANGED' WHEN denied OR timeout THEN 'VISIBILITY_LOSS' WHEN all_seen THEN 'EVIDENCE_NOT_REOBSERVED' ELSE 'VISIBILITY_UNKNOWN' END AS semantics,
   CASE WHEN a.sha256 IS NOT NULL THEN NULL WHEN denied THEN 'ACCESS_DENIED' WHEN timeout THEN 'CURRENT_VISIBILITY_UNKNOWN' WHEN all_seen THEN 'CURRENT_EVIDENCE_INCOMPLETE' ELSE 'CURRENT_VISIBILITY_UNKNOWN' END AS reason_code,
   b.sha256 AS before_sha256, a.sha256 AS after_sha256 FROM f_before b FULL JOIN f_after a USING (surface, id) LEFT JOIN l ON l.surface = b.surface AND l.id = b.id WHERE a.sha256 IS DISTINCT FROM b.sha256
  UNION ALL SELECT 'coverage', CAST(coalesce(b.o_orderkey, a.o_orderkey) AS VARCHAR), {_CLS}, b.h, a.h
   FROM (SELECT o_orderkey, query_id, object_sha256 AS h FROM s_before) b FULL JOIN (SELECT o_orderkey, object_sha256 AS h FROM s_after) a ON a.o_orderkey = b.o_orderkey
   LEFT JOIN s_queries q ON q.query_id = b.query_id WHERE a.h IS DISTINCT FROM b.h""")
def surface_diff(spark, sf):
    """Six surfaces at once; a table stays visible through any of its columns."""
    b, a, t, base, now = [portable(spark, sf, x) for x in SURF.values()]
    sb, sa, q = _snap(spark, sf, "s_before", "s_after", "s_queries")
    ren = lambda d: d.withColumnRenamed("o_orderkey", "id").withColumnRenamed("object_sha256", "sha256")
    full = lambda d, kind: d.withColumns({x: F.lit(None).cast("string") for x in ("dst_schema_name", "dst_relation_name", "dst_column_name")} | {"schema_name": F.lit("S")} | ({"kind": F.lit(kind)} if kind else {}))
    split = lambda d: {s: d.where(F.col("surface") == s) for s in D.SURFACES[1:]}
    return D.surface_diff(split(b) | {"coverage": ren(sb)}, split(a) | {"coverage": ren(sa)}, full(t, None), full(base, "COLUMN"), full(now, "COLUMN"), q)


@R.add("diff_counts", _SC + f"SELECT classification, count(*) AS n FROM (SELECT {_CLS} FROM (SELECT o_orderkey, query_id, object_sha256 AS h FROM s_before) b FULL JOIN (SELECT o_orderkey, object_sha256 AS h FROM s_after) a ON a.o_orderkey = b.o_orderkey "
       "LEFT JOIN s_queries q ON q.query_id = b.query_id WHERE a.h IS DISTINCT FROM b.h) GROUP BY 1")
def diff_counts(spark, sf):
    return D.diff_counts(coverage_diff(spark, sf))


TRIPLE = """SELECT l_orderkey AS plan_id, CAST(l_partkey AS STRING) || '/' || CAST(l_suppkey AS STRING) || '/' || CAST(l_linenumber AS STRING) AS action_id,
   CASE WHEN l_linenumber > 1 THEN 'b' END AS before_hash, CASE WHEN l_linenumber < 7 THEN 'a' END AS after_hash,
   CASE WHEN l_discount >= 0.1 THEN 'x' WHEN l_orderkey % 3 = 0 AND l_linenumber < 7 THEN 'a' WHEN l_orderkey % 3 = 1 AND l_linenumber > 1 THEN 'b' WHEN l_returnflag = 'A' THEN 'a' WHEN l_returnflag = 'N' THEN 'b' END AS observed_hash,
   CASE WHEN l_tax = 0.08 AND l_returnflag = 'R' THEN 'HTTP_404' END AS read_error_code, CASE WHEN l_quantity = 1 THEN 'foreign' ELSE 'owned' END AS owner FROM {lineitem}"""
_TR = "WITH t AS (" + TRIPLE.format(lineitem="lineitem") + """), r AS (SELECT *, CASE WHEN read_error_code IS NOT NULL AND before_hash IS NULL THEN 'before' WHEN read_error_code IS NOT NULL AND after_hash IS NULL THEN 'after'
   WHEN read_error_code IS NOT NULL THEN 'missing' WHEN observed_hash IS NOT DISTINCT FROM after_hash THEN 'after' WHEN observed_hash IS NOT DISTINCT FROM before_hash THEN 'before' ELSE 'diverged' END AS relation FROM t)"""


@R.add("reconcile_actions", _TR + " SELECT plan_id, action_id, relation FROM r")
def reconcile_actions(spark, sf):
    return D.reconcile_actions(portable(spark, sf, TRIPLE)).select("plan_id", "action_id", "relation")


@R.add("reconcile_plans", _TR + """ SELECT *, classification = 'unchanged_safe_to_retry' AS retry_allowed, classification = 'partial' AS compensation_allowed, classification IN ('manual_review', 'diverged') AS manual_review_required FROM (
   SELECT plan_id, count(*) AS actions, count(*) FILTER (WHERE relation = 'after') AS after_count, count(*) FILTER (WHERE relation = 'before') AS before_count,
   CASE WHEN bool_or(relation = 'after' AND owner <> 'owned') THEN 'manual_review' WHEN bool_and(relation = 'after') THEN 'committed_equivalent' WHEN bool_and(relation = 'before') THEN 'unchanged_safe_to_retry'
    WHEN bool_and(relation IN ('before', 'after')) THEN 'partial' ELSE 'diverged' END AS classification FROM r GROUP BY 1)""")
def reconcile_plans(spark, sf):
    return D.reconcile_plans(portable(spark, sf, TRIPLE))


@R.add("version_change", """WITH g AS (SELECT l_partkey, list_sort(list_distinct(list('S' || l_linenumber) FILTER (WHERE l_linestatus = 'F'))) AS bs, list_sort(list_distinct(list('S' || l_linenumber) FILTER (WHERE l_linestatus = 'O'))) AS xs,
     coalesce(list_distinct(list(l_returnflag) FILTER (WHERE l_discount < 0.04)), []) AS bc, coalesce(list_distinct(list(l_returnflag) FILTER (WHERE l_discount >= 0.04)), []) AS xc,
     max(l_tax) < 0.08 AS rv, min(l_tax) > 0 AS pv FROM lineitem GROUP BY 1),
   d AS (SELECT l_partkey, rv, pv, list_sort(list_filter(coalesce(xs, []), lambda v: NOT list_contains(coalesce(bs, []), v))) AS s1, list_sort(list_filter(coalesce(bs, []), lambda v: NOT list_contains(coalesce(xs, []), v))) AS s2,
     list_sort(list_filter(xc, lambda v: NOT list_contains(bc, v))) AS c1, list_sort(list_filter(bc, lambda v: NOT list_contains(xc, v))) AS c2 FROM g)
   SELECT l_partkey, array_to_string(s1, ',') AS added_schemas, array_to_string(s2, ',') AS removed_schemas, array_to_string(c1, ',') AS added_capabilities, array_to_string(c2, ',') AS removed_capabilities,
     concat_ws(',', CASE WHEN len(c1) + len(c2) > 0 THEN 'CAPABILITY_ENABLEMENT_CHANGE' END, CASE WHEN pv THEN 'CAPABILITY_PACK_VERSION_CHANGE' END, CASE WHEN rv THEN 'REGISTRY_VERSION_CHANGE' END, CASE WHEN len(s1) + len(s2) > 0 THEN 'SCHEMA_SCOPE_CHANGE' END) AS review_reasons FROM d""")
def version_change(spark, sf):
    l = load(spark, sf, "lineitem")
    sch = F.expr("'S' || l_linenumber")
    p = l.groupBy("l_partkey").agg(
        F.collect_set(F.when(F.col("l_linestatus") == "F", sch)).alias("before_schemas"), F.collect_set(F.when(F.col("l_linestatus") == "O", sch)).alias("after_schemas"),
        F.collect_set(F.when(F.col("l_discount") < 0.04, F.col("l_returnflag"))).alias("before_capabilities"),
        F.collect_set(F.when(F.col("l_discount") >= 0.04, F.col("l_returnflag"))).alias("after_capabilities"),
        (F.max("l_tax") < 0.08).cast("string").alias("after_registry_version"), (F.min("l_tax") > 0).cast("string").alias("after_pack_version"))
    for k, v in (("registry_version", "false"), ("pack_version", "false"), ("query_pack_version", "1"), ("normalizer_version", "1")):
        p = p.withColumn("before_" + k, F.lit(v))
    p = p.withColumn("after_query_pack_version", F.lit("1")).withColumn("after_normalizer_version", F.lit("1"))
    cols = ["added_schemas", "removed_schemas", "added_capabilities", "removed_capabilities", "review_reasons"]
    return stringify(D.version_change(p).select("l_partkey", *cols), *cols)


# --- logs: one log per user, numbered in (ts, event_id) order ---------------------------------------------
def event_log(spark, sf):
    e = load(spark, sf, "events")
    return blocked_row_number(e, ["user_id"], ["ts", "event_id"], F.date_trunc("day", F.col("ts")))


_LOG = "WITH lg AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)"


@R.add("log_numbering", _LOG + " SELECT user_id, event_id, seq FROM lg")
def log_numbering(spark, sf):
    return event_log(spark, sf).select("user_id", "event_id", "seq")


def _chained(spark, sf):
    """Entry hashes and previous hashes, some of which are wrong on purpose, and some entries missing."""
    e = event_log(spark, sf).withColumn("entry_hash", F.sha2(F.expr("user_id || ':' || event_id"), 256))
    from ..functions.scans import with_previous
    e = with_previous(e, ["user_id"], "seq", ["entry_hash"])
    prev = F.when(F.col("seq") == 1, L.genesis(["user_id"])).otherwise(F.col("prev_entry_hash"))
    e = e.withColumn("previous_hash", F.when(F.col("event_type") == "error", F.sha2(F.lit("bad"), 256)).otherwise(prev))
    return e.filter(~((F.col("event_type") == "view") & (F.col("value") > 60))).select("user_id", "seq", "entry_hash", "previous_hash")


@R.add("chain_verification", _LOG + """, k AS (SELECT *, lag(event_id) OVER (PARTITION BY user_id ORDER BY seq) AS p_id, lag(seq) OVER (PARTITION BY user_id ORDER BY seq) AS p_seq FROM lg WHERE NOT (event_type = 'view' AND value > 60))
   SELECT user_id, seq, CASE WHEN seq > 1 AND p_seq IS DISTINCT FROM seq - 1 THEN 'SEQUENCE_GAP' ELSE 'CHAIN_BROKEN' END AS violation FROM k WHERE event_type = 'error' OR (seq > 1 AND p_seq IS DISTINCT FROM seq - 1)""")
def chain_verification(spark, sf):
    return L.verify_chain(_chained(spark, sf), ["user_id"])


_RUNS = """CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'view' THEN 'PARTIAL' ELSE 'SUCCEEDED' END AS outcome_state, sha2(CAST(CAST(FLOOR(value / 20) AS BIGINT) AS STRING), 256) AS result_sha256"""
_RUNS_SQL = _RUNS.replace("sha2(", "sha256(").replace(", 256)", ")")
_GOOD = "last_value(CASE WHEN outcome_state = 'SUCCEEDED' THEN {x} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_W3 = _LOG + f", r AS (SELECT user_id, seq, event_type, {_RUNS_SQL} FROM lg), g AS (SELECT *, " + _GOOD.format(x="seq") + " AS g_seq, " + _GOOD.format(x="result_sha256") + """ AS g_hash FROM r),
   d AS (SELECT user_id, seq, event_type, outcome_state, result_sha256, CASE WHEN outcome_state <> 'SUCCEEDED' THEN 'NOT_COMPARABLE' WHEN g_seq IS NULL THEN 'BASELINE' WHEN g_hash = result_sha256 THEN 'UNCHANGED' ELSE 'CHANGED' END AS drift_state,
     CASE WHEN outcome_state = 'SUCCEEDED' THEN g_seq END AS compared_to_seq, CASE WHEN outcome_state = 'SUCCEEDED' THEN g_hash END AS previous_result_sha256 FROM g)"""


_RUNS_LIST = ["user_id", "seq", "event_type", "CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'view' THEN 'PARTIAL' ELSE 'SUCCEEDED' END AS outcome_state",
              "sha2(CAST(CAST(FLOOR(value / 20) AS BIGINT) AS STRING), 256) AS result_sha256"]


def runs(spark, sf):
    return event_log(spark, sf).selectExpr(*_RUNS_LIST)


@R.add("run_drift", _W3 + " SELECT * FROM d")
def run_drift(spark, sf):
    return L.run_drift(runs(spark, sf), ["user_id"])


@R.add("run_retention", _W3 + """, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS rn, max(CASE WHEN outcome_state = 'SUCCEEDED' THEN seq END) OVER (PARTITION BY user_id) AS lkg,
     count(*) OVER (PARTITION BY user_id) AS n FROM d) SELECT user_id, seq FROM k WHERE CASE WHEN lkg IS NULL OR lkg > n - 3 THEN rn <= 3 ELSE rn <= 2 OR seq = lkg END""")
def run_retention(spark, sf):
    return L.retained(runs(spark, sf), ["user_id"], 3).select("user_id", "seq")


@R.add("history_summary", _W3 + """ SELECT user_id, count(*) AS total_entries, arg_max(outcome_state, seq) AS latest_outcome_state, arg_max(drift_state, seq) AS latest_drift_state, max(seq) FILTER (WHERE outcome_state = 'SUCCEEDED') AS last_known_good_seq,
     count(*) FILTER (WHERE event_type = 'view') AS resumable_count, least(count(*), 20) AS retained_entries, count(*) - least(count(*), 20) AS pruned_entries FROM d GROUP BY 1""")
def history_summary(spark, sf):
    d = L.run_drift(runs(spark, sf), ["user_id"]).withColumn("resumable", F.col("event_type") == "view")
    return L.history_summary(d, ["user_id"])


_SIG = """CASE WHEN value > 75 THEN CASE event_type WHEN 'view' THEN 'UNKNOWN' ELSE 'TIMEOUT' END ELSE 'SUCCEEDED' END AS result_state,
   CASE WHEN value > 75 THEN 'UNKNOWN' WHEN event_type IN ('click', 'signup') THEN 'NO_GAIN' WHEN event_type IN ('error', 'view') THEN 'COUNTERS' ELSE 'SUPPORTS' END AS signal,
   CASE WHEN value > 75 THEN 0 WHEN value < 0.5 THEN 20000 WHEN event_type IN ('click', 'signup') AND value > 5 THEN 0 ELSE 50 END AS information_gain_bps"""
_W5 = _LOG + f""", s AS (SELECT user_id AS hypothesis_id, seq, {_SIG} FROM lg), i AS (SELECT *, seq - row_number() OVER (PARTITION BY hypothesis_id, signal ORDER BY seq) AS isl FROM s),
   c AS (SELECT *, row_number() OVER (PARTITION BY hypothesis_id, signal, isl ORDER BY seq) AS run FROM i),
   f AS (SELECT hypothesis_id, seq, result_state, signal, information_gain_bps, CASE WHEN signal = 'NO_GAIN' THEN run ELSE 0 END AS consecutive_no_gain, CASE WHEN signal = 'COUNTERS' THEN run ELSE 0 END AS consecutive_counterevidence,
     CASE WHEN result_state = 'UNKNOWN' THEN 'AWAITING_RECONCILIATION' WHEN result_state = 'TIMEOUT' THEN 'STOPPED' WHEN signal = 'SUPPORTS' THEN 'SUPPORTED_CANDIDATE' WHEN signal = 'COUNTERS' AND run >= 3 THEN 'STOPPED'
      WHEN signal = 'COUNTERS' THEN 'COUNTEREVIDENCE_CANDIDATE' WHEN run >= 4 THEN 'STOPPED' ELSE 'OPEN' END AS status,
     CASE WHEN result_state = 'UNKNOWN' THEN 'UNKNOWN_OUTCOME' WHEN result_state = 'TIMEOUT' THEN 'TIMEOUT' WHEN signal = 'COUNTERS' AND run >= 3 THEN 'REPEATED_COUNTEREVIDENCE' WHEN signal = 'NO_GAIN' AND run >= 4 THEN 'NO_GAIN_LIMIT' END AS terminal_reason FROM c)"""


def _signals(spark, sf):
    return spark.sql(f"SELECT user_id AS hypothesis_id, seq, {_SIG} FROM {{log}}", log=event_log(spark, sf))


@R.add("hypothesis_ledger", _W5 + " SELECT * FROM f")
def hypothesis_ledger(spark, sf):
    return L.hypothesis_ledger(_signals(spark, sf), max_no_gain=4, max_counter=3)


@R.add("evidence_ledger", _W5.replace("AS seq FROM events), s AS (SELECT user_id AS hypothesis_id, seq,", "AS seq FROM events), s AS (SELECT user_id AS hypothesis_id, seq, event_id, value,").replace(
    "f AS (SELECT hypothesis_id, seq, result_state,", "f AS (SELECT hypothesis_id, seq, event_id, value, result_state,") + """,
   stops AS (SELECT hypothesis_id, min(seq) AS stop FROM f WHERE status = 'STOPPED' GROUP BY 1), kept AS (SELECT f.* FROM f LEFT JOIN stops USING (hypothesis_id) WHERE stop IS NULL OR seq <= stop),
   refs AS (SELECT hypothesis_id, seq, signal AS role, unnest(['a' || event_id % 7, 'b' || event_id % 5]) AS ref FROM kept WHERE result_state = 'SUCCEEDED' AND signal IN ('SUPPORTS', 'COUNTERS')
     UNION ALL SELECT hypothesis_id, seq, 'RECEIPT', 'rc' || event_id % 11 FROM kept),
   firsts AS (SELECT hypothesis_id, role, ref, min(seq) AS seq FROM refs GROUP BY ALL), per AS (SELECT hypothesis_id, seq, count(*) FILTER (WHERE role = 'SUPPORTS') AS s, count(*) FILTER (WHERE role = 'COUNTERS') AS c, count(*) FILTER (WHERE role = 'RECEIPT') AS r FROM firsts GROUP BY ALL)
   SELECT hypothesis_id, seq, status, terminal_reason, consecutive_no_gain, consecutive_counterevidence, CAST(floor(value * 10) AS BIGINT) AS lower_bps, CAST(sum(coalesce(s, 0)) OVER w AS BIGINT) AS supporting_refs, CAST(sum(coalesce(c, 0)) OVER w AS BIGINT) AS counter_refs,
     CAST(sum(coalesce(r, 0)) OVER w AS BIGINT) AS receipts, count(*) FILTER (WHERE result_state = 'SUCCEEDED' AND signal = 'COUNTERS') OVER w AS contradictions FROM kept LEFT JOIN per USING (hypothesis_id, seq) WINDOW w AS (PARTITION BY hypothesis_id ORDER BY seq)""")
def evidence_ledger(spark, sf):
    e = spark.sql(f"""SELECT user_id AS hypothesis_id, seq, {_SIG}, array('a' || event_id % 7, 'b' || event_id % 5) AS evidence_refs, 'rc' || event_id % 11 AS source_receipt,
      CAST(floor(value * 10) AS BIGINT) AS lower_bps, CAST(10000 AS BIGINT) AS upper_bps FROM {{log}}""", log=event_log(spark, sf))
    return L.evidence_ledger(e, max_no_gain=4, max_counter=3).select("hypothesis_id", "seq", "status", "terminal_reason", "consecutive_no_gain", "consecutive_counterevidence", "lower_bps", "supporting_refs", "counter_refs", "receipts", "contradictions")


@R.add("probe_dispositions", """WITH q AS (SELECT props AS probe_key, event_id AS ordinal FROM events WHERE event_id % 2 = 0),
   r AS (SELECT props AS probe_key, bool_or(event_type = 'purchase') AS good, coalesce(min('r' || event_id) FILTER (WHERE event_type = 'purchase'), min('r' || event_id)) AS receipt FROM events WHERE event_id % 37 = 1 GROUP BY 1),
   a AS (SELECT DISTINCT props AS probe_key FROM events WHERE value > 90), d AS (SELECT q.*, receipt, CASE WHEN good THEN 'REUSED_SUCCESS' WHEN a.probe_key IS NOT NULL OR ordinal > min(ordinal) OVER (PARTITION BY q.probe_key) THEN 'SUPPRESSED_DUPLICATE' ELSE 'AUTHORIZED' END AS disposition
     FROM q LEFT JOIN r USING (probe_key) LEFT JOIN a USING (probe_key))
   SELECT probe_key, ordinal, disposition, CASE WHEN disposition <> 'AUTHORIZED' THEN receipt END AS receipt_sha256 FROM d""")
def probe_dispositions(spark, sf):
    e = load(spark, sf, "events").withColumnRenamed("props", "probe_key")
    receipts = e.where("event_id % 37 = 1").select("probe_key", F.when(F.col("event_type") == "purchase", "SUCCEEDED").otherwise("FAILED").alias("result_state"), F.concat(F.lit("r"), "event_id").alias("receipt_sha256"))
    return L.probe_dispositions(e.where("event_id % 2 = 0").select("probe_key", F.col("event_id").alias("ordinal")), receipts, e.where("value > 90").select("probe_key"))


@R.add("hypothesis_final", _W5 + """ SELECT hypothesis_id, status, terminal_reason, consecutive_no_gain, consecutive_counterevidence, seq FROM
    (SELECT *, row_number() OVER (PARTITION BY hypothesis_id ORDER BY CASE WHEN status = 'STOPPED' THEN 0 ELSE 1 END, CASE WHEN status = 'STOPPED' THEN seq ELSE -seq END) AS k FROM f) WHERE k = 1""")
def hypothesis_final(spark, sf):
    return L.hypothesis_final(L.hypothesis_ledger(_signals(spark, sf), max_no_gain=4, max_counter=3))


@R.add("outcome_violations", _W5 + """ SELECT hypothesis_id, seq, v AS violation FROM (SELECT *, unnest(list_filter([CASE WHEN result_state <> 'SUCCEEDED' AND (signal <> 'UNKNOWN' OR information_gain_bps <> 0) THEN 'SIGNAL_WITHOUT_RESULT' END,
    CASE WHEN result_state = 'SUCCEEDED' AND signal = 'UNKNOWN' THEN 'RESULT_WITHOUT_SIGNAL' END, CASE WHEN signal = 'NO_GAIN' AND information_gain_bps <> 0 THEN 'GAIN_ON_NO_GAIN' END,
    CASE WHEN information_gain_bps > 10000 THEN 'GAIN_OUT_OF_RANGE' END], lambda x: x IS NOT NULL)) AS v FROM f)""")
def outcome_violations(spark, sf):
    return L.outcome_violations(_signals(spark, sf)).select("hypothesis_id", "seq", "violation")


_JOURNAL = """CASE WHEN seq % 3 = 1 THEN CASE WHEN event_type = 'error' THEN 'manual_review_opened' ELSE 'initialized' END WHEN seq % 3 = 2 THEN 'dispatch_response_lost' ELSE 'reconcile_exact_before' END AS event_type,
   CASE WHEN seq % 3 = 1 THEN 'not_dispatched' WHEN seq % 3 = 2 THEN CASE WHEN value > 60 THEN 'partial' ELSE 'outcome_unknown' END ELSE 'unchanged_safe_to_retry' END AS to_state"""


def _journal(spark, sf):
    return spark.sql(f"SELECT user_id, seq, {_JOURNAL} FROM {{log}}", log=event_log(spark, sf))


@R.add("journal_validation", _LOG + f", j AS (SELECT user_id, seq, {_JOURNAL} FROM lg)" + """, p AS (SELECT *, CASE WHEN seq = 1 THEN '__start__' ELSE lag(to_state) OVER (PARTITION BY user_id ORDER BY seq) END AS from_state FROM j),
   t(from_state, event_type, legal) AS (VALUES ('__start__', 'initialized', 'not_dispatched'), ('not_dispatched', 'dispatch_response_lost', 'outcome_unknown'), ('outcome_unknown', 'reconcile_exact_before', 'unchanged_safe_to_retry'),
     ('partial', 'manual_review_opened', 'manual_review'), ('diverged', 'manual_review_opened', 'manual_review'))
   SELECT user_id, seq, from_state, event_type, to_state, CASE WHEN legal IS NULL THEN 'ILLEGAL_TRANSITION' ELSE 'TRANSITION_MISMATCH' END AS violation FROM p LEFT JOIN t USING (from_state, event_type) WHERE legal IS DISTINCT FROM to_state""")
def journal_validation(spark, sf):
    return L.validate_journal(_journal(spark, sf), ["user_id"])


_ATT = "SELECT l_orderkey AS run_id, l_linenumber AS attempt, CASE WHEN MAX(l_quantity) < 20 THEN 'TIMEOUT' WHEN MAX(l_quantity) < 40 THEN 'ERROR' WHEN MAX(l_quantity) < 45 THEN 'DENIED' ELSE 'SUCCEEDED' END AS state FROM {lineitem} GROUP BY l_orderkey, l_linenumber"


@R.add("retry_outcome", "WITH a AS (" + _ATT.format(lineitem="lineitem") + """), s AS (SELECT *, min(CASE WHEN state NOT IN ('TIMEOUT', 'ERROR') THEN attempt END) OVER (PARTITION BY run_id) AS st, max(attempt) OVER (PARTITION BY run_id) AS hi,
    min(attempt) OVER (PARTITION BY run_id) AS lo, count(*) OVER (PARTITION BY run_id) AS n FROM a)
   SELECT run_id, CAST(coalesce(st, hi) AS BIGINT) AS attempts_used, state AS final_state, lo = 1 AND hi = n AS numbered, coalesce(st = hi, true) AS stopped_in_time FROM s WHERE attempt = coalesce(st, hi)""")
def retry_outcome(spark, sf):
    return L.retry_outcome(portable(spark, sf, _ATT))


@R.add("ordinal_contiguity", """SELECT l_orderkey, n AS part_count, CASE WHEN d < n THEN 'DUPLICATE_ORDINAL' ELSE 'ORDINAL_GAP' END AS violation FROM (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS d, min(l_linenumber) AS lo, max(l_linenumber) AS hi
    FROM lineitem GROUP BY 1) WHERE d < n OR lo <> 1 OR hi <> d""")
def ordinal_contiguity(spark, sf):
    return L.ordinal_contiguity(load(spark, sf, "lineitem"), ["l_orderkey"], "l_linenumber")


# --- stored logic ---------------------------------------------------------------------------------------------
PARTS = {
    "p_before": """SELECT 'SCH_' || CAST(l_partkey AS STRING) AS schema_name, 'P_' || CAST(l_partkey AS STRING) AS object_name, CASE l_suppkey % 3 WHEN 0 THEN 'PROCEDURE' WHEN 1 THEN 'FUNCTION' ELSE 'TRIGGER' END AS object_kind,
       CAST(l_partkey AS STRING) AS native_object_id, CASE WHEN MAX(l_tax) > 0.07 THEN 'VISIBLE_HASHED' ELSE 'ENCRYPTED_OR_INVISIBLE' END AS definition_visibility,
       l_linenumber AS definition_component_ordinal, sha2(CAST(COUNT(*) AS STRING), 256) AS definition_component_hash FROM {lineitem} GROUP BY l_partkey, l_suppkey % 3, l_linenumber""",
}
PARTS["p_after"] = PARTS["p_before"].replace("CAST(COUNT(*) AS STRING)", "CAST(COUNT(*) + CASE WHEN MIN(l_discount) = 0.0 AND l_partkey % 2 = 0 THEN 1 ELSE 0 END AS STRING)").replace("FROM {lineitem}", "FROM {lineitem} WHERE l_quantity < 48")


def _tid(*cols):
    return "sha256(concat_ws(chr(31), " + ", ".join(f"coalesce(CAST({x} AS VARCHAR), chr(0) || 'null')" for x in cols) + "))"


def _objects_sql(src):
    return f"""(SELECT *, {_tid('object_id', 'definition_fingerprint_sha256', 'definition_component_count', 'native_object_id', 'definition_visibility')} AS object_sha256 FROM (
     SELECT *, {_tid('schema_name', 'object_name', 'object_kind')} AS object_id FROM (SELECT schema_name, object_name, object_kind, CAST(sum(seen) AS BIGINT) AS definition_component_count, max(native_object_id) AS native_object_id, max(v) AS definition_visibility,
      CASE WHEN max(v) = 'VISIBLE_HASHED' THEN sha256(string_agg(d, ',' ORDER BY b)) END AS definition_fingerprint_sha256 FROM (
       SELECT schema_name, object_name, object_kind, definition_component_ordinal // 4096 AS b, count(*) FILTER (WHERE definition_visibility = 'VISIBLE_HASHED') AS seen, max(native_object_id) AS native_object_id, max(definition_visibility) AS v,
        sha256(coalesce(string_agg(definition_component_ordinal || ':' || definition_component_hash, ',' ORDER BY definition_component_ordinal) FILTER (WHERE definition_visibility = 'VISIBLE_HASHED'), '')) AS d FROM {src} GROUP BY ALL) GROUP BY ALL)))"""


@R.add("stored_objects", ctes("p_before", texts=PARTS) + "SELECT * FROM " + _objects_sql("p_before"))
def stored_objects(spark, sf):
    return N.stored_objects(portable(spark, sf, PARTS["p_before"]))


@R.add("metadata_conflicts", ctes("p_before", texts=PARTS) + """SELECT schema_name, object_name, object_kind, count(*) AS variants FROM (SELECT DISTINCT schema_name, object_name, object_kind, native_object_id, definition_visibility FROM p_before) GROUP BY ALL HAVING count(*) > 1""")
def metadata_conflicts(spark, sf):
    return N.metadata_conflicts(portable(spark, sf, PARTS["p_before"]))


_CHG = f"""(SELECT coalesce(b.object_id, a.object_id) AS object_id, b.object_sha256 AS before_sha256, a.object_sha256 AS after_sha256, CASE WHEN b.object_id IS NULL THEN 'ADDED' WHEN a.object_id IS NULL THEN 'REMOVED' ELSE 'MODIFIED' END AS change_type
   FROM {_objects_sql('p_before')} b FULL JOIN {_objects_sql('p_after')} a ON a.object_id = b.object_id WHERE a.object_sha256 IS DISTINCT FROM b.object_sha256)"""


def _changes(spark, sf):
    return D.object_changes(*[N.stored_objects(portable(spark, sf, PARTS[x])) for x in ("p_before", "p_after")])


@R.add("object_changes", ctes("p_before", "p_after", texts=PARTS) + "SELECT * FROM " + _CHG)
def object_changes(spark, sf):
    return _changes(spark, sf)


_E = ["source_schema_name", "source_object_name", "source_object_kind", "target_schema_name", "target_object_name", "target_object_kind"]
_EC = ctes("e_dependencies") + f""", oe AS (SELECT *, {_tid(*_E, 'native_dependency_kind')} AS edge_sha256 FROM (SELECT DISTINCT {_tid(*_E[:3])} AS source_object_id, {_tid(*_E[3:])} AS target_object_id, {', '.join(_E)}, native_dependency_kind FROM e_dependencies WHERE resolution_state = 'RESOLVED')),
   ce AS (SELECT {_tid(*_E[:3])} AS source_object_id, {_tid(*_E[3:])} AS target_object_id, {', '.join(_E)}, target_column_name, native_dependency_kind, {_tid(*_E, 'target_column_name', 'native_dependency_kind')} AS edge_sha256
     FROM e_dependencies WHERE resolution_state = 'RESOLVED' AND column_resolution_state = 'PROVEN'),
   gp AS (SELECT {_tid(*_E[:3])} AS source_object_id, {', '.join(_E)}, native_dependency_kind, {_tid(*_E, 'native_dependency_kind')} AS gap_sha256 FROM e_dependencies WHERE resolution_state = 'UNRESOLVED')"""


@R.add("object_edges", _EC + " SELECT * FROM oe")
def object_edges(spark, sf):
    return N.object_edges(estate(spark, sf, "dependencies"))


@R.add("column_edges", _EC + " SELECT * FROM ce")
def column_edges(spark, sf):
    return N.column_edges(estate(spark, sf, "dependencies"))


@R.add("dependency_gaps", _EC + " SELECT * FROM gp")
def dependency_gaps(spark, sf):
    return N.dependency_gaps(estate(spark, sf, "dependencies"))


@R.add("orphan_edges", ctes("e_dependencies", "e_stored") + "SELECT source_schema_name, source_object_name, source_object_kind, count(*) AS n FROM e_dependencies WHERE (source_schema_name, source_object_name, source_object_kind) NOT IN (SELECT (schema_name, object_name, object_kind) FROM e_stored) GROUP BY ALL")
def orphan_edges(spark, sf):
    d, o = estate(spark, sf, "dependencies", "stored")
    return N.orphan_edges(d, o).groupBy("source_schema_name", "source_object_name", "source_object_kind").agg(F.count(F.lit(1)).alias("n"))


_LIN = """(SELECT 'PROVEN_OBJECT_NATIVE' AS relationship_class, 'OBJECT' AS granularity, source_object_id, target_schema_name, target_object_name, target_object_kind, NULL AS target_column_name, edge_sha256 AS evidence_sha256 FROM oe
   UNION ALL SELECT 'PROVEN_COLUMN_NATIVE', 'TARGET_COLUMN', source_object_id, target_schema_name, target_object_name, target_object_kind, target_column_name, edge_sha256 FROM ce)"""


def _lineage(spark, sf):
    d = estate(spark, sf, "dependencies")
    return N.lineage(N.object_edges(d), N.column_edges(d))


@R.add("lineage", _EC + " SELECT * FROM " + _LIN)
def lineage(spark, sf):
    return _lineage(spark, sf)


_BS = """(SELECT 'COLUMN_RELATIONSHIP_UNKNOWN' AS blind_spot_class, source_object_id, edge_sha256 AS evidence_sha256 FROM oe WHERE (source_object_id, target_schema_name, target_object_name) NOT IN (SELECT (source_object_id, target_schema_name, target_object_name) FROM ce)
   UNION ALL SELECT 'UNKNOWN_NATIVE_RELATIONSHIP', source_object_id, gap_sha256 FROM gp)"""


def _blind(spark, sf):
    d = estate(spark, sf, "dependencies")
    return N.lineage_blind_spots(N.object_edges(d), N.column_edges(d), N.dependency_gaps(d))


@R.add("lineage_blind_spots", _EC + " SELECT * FROM " + _BS)
def lineage_blind_spots(spark, sf):
    return _blind(spark, sf)


_PC = ", " + ctes("p_before", "p_after", "e_columns", texts=PARTS)[5:]
_APP = """(SELECT schema_name || '.' || relation_name || '.' || column_name AS candidate_id, schema_name, relation_name, column_name FROM e_columns WHERE data_type IN ('numeric', 'int4'))"""
#: Edges of the two snapshots: some on one side only, by the first digit of their hash, most on both.
_SIDES = f"""(SELECT * FROM {_LIN} WHERE evidence_sha256 NOT LIKE '0%' UNION SELECT * FROM {_LIN} WHERE evidence_sha256 NOT LIKE '1%')"""
_IMP = f"""(SELECT candidate_id, target_schema_name, target_object_name, target_column_name, impact_class, source_object_id, evidence_sha256 FROM (SELECT a.candidate_id, a.schema_name AS target_schema_name, a.relation_name AS target_object_name, a.column_name AS target_column_name,
   CASE WHEN r.target_column_name IS NOT NULL THEN 'AFFECTED_NATIVE_COLUMN' ELSE 'POTENTIALLY_AFFECTED_NATIVE_OBJECT' END AS impact_class, source_object_id, evidence_sha256,
   row_number() OVER (PARTITION BY candidate_id ORDER BY r.target_column_name IS NULL, source_object_id, evidence_sha256) AS k FROM {_SIDES} r JOIN {_APP} a ON a.schema_name = r.target_schema_name AND a.relation_name = r.target_object_name
   AND (r.target_column_name IS NULL OR r.target_column_name = a.column_name) WHERE source_object_id IN (SELECT object_id FROM {_CHG})) WHERE k = 1)"""


def _impact(spark, sf, changes=None):
    cols = estate(spark, sf, "columns").filter("data_type in ('numeric', 'int4')")
    app = cols.select(F.concat_ws(".", "schema_name", "relation_name", "column_name").alias("candidate_id"), "schema_name", "relation_name", "column_name")
    lin = _lineage(spark, sf)
    before, after = lin.filter("evidence_sha256 not like '0%'"), lin.filter("evidence_sha256 not like '1%'")
    return N.impact(_changes(spark, sf) if changes is None else changes, before, after, app)


@R.add("impact", _EC + _PC + " SELECT * FROM " + _IMP)
def impact(spark, sf):
    return _impact(spark, sf)


@R.add("impact_rows", _EC + _PC + f""" SELECT 'CHANGED_STORED_OBJECT' AS record_kind, 'REVIEW_REQUIRED' AS review_state, object_id AS source_object_id, change_type, NULL AS candidate_id, NULL AS target_schema_name, NULL AS target_object_name, NULL AS target_column_name, NULL AS impact_class FROM {_CHG}
   UNION ALL SELECT 'AFFECTED_APPROVED_BI', 'REVIEW_REQUIRED', source_object_id, NULL, candidate_id, target_schema_name, target_object_name, target_column_name, impact_class FROM {_IMP}""")
def impact_rows(spark, sf):
    changes = measured(_changes(spark, sf))  # reported, and what decides the impact
    return E.impact_rows(changes, _impact(spark, sf, changes))


@R.add("impact_blind_spots", _EC + _PC + f" SELECT *, source_object_id IN (SELECT object_id FROM {_CHG}) AS impact_relevant FROM {_BS}")
def impact_blind_spots(spark, sf):
    return E.impact_blind_spots(_blind(spark, sf), _changes(spark, sf))


# --- graph ----------------------------------------------------------------------------------------------------
NODES = "SELECT 'o' || CAST(o_orderkey AS STRING) AS node FROM {orders} UNION ALL SELECT 'p' || CAST(p_partkey AS STRING) FROM {part}"
LINKS = """SELECT 'o' || CAST(l_orderkey AS STRING) AS src, 'p' || CAST(l_partkey AS STRING) AS dst, CASE WHEN l_quantity >= 47 THEN 'PROPOSAL_ONLY' ELSE 'COUNTEREVIDENCE_ONLY' END AS status,
   CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS counter_count FROM {lineitem}"""
_G = "WITH RECURSIVE n AS (" + NODES.format(orders="orders", part="part") + "), k AS (" + LINKS.format(lineitem="lineitem") + """), e AS (SELECT src AS a, dst AS b FROM k WHERE status = 'PROPOSAL_ONLY' UNION SELECT dst, src FROM k WHERE status = 'PROPOSAL_ONLY'),
   w AS (SELECT node, node AS r FROM n UNION SELECT e.b, w.r FROM w JOIN e ON e.a = w.node), c AS (SELECT node, min(r) AS component FROM w GROUP BY 1)"""


@R.add("clusters", _G + " SELECT node, component FROM c")
def clusters(spark, sf):
    return G.clusters(portable(spark, sf, NODES), portable(spark, sf, LINKS))


@R.add("cluster_summary", _G + """, s AS (SELECT c1.component, count(*) FILTER (WHERE status = 'PROPOSAL_ONLY') AS support, CAST(sum(counter_count) AS BIGINT) AS counter FROM k JOIN c c1 ON c1.node = src JOIN c c2 ON c2.node = dst WHERE c1.component = c2.component GROUP BY 1),
   m AS (SELECT component, count(*) AS member_count, coalesce(max(support), 0) AS support, coalesce(max(counter), 0) AS counter FROM c LEFT JOIN s USING (component) GROUP BY 1)
   SELECT *, greatest(lower_bps, least(lower_bps + 3000, 10000)) AS upper_bps FROM (SELECT *, greatest(0, least(10000, 3000 + support * 1500 - counter * 1250)) AS lower_bps FROM m)""")
def cluster_summary(spark, sf):
    links = portable(spark, sf, LINKS)
    return G.cluster_summary(G.clusters(portable(spark, sf, NODES), links), links)


DAG_NODES = """SELECT 'r' || CAST(r_regionkey AS STRING) AS node FROM {region} UNION ALL SELECT 'n' || CAST(n_nationkey AS STRING) FROM {nation} UNION ALL SELECT 'c' || CAST(c_custkey AS STRING) FROM {customer}
   UNION ALL SELECT 'o' || CAST(o_orderkey AS STRING) FROM {orders} UNION ALL SELECT 's' || CAST(s_suppkey AS STRING) FROM {supplier}"""
DAG_EDGES = """SELECT 'n' || CAST(n_nationkey AS STRING) AS node, 'r' || CAST(n_regionkey AS STRING) AS needs FROM {nation} UNION ALL SELECT 'c' || CAST(c_custkey AS STRING), 'n' || CAST(c_nationkey AS STRING) FROM {customer}
   UNION ALL SELECT 'o' || CAST(o_orderkey AS STRING), 'c' || CAST(o_custkey AS STRING) FROM {orders} UNION ALL SELECT 'o' || CAST(o_orderkey AS STRING), 'x' || CAST(o_custkey AS STRING) FROM {orders} WHERE o_orderpriority = '1-URGENT'
   UNION ALL SELECT 's' || CAST(s_suppkey AS STRING), 's' || CAST(s_suppkey AS STRING) FROM {supplier} WHERE s_acctbal < 1000
   UNION ALL SELECT 's' || CAST(s_suppkey AS STRING), 's' || CAST(s_suppkey + CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE -1 END AS STRING) FROM {supplier} WHERE s_nationkey < 10"""
_DG = "WITH RECURSIVE n AS (" + DAG_NODES.format(region="region", nation="nation", customer="customer", orders="orders", supplier="supplier") + "), e AS (" + DAG_EDGES.format(
    nation="nation", customer="customer", orders="orders", supplier="supplier") + ")"


@R.add("dependency_levels", _DG + """, k AS (SELECT DISTINCT e.node, e.needs FROM e JOIN n ON n.node = e.needs WHERE e.node <> e.needs),
   reach AS (SELECT node, needs FROM k UNION SELECT r.node, k.needs FROM reach r JOIN k ON k.node = r.needs), cyc AS (SELECT DISTINCT node FROM reach WHERE node = needs),
   bad AS (SELECT node FROM cyc UNION SELECT r.node FROM reach r JOIN cyc ON cyc.node = r.needs),
   lv AS (SELECT node, 0 AS level FROM n UNION SELECT k.node, lv.level + 1 FROM lv JOIN k ON k.needs = lv.node WHERE k.node NOT IN (SELECT node FROM bad) AND lv.node NOT IN (SELECT node FROM bad))
   SELECT n.node, CASE WHEN n.node IN (SELECT node FROM bad) THEN NULL ELSE max(level) END AS level, CASE WHEN n.node IN (SELECT node FROM bad) THEN 'CYCLE' ELSE 'ORDERED' END AS status FROM n JOIN lv USING (node) GROUP BY n.node""")
def dependency_levels(spark, sf):
    return G.dependency_levels(portable(spark, sf, DAG_NODES), portable(spark, sf, DAG_EDGES))


@R.add("dangling_needs", _DG + " SELECT DISTINCT node, needs FROM e WHERE needs NOT IN (SELECT node FROM n)")
def dangling_needs(spark, sf):
    return G.dangling_needs(portable(spark, sf, DAG_NODES), portable(spark, sf, DAG_EDGES))


@R.add("self_needs", _DG + " SELECT DISTINCT node FROM e WHERE node = needs")
def self_needs(spark, sf):
    return G.self_needs(portable(spark, sf, DAG_EDGES))


ROLE = """SELECT 'e' || CAST(event_id AS STRING) AS evidence_id, CASE event_type WHEN 'view' THEN 'COLUMN_SUMMARY' WHEN 'click' THEN 'TEMPORAL_COVERAGE' WHEN 'signup' THEN 'QUALITY_INDICATORS' ELSE 'RELATIONSHIP_OVERLAP' END AS method,
   CASE WHEN value < 3 THEN 'DENIED' WHEN value < 20 THEN 'PARTIAL' ELSE 'COMPLETE' END AS state, event_type <> 'error' AND value > 5 AS inferred, 't' || CAST(user_id AS STRING) AS target, 't' || CAST(user_id + 7 AS STRING) AS dst_target,
   CASE WHEN value < 8 THEN 2 WHEN value < 15 THEN 1 ELSE 0 END AS counters, 'rc' || CAST(event_id % 50 AS STRING) AS receipt_id FROM {events}"""


@R.add("role_candidates", "WITH v AS (" + ROLE.format(events="events") + """), r AS (SELECT 'KEY_CANDIDATE' AS role_kind, target, evidence_id, receipt_id, counters FROM v WHERE method = 'COLUMN_SUMMARY' AND inferred
   UNION ALL SELECT 'TEMPORAL_AXIS_CANDIDATE', target, evidence_id, receipt_id, counters FROM v WHERE method = 'TEMPORAL_COVERAGE' AND state IN ('COMPLETE', 'PARTIAL')
   UNION ALL SELECT 'QUALITY_REVIEW_CANDIDATE', target, evidence_id, receipt_id, counters FROM v WHERE method = 'QUALITY_INDICATORS' AND counters > 0
   UNION ALL SELECT 'RELATIONSHIP_LINK_CANDIDATE', target, evidence_id, receipt_id, counters FROM v WHERE method = 'RELATIONSHIP_OVERLAP' AND inferred
   UNION ALL SELECT 'RELATIONSHIP_LINK_CANDIDATE', dst_target, evidence_id, receipt_id, counters FROM v WHERE method = 'RELATIONSHIP_OVERLAP' AND inferred),
   g AS (SELECT role_kind, target, count(DISTINCT evidence_id) AS support, CAST(sum(counters) AS BIGINT) AS counter, count(DISTINCT receipt_id) AS receipts FROM r GROUP BY 1, 2)
   SELECT *, greatest(lower_bps, least(lower_bps + 3000, 10000)) AS upper_bps FROM (SELECT *, greatest(0, least(10000, 3000 + support * 1500 - counter * 1250)) AS lower_bps FROM g)""")
def role_candidates(spark, sf):
    v = portable(spark, sf, ROLE)
    counter = F.when(F.col("counters") == 2, F.array(F.lit("A"), F.lit("B"))).when(F.col("counters") == 1, F.array(F.lit("A"))).otherwise(F.array().cast("array<string>"))
    return G.role_candidates(v.withColumn("counter", counter))
