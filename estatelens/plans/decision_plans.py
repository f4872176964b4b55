"""Ranking, budgets, labels, metrics, evaluation and SQL text bound to the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import coverage as V
from ..operators import decisions as K
from ..operators import evaluation as A
from ..operators import metrics as M
from ..operators import sqltext as S
from ..operators.rules import declared_family
from .base import Registry, load, stringify
from .catalog_plans import _CAP, _COD, _OV, _capacity, _facts
from .estate import ctes, estate, portable

R = Registry()

# --- candidates: parts bought; a type is a table and a (type, brand) a hypothesis -------------------------
CAND = """SELECT 'c' || CAST(p_partkey AS STRING) AS candidate_id, p_type AS table_key, p_type || '/' || p_brand AS hypothesis_id, p_name || '/' || p_brand AS near_duplicate_key,
   CAST(p_size * 200 AS BIGINT) AS uncertainty_bps, CAST(p_partkey * 7 % 10001 AS BIGINT) AS outcome_probability_bps, CAST(FLOOR(p_retailprice) AS BIGINT) * 5 AS relevance_bps FROM {part}"""
_CW = "WITH c AS (SELECT *, uncertainty_bps * outcome_probability_bps * relevance_bps // 100000000 AS expected_gain_bps FROM (" + CAND.format(part="part") + "))"


def _cand(spark, sf):
    return K.expected_gain(portable(spark, sf, CAND))


@R.add("expected_gain", _CW + " SELECT candidate_id, expected_gain_bps FROM c")
def expected_gain(spark, sf):
    return _cand(spark, sf).select("candidate_id", "expected_gain_bps")


@R.add("near_duplicates", _CW + " SELECT candidate_id, near_duplicate_key FROM c QUALIFY row_number() OVER (PARTITION BY near_duplicate_key ORDER BY expected_gain_bps DESC, candidate_id) = 1")
def near_duplicates(spark, sf):
    return K.suppress_near_duplicates(_cand(spark, sf)).select("candidate_id", "near_duplicate_key")


@R.add("budgeted_selection", _CW + """, h AS (SELECT * FROM c WHERE expected_gain_bps >= 100 QUALIFY row_number() OVER (PARTITION BY table_key, hypothesis_id ORDER BY expected_gain_bps DESC, candidate_id) <= 3),
   t AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY table_key ORDER BY expected_gain_bps DESC, candidate_id) <= 25) SELECT candidate_id, expected_gain_bps FROM t ORDER BY expected_gain_bps DESC, candidate_id LIMIT 100""")
def budgeted_selection(spark, sf):
    return K.budgeted_selection(_cand(spark, sf), 3, 25, 100, 100).select("candidate_id", "expected_gain_bps")


OBJ = """SELECT 'c' || CAST(o_orderkey AS STRING) AS candidate_id, CAST(FLOOR(o_totalprice) AS BIGINT) AS expected_gain_bps, 'x' || CAST(o_custkey AS STRING) AS a, 'y' || CAST(o_orderkey % 400 AS STRING) AS b FROM {orders}"""


@R.add("object_capped_selection", "WITH RECURSIVE c AS (" + OBJ.format(orders="orders").replace("STRING", "VARCHAR") + """), t AS (
   SELECT candidate_id, expected_gain_bps, unnest([a, b]) AS object, CAST(5 AS BIGINT) AS room, false AS taken FROM c
   UNION ALL SELECT candidate_id, expected_gain_bps, object, room - wins, win FROM (SELECT *, count(*) FILTER (WHERE win) OVER (PARTITION BY object) AS wins FROM (
     SELECT *, bool_and(rn <= room) OVER (PARTITION BY candidate_id) AS win FROM (SELECT *, row_number() OVER (PARTITION BY object ORDER BY expected_gain_bps DESC, candidate_id) AS rn FROM t WHERE NOT taken)))
     QUALIFY win OR min(room - wins) OVER (PARTITION BY candidate_id) > 0)
   SELECT DISTINCT candidate_id, expected_gain_bps FROM t WHERE taken""")
def object_capped_selection(spark, sf):
    """A candidate that fits in all its objects whatever happens is taken; a test also holds it against the greedy walk."""
    return K.object_capped_selection(portable(spark, sf, OBJ).select("candidate_id", "expected_gain_bps", F.array("a", "b").alias("objects")), 5).select("candidate_id", "expected_gain_bps")


_SUM = """(SELECT c_nationkey, 1.0 * count(*) FILTER (WHERE c_mktsegment = 'BUILDING') / count(*) AS null_pct_max, greatest(max(c_acctbal) - avg(c_acctbal), avg(c_acctbal) - min(c_acctbal)) / stddev_pop(c_acctbal) AS outlier_z_max, 0.0 AS format_error_pct_max,
   1.0 * count(*) FILTER (WHERE c_acctbal < 0) / count(*) AS impossible_value_pct_max, 0.0 AS noise_score, 1.0 * (count(*) - count(DISTINCT (c_mktsegment, c_name))) / count(*) AS candidate_key_collision_pct FROM customer GROUP BY 1)"""


def _summary(spark, sf):
    c = load(spark, sf, "customer").withColumn("seg", F.expr("nullif(c_mktsegment, 'BUILDING')"))
    return K.profile_summary(c, ["c_nationkey"], "c_acctbal", "seg", ["c_mktsegment", "c_name"])


_ROUND = ["null_pct_max", "outlier_z_max", "impossible_value_pct_max", "candidate_key_collision_pct"]


@R.add("profile_summary", "SELECT c_nationkey, " + ", ".join(f"round({x}, 6) AS {x}" for x in _ROUND) + " FROM " + _SUM)
def profile_summary(spark, sf):
    return _summary(spark, sf).select("c_nationkey", *[F.round(x, 6).alias(x) for x in _ROUND])


_LAB = """concat_ws(',', CASE WHEN impossible_value_pct_max >= 0.02 THEN 'corruption_signal' END, CASE WHEN format_error_pct_max >= 0.01 OR noise_score >= 0.4 THEN 'format_noise' END,
   CASE WHEN candidate_key_collision_pct >= 0.05 THEN 'grain_conflict' END, CASE WHEN null_pct_max >= 0.15 THEN 'material_missingness' END, CASE WHEN outlier_z_max >= 5 THEN 'outlier_cluster' END)"""
_LABS = """concat_ws(',', CASE WHEN impossible_value_pct_max >= 0.04 THEN 'corruption_signal' END, CASE WHEN candidate_key_collision_pct >= 0.08 THEN 'grain_conflict' END,
   CASE WHEN null_pct_max >= 0.2 THEN 'material_missingness' END, CASE WHEN outlier_z_max >= 6.5 THEN 'outlier_cluster' END)"""


@R.add("anomaly_labels", f"SELECT c_nationkey, {_LAB} AS labels, {_LABS} AS strict_labels FROM {_SUM}")
def anomaly_labels(spark, sf):
    return stringify(_summary(spark, sf).select("c_nationkey", K.anomaly_labels().alias("labels"), K.anomaly_labels(strict=True).alias("strict_labels")), "labels", "strict_labels")


_TERMS = "SELECT event_id, event_type || ' ' || CASE CAST(FLOOR(value) AS BIGINT) % 8 WHEN 0 THEN 'order lines' WHEN 1 THEN 'supplier lead' WHEN 2 THEN 'Station hold' WHEN 3 THEN 'berth' WHEN 4 THEN 'rx service' WHEN 5 THEN 'asset' WHEN 6 THEN 'lot yield' ELSE 'other' END AS term, CASE WHEN user_id < 50 THEN 'easy' WHEN user_id < 100 THEN 'medium' ELSE 'hard' END AS tier FROM {events}"
_DOM = "CASE WHEN regexp_matches({t}, 'order|shipment|return|margin') THEN 'order_fulfillment_margin' WHEN regexp_matches({t}, 'supplier|receipt|defect|lead') THEN 'supplier_quality_lead_time' WHEN regexp_matches({t}, 'lot|station|yield|hold') THEN 'station_yield_hold_analysis' WHEN regexp_matches({t}, 'vessel|berth|queue|demurrage') THEN 'berth_queue_demurrage' WHEN regexp_matches({t}, 'episode|rx|service|adjustment|denominator') THEN 'care_episode_adjustment_quality' WHEN regexp_matches({t}, 'asset|cycle|downtime|rework') THEN 'asset_cycle_rework_downtime' ELSE 'unknown_domain_nonclaim' END"
_INC = "CASE WHEN tier = 'easy' THEN " + _DOM.format(t="lower(term)") + " WHEN regexp_matches(term, 'lot|station|yield') THEN 'station_yield_hold_analysis' ELSE 'unknown_domain_nonclaim' END"


def _terms(spark, sf):
    return portable(spark, sf, _TERMS).withColumn("terms", F.split("term", " "))


@R.add("domain_from_terms", "WITH t AS (" + _TERMS.format(events="events") + ") SELECT event_id, " + _DOM.format(t="lower(term)") + f" AS domain, {_INC} AS incumbent_domain FROM t")
def domain_from_terms(spark, sf):
    return _terms(spark, sf).select("event_id", K.domain_of("terms").alias("domain"), K.incumbent_domain("terms", "tier").alias("incumbent_domain"))


_PRB = """SELECT event_id, CASE WHEN user_id < 40 THEN 'grain_conflict' WHEN user_id < 80 THEN 'material_missingness' WHEN user_id < 120 THEN 'outlier_cluster' ELSE 'none' END AS label,
   CASE event_type WHEN 'view' THEN 'Grain disagree' WHEN 'click' THEN 'null runs' WHEN 'signup' THEN 'spike' ELSE 'calm' END AS s1, 'sparse tail' AS s2 FROM {events}"""


@R.add("probe_choice", "WITH p AS (" + _PRB.format(events="events") + """) SELECT event_id, CASE label WHEN 'grain_conflict' THEN 'grain_collision_summary' WHEN 'material_missingness' THEN 'null_pattern_by_metric' WHEN 'outlier_cluster' THEN 'outlier_cluster_by_segment' ELSE 'domain_alias_lookup' END AS probe_kind,
   CASE label WHEN 'grain_conflict' THEN CASE WHEN s1 = 'Grain disagree' THEN s1 ELSE '' END WHEN 'material_missingness' THEN CASE WHEN s1 = 'null runs' THEN s1 || ',' || s2 ELSE s2 END
    WHEN 'outlier_cluster' THEN CASE WHEN s1 = 'spike' THEN s1 || ',' || s2 ELSE s2 END ELSE s1 || ',' || s2 END AS probe_signals FROM p""")
def probe_choice(spark, sf):
    p = portable(spark, sf, _PRB).withColumn("labels", F.array("label")).withColumn("summaries", F.array("s1", "s2"))
    return stringify(K.choose_probe(p).select("event_id", "probe_kind", "probe_signals"), "probe_signals")


@R.add("case_budget", f"""WITH s AS (SELECT c_nationkey, {_LAB} AS labels, noise_score FROM {_SUM}), n AS (SELECT *, contains(labels, 'grain_conflict') OR contains(labels, 'corruption_signal') OR noise_score >= 0.4 AS needs_probe FROM s)
   SELECT c_nationkey, labels, needs_probe, c_nationkey IN (SELECT c_nationkey FROM n WHERE needs_probe ORDER BY c_nationkey LIMIT 20) AS probed FROM n""")
def case_budget(spark, sf):
    s = _summary(spark, sf).withColumn("labels", K.anomaly_labels())
    s = s.withColumn("needs_probe", K.needs_probe(F.lit("known"), "labels", "noise_score"))
    return stringify(K.case_budget(s.select("c_nationkey", "labels", "needs_probe"), 20, "c_nationkey"), "labels")


# --- metrics ------------------------------------------------------------------------------------------------
@R.add("metric_query", """SELECT date_trunc('day', ts) AS period_start, event_type, round(sum(value), 6) AS metric_value FROM events WHERE event_type IN ('view', 'purchase') AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'
   GROUP BY 1, 2""")
def metric_query(spark, sf):
    m = M.metric_query(load(spark, sf, "events"), "value", isin={"event_type": ["view", "purchase"]}, time_col="ts", time_range=("2024-01-05", "2024-01-20"), grain="day", group_by=["event_type"])
    return m.withColumn("metric_value", F.round("metric_value", 6)).withColumn("period_start", F.col("period_start").cast("timestamp_ntz"))


@R.add("metric_total", "SELECT user_id, round(sum(value), 6) AS metric_value FROM events WHERE event_type = 'purchase' GROUP BY 1")
def metric_total(spark, sf):
    return M.metric_query(load(spark, sf, "events"), "value", equals={"event_type": "purchase"}, group_by=["user_id"], row_limit=None).withColumn("metric_value", F.round("metric_value", 6))


_NMC = ctes("e_relations", "e_columns", "e_stored", "e_errors", "e_comments", "e_arguments", "e_constraints", "e_indexes", "e_statistics", "e_sizes", "e_dependencies", "e_extracts")


@R.add("named_metrics", _NMC + f"""SELECT 'relations_total' AS metric, CAST(sum(relation_count) AS BIGINT) AS value FROM {_OV} UNION ALL SELECT 'columns_total', CAST(sum(column_count) AS BIGINT) FROM {_OV}
   UNION ALL SELECT 'estimated_bytes', CAST(sum(bytes) AS BIGINT) FROM {_CAP} UNION ALL SELECT 'constraints_total', CAST(sum(constraint_count) AS BIGINT) FROM {_CAP} UNION ALL SELECT 'indexes_total', CAST(sum(index_count) AS BIGINT) FROM {_CAP}
   UNION ALL SELECT 'compile_issues', CAST(sum(compile_issue_count) AS BIGINT) FROM ({_COD}) UNION ALL SELECT 'denied_or_unknown_collectors', count(*) FROM e_extracts WHERE state IN ('DENIED', 'TIMEOUT', 'ERROR', 'PARTIAL')""")
def named_metrics(spark, sf):
    return M.named_metrics(C.schema_overview(_facts(spark, sf)), _capacity(spark, sf), C.code_dependencies(*estate(spark, sf, "stored", "arguments", "errors", "dependencies")),
                           V.with_visibility(estate(spark, sf, "extracts")))


@R.add("semantic_model", ctes("e_columns") + """, f AS (SELECT relation_name AS table_name, column_name, CASE WHEN data_type IN ('int4', 'numeric') THEN 'numeric' WHEN data_type = 'timestamp' THEN 'temporal' ELSE 'text' END AS family FROM e_columns)
   SELECT table_name, column_name, 'measure' AS element, NULL AS expression FROM f WHERE family = 'numeric' AND NOT regexp_matches(column_name, '(?i)(^id$|_id$)')
   UNION ALL SELECT table_name, column_name, 'dimension', NULL FROM f WHERE family IN ('text', 'temporal')
   UNION ALL SELECT table_name, column_name, 'kpi', 'SUM(' || column_name || ')' FROM f WHERE regexp_matches(column_name, '(?i)(amount|revenue|cost|price|total)')
   UNION ALL SELECT table_name, column_name, 'kpi', 'AVG(' || column_name || ')' FROM f WHERE regexp_matches(column_name, '(?i)(delay|late|lead_time|duration)')""")
def semantic_model(spark, sf):
    return M.semantic_model(estate(spark, sf, "columns").select(F.col("relation_name").alias("table_name"), "column_name", declared_family("data_type").alias("family")))


@R.add("evaluated_kpis", "SELECT 'orders.o_totalprice.sum' AS kpi_id, round(sum(o_totalprice), 2) AS value FROM orders UNION ALL SELECT 'lineitem.l_extendedprice.sum', round(sum(l_extendedprice), 2) FROM lineitem")
def evaluated_kpis(spark, sf):
    o, l = load(spark, sf, "orders", "lineitem")
    return M.evaluate_kpis(o, "orders").unionByName(M.evaluate_kpis(l, "lineitem")).withColumn("value", F.round("value", 2))


# --- evaluation -----------------------------------------------------------------------------------------------
_CASES = """SELECT event_id AS case_id, CASE WHEN user_id < 50 THEN 'easy' WHEN user_id < 100 THEN 'medium' ELSE 'hard' END AS tier, event_type AS expected_domain,
   CASE WHEN value < 60 THEN event_type ELSE 'other' END AS c_domain, CASE WHEN value < 25 THEN event_type ELSE 'other' END AS i_domain, CASE WHEN value < 40 THEN 'b' ELSE 'z' END AS second FROM {events}"""


def _sides(spark, sf):
    c = portable(spark, sf, _CASES)
    oracle = c.select("case_id", "expected_domain", F.array(F.lit("a"), F.lit("b")).alias("expected_anomalies"))
    side = lambda d: A.score_cases(c.select("case_id", "tier", F.col(d).alias("domain"), F.array("second", F.lit("a")).alias("anomalies")), oracle)
    return side("i_domain"), side("c_domain")


_CS = "WITH c AS (" + _CASES.format(events="events") + "), s AS (SELECT *, c_domain = expected_domain AS cd, i_domain = expected_domain AS idm, second = 'b' AS ae FROM c)"


@R.add("score_cases", _CS + " SELECT case_id, cd AS domain_exact, ae AS anomaly_exact, cd AND ae AS exact, CAST(CASE WHEN cd THEN 0 ELSE 2 END + CASE WHEN ae THEN 0 ELSE 2 END AS BIGINT) AS ambiguity_points FROM s")
def score_cases(spark, sf):
    return _sides(spark, sf)[1].select("case_id", "domain_exact", "anomaly_exact", "exact", "ambiguity_points")


_TIER = """t AS (SELECT tier, count(*) AS cases, 1.0 * count(*) FILTER (WHERE idm AND ae) / count(*) AS incumbent_exact, 1.0 * count(*) FILTER (WHERE cd AND ae) / count(*) AS candidate_exact,
   CAST(sum(CASE WHEN idm THEN 0 ELSE 2 END + CASE WHEN ae THEN 0 ELSE 2 END) AS BIGINT) AS incumbent_points, CAST(sum(CASE WHEN cd THEN 0 ELSE 2 END + CASE WHEN ae THEN 0 ELSE 2 END) AS BIGINT) AS candidate_points FROM s GROUP BY 1)"""


@R.add("tier_scores", _CS + ", " + _TIER + " SELECT tier, cases, round(incumbent_exact, 6) AS incumbent_exact, round(candidate_exact, 6) AS candidate_exact, incumbent_points, candidate_points FROM t")
def tier_scores(spark, sf):
    t = A.compare_scores(*_sides(spark, sf))
    return t.withColumn("incumbent_exact", F.round("incumbent_exact", 6)).withColumn("candidate_exact", F.round("candidate_exact", 6))


@R.add("acceptance", _CS + ", " + _TIER + """ SELECT incumbent_points, candidate_points, easy_regression, round(hard_gain, 6) AS hard_gain, round(red, 6) AS ambiguity_reduction, 0.2::DOUBLE AS additional_probe_rate, NOT coalesce(easy_regression, false) AND (coalesce(hard_gain, 0) >= 0.2 OR red >= 0.3) AS accepted
   FROM (SELECT CAST(sum(incumbent_points) AS BIGINT) AS incumbent_points, CAST(sum(candidate_points) AS BIGINT) AS candidate_points, bool_or(candidate_exact < incumbent_exact) FILTER (WHERE tier = 'easy') AS easy_regression,
     max(candidate_exact - incumbent_exact) FILTER (WHERE tier = 'hard') AS hard_gain, (sum(incumbent_points) - sum(candidate_points)) / sum(incumbent_points) AS red FROM t)""")
def acceptance(spark, sf):
    a = A.acceptance(A.compare_scores(*_sides(spark, sf)), 4, 20)
    return a.withColumn("hard_gain", F.round("hard_gain", 6)).withColumn("ambiguity_reduction", F.round("ambiguity_reduction", 6))


@R.add("discovery_ambiguity", "SELECT user_id, CAST(CASE WHEN k > 0 THEN 0 ELSE 2 END + CASE WHEN r > 0 THEN 0 ELSE 1 END + CASE WHEN b > 0 THEN 1 ELSE 0 END AS BIGINT) AS ambiguity_points FROM (SELECT user_id, count(*) FILTER (WHERE value > 70 AND event_type = 'view') AS k, "
       "count(*) FILTER (WHERE value > 80 AND event_type = 'click') AS r, count(*) FILTER (WHERE value < 1) AS b FROM events GROUP BY 1)")
def discovery_ambiguity(spark, sf):
    e = load(spark, sf, "events").groupBy("user_id").agg(
        F.count_if((F.col("value") > 70) & (F.col("event_type") == "view")).alias("kpi_count"), F.count_if((F.col("value") > 80) & (F.col("event_type") == "click")).alias("relationship_count"),
        F.count_if(F.col("value") < 1).alias("blind_spot_count"))
    return A.discovery_ambiguity(e).select("user_id", "ambiguity_points")


_GEN = """SELECT user_id AS generation_id, CASE WHEN value < 0.3 THEN 1 ELSE 0 END AS hard_failures, CASE WHEN value > 10 THEN 1.0 ELSE 0.5 END AS discovery, CASE WHEN value > 5 THEN 1.0 ELSE 0.0 END AS oracle,
   1.0 AS citation, CASE WHEN event_type = 'error' THEN 0.25 ELSE 1.0 END AS tool, CASE WHEN value < 0.8 THEN 0 ELSE 1 END AS privacy, 1 AS safety FROM {events}"""
_GS = "WITH g AS (" + _GEN.format(events="events") + "), s AS (SELECT generation_id, CAST(sum(hard_failures) AS BIGINT) AS hard_failures, " + ", ".join(f"avg(CAST({d} AS DOUBLE)) AS {d}" for d in A.DIMENSIONS) + " FROM g GROUP BY 1)"


@R.add("generation_scores", _GS + " SELECT generation_id, hard_failures, " + ", ".join(f"round({d}, 6) AS {d}" for d in A.DIMENSIONS) + " FROM s")
def generation_scores(spark, sf):
    s = A.score_generations(portable(spark, sf, _GEN))
    return s.select("generation_id", "hard_failures", *[F.round(d, 6).alias(d) for d in A.DIMENSIONS])


@R.add("generation_gate", _GS + """, j AS (SELECT a.generation_id AS incumbent, b.generation_id AS candidate, b.hard_failures = 0 AS hard, b.privacy = 1 AND b.safety = 1 AS safe, concat_ws(',', """ +
       ", ".join(f"CASE WHEN b.{d} + 1e-12 < a.{d} THEN '{d}' END" for d in A.DIMENSIONS) + """) AS regressions FROM s a JOIN s b ON b.generation_id = a.generation_id + 1), k AS (SELECT *, hard AND safe AND regressions = '' AS accepted FROM j)
   SELECT incumbent, candidate, accepted, CASE WHEN accepted THEN candidate ELSE incumbent END AS selected, regressions, CASE WHEN accepted THEN '' ELSE concat_ws(',', CASE WHEN NOT hard THEN 'NEW_OR_RETAINED_HARD_FAILURE' END,
     CASE WHEN regressions <> '' THEN 'REGRESSION:' || replace(regressions, ',', ',REGRESSION:') END) END AS negative_evidence FROM k""")
def generation_gate(spark, sf):
    s = A.score_generations(portable(spark, sf, _GEN))
    pairs = s.select(F.col("generation_id").alias("incumbent"), (F.col("generation_id") + 1).alias("candidate"))
    return stringify(A.compare_generations(s, pairs), "regressions", "negative_evidence")


@R.add("stability", "SELECT l_partkey, count(*) AS runs, count(DISTINCT (l_returnflag, l_linestatus)) AS distinct_digests, count(DISTINCT (l_returnflag, l_linestatus)) = 1 AS stable FROM lineitem GROUP BY 1")
def stability(spark, sf):
    return A.stability(load(spark, sf, "lineitem"), ["l_partkey"], ["l_returnflag", "l_linestatus"])


# --- SQL text: a statement log written from line items ----------------------------------------------------------
STMT = """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_partkey % 14 AS k, 'mssql' AS engine, CASE l_partkey % 14
  WHEN 0 THEN 'SELECT o.name FROM sys.objects o JOIN [sys].[columns] c ON c.object_id = ' || CAST(l_orderkey AS STRING)
  WHEN 1 THEN 'SELECT * FROM sys.tables' WHEN 2 THEN 'UPDATE sys.tables SET name = ' || CAST(l_orderkey AS STRING)
  WHEN 3 THEN 'SELECT ''drop table x; delete'' AS t FROM sys.tables -- update' WHEN 4 THEN 'SELECT name FROM dbo.orders_' || CAST(l_orderkey AS STRING)
  WHEN 5 THEN 'SELECT a FROM sys.types; SELECT b FROM sys.types' WHEN 6 THEN 'SELECT x FROM (SELECT object_id AS x FROM sys.indexes) d;'
  WHEN 7 THEN 'SELECT ''open FROM sys.tables' WHEN 8 THEN 'SELECT 1' WHEN 9 THEN 'SELECT a /* outer /* inner */ drop */ FROM "sys"."schemas"'
  WHEN 10 THEN 'SELECT name INTO t FROM sys.tables' WHEN 11 THEN 'EXECUTE IMMEDIATE ''SELECT 1''' WHEN 12 THEN 'SELECT "bad name" FROM sys.tables' ELSE 'SELECT a FROM 7' END AS statement FROM {lineitem}"""


@R.add("sql_audit", "WITH s AS (" + STMT.format(lineitem="lineitem") + """) SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
   ['ALLOWED','WILDCARD_DENIED','SELECT_ONLY_DENIED','ALLOWED','ROW_SOURCE_DENIED','MULTI_STATEMENT_DENIED','ALLOWED','LEXICAL_INVALID','CATALOG_SOURCE_MISSING','ALLOWED','MUTATION_DENIED','SELECT_ONLY_DENIED','LEXICAL_INVALID','SOURCE_BOUNDARY_DENIED'][k + 1] AS verdict,
   CASE k WHEN 0 THEN 'SYS.COLUMNS,SYS.OBJECTS' WHEN 3 THEN 'SYS.TABLES' WHEN 4 THEN 'DBO.ORDERS_' || l_orderkey WHEN 6 THEN 'SYS.INDEXES' WHEN 9 THEN 'SYS.SCHEMAS' END AS sources, CAST(CASE WHEN k = 6 THEN 1 ELSE 0 END AS BIGINT) AS derived_sources FROM s WHERE k IN (0, 3, 4, 6, 9)
   UNION ALL SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
   ['ALLOWED','WILDCARD_DENIED','SELECT_ONLY_DENIED','ALLOWED','ROW_SOURCE_DENIED','MULTI_STATEMENT_DENIED','ALLOWED','LEXICAL_INVALID','CATALOG_SOURCE_MISSING','ALLOWED','MUTATION_DENIED','SELECT_ONLY_DENIED','LEXICAL_INVALID','SOURCE_BOUNDARY_DENIED'][k + 1], NULL, 0 FROM s WHERE k NOT IN (0, 3, 4, 6, 9)""")
def sql_audit(spark, sf):
    a = S.audit_sql(portable(spark, sf, STMT), "statement")
    keep = F.col("k").isin(0, 3, 4, 6, 9)
    return a.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "verdict", F.when(keep, F.array_join("sources", ",")).alias("sources"), "derived_sources")


@R.add("sql_audit_documents", """SELECT doc_id, CASE WHEN regexp_matches(text, '[''"\\[]|/\\*') THEN 'QUOTED' WHEN NOT regexp_matches(text, '(?i)^[^A-Za-z_0-9().,;*]*select([^A-Za-z0-9_$#]|$)') THEN 'SELECT_ONLY_DENIED' ELSE 'SELECT' END AS outcome FROM documents""")
def sql_audit_documents(spark, sf):
    """Whole documents as a statement log: prose is never a SELECT; texts with quote marks are told apart."""
    d = load(spark, sf, "documents").withColumn("engine", F.lit("oracle"))
    a = S.audit_sql(d, "text")
    return a.select("doc_id", F.when(F.col("text").rlike("""['"\\[]|/\\*"""), "QUOTED").when(F.col("verdict") == "SELECT_ONLY_DENIED", F.col("verdict")).otherwise("SELECT").alias("outcome"))


@R.add("sql_table_refs", "WITH s AS (" + STMT.format(lineitem="lineitem") + """), r AS (SELECT *, CASE k WHEN 0 THEN ['sys.objects', 'sys.columns'] WHEN 1 THEN ['sys.tables'] WHEN 3 THEN ['sys.tables'] WHEN 4 THEN ['dbo.orders_' || l_orderkey] WHEN 6 THEN ['sys.indexes']
     WHEN 9 THEN ['sys.schemas'] WHEN 10 THEN ['sys.tables'] WHEN 12 THEN ['sys.tables'] END AS refs FROM s), u AS (SELECT * EXCLUDE (refs), unnest(coalesce(refs, [NULL])) AS ref FROM r)
   SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN ref IS NOT NULL THEN NULL WHEN k = 11 THEN 'DYNAMIC_SQL_BLIND_SPOT' ELSE 'UNSUPPORTED_SYNTAX_BLIND_SPOT' END AS gap_state, split_part(ref, '.', 1) AS target_schema_name,
     split_part(ref, '.', 2) AS target_object_name, CASE WHEN ref IS NOT NULL THEN 'INFERRED_PARSER' END AS proof_state FROM u""")
def sql_table_refs(spark, sf):
    return S.sql_table_refs(portable(spark, sf, STMT), "statement", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"])
