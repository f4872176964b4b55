"""Relationship discovery and its evidence tables bound to the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import profiling as P
from ..operators import relationships as J
from .base import Registry, items_text, load
from .estate import ctes, estate, portable

R = Registry()

LINKS = [  # child table, child column, parent table, parent column
    ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("labels", "doc_id", "documents", "doc_id"), ("orders", "o_orderkey", "lineitem", "l_orderkey"),
    ("customer", "c_nationkey", "supplier", "s_nationkey"),
]


def overlap_sql(a, x, b, y, head=""):
    sa, sb = a, b
    return (f"SELECT {head}(SELECT count({x}) FROM {sa}) AS source_non_null_count, (SELECT count(DISTINCT {x}) FROM {sa}) AS source_distinct_count, "
            f"(SELECT count({y}) FROM {sb}) AS target_non_null_count, (SELECT count(DISTINCT {y}) FROM {sb}) AS target_distinct_count, "
            f"(SELECT count(*) FROM (SELECT DISTINCT {x} AS v FROM {sa} INTERSECT SELECT DISTINCT {y} AS v FROM {sb}) WHERE v IS NOT NULL) AS matched_distinct_count")


@R.add("relationship_overlap_bounded", overlap_sql("orders", "o_custkey", "customer", "c_custkey"))
def overlap_bounded(spark, sf):
    o, c = load(spark, sf, "orders", "customer")
    return J.relationship_overlap(o, "o_custkey", c, "c_custkey")


@R.add("relationship_overlap_full", overlap_sql("lineitem", "l_orderkey", "orders", "o_orderkey"))
def overlap_full(spark, sf):
    l, o = load(spark, sf, "lineitem", "orders")
    return J.relationship_overlap(l, "l_orderkey", o, "o_orderkey")


_PAIRS = "(" + " UNION ALL ".join(overlap_sql(a, x, b, y, f"'{a}.{x}' AS source_id, '{b}.{y}' AS target_id, ") for a, x, b, y in LINKS) + ")"


def _all_pairs(spark, sf):
    names = sorted({t for l in LINKS for t in (l[0], l[2])})
    tabs = dict(zip(names, load(spark, sf, *names)))
    cols = sorted({(l[0], l[1]) for l in LINKS} | {(l[2], l[3]) for l in LINKS})
    pairs = spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(f"{a}.{x}").alias("source_id"), F.lit(f"{b}.{y}").alias("target_id")) for a, x, b, y in LINKS])))
    return J.overlap_all_pairs(J.column_values(tabs, cols), pairs)


@R.add("relationship_overlap_pairs", "SELECT * FROM " + _PAIRS)
def overlap_pairs(spark, sf):
    return _all_pairs(spark, sf)


_METRICS = f"""(SELECT *, CASE WHEN NOT eligible THEN 'LOW' WHEN overlap_bps >= 9500 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence,
  source_distinct_count > 0 AND target_duplicate_count = 0 AND unmatched_distinct_count = 0 AS link_eligible FROM (
  SELECT *, source_distinct_count > 0 AND overlap_bps >= 9000 AS eligible FROM (SELECT *,
   CASE WHEN source_distinct_count = 0 THEN 0 ELSE matched_distinct_count * 10000 // source_distinct_count END AS overlap_bps,
   CASE WHEN target_distinct_count = 0 THEN 0 ELSE matched_distinct_count * 10000 // target_distinct_count END AS target_coverage_bps,
   target_non_null_count - target_distinct_count AS target_duplicate_count, source_distinct_count - matched_distinct_count AS unmatched_distinct_count FROM {_PAIRS})))"""


@R.add("overlap_metrics", f"""SELECT *, CASE WHEN link_eligible THEN 'PROPOSAL_ONLY' ELSE 'COUNTEREVIDENCE_ONLY' END AS status,
  concat_ws(';', CASE WHEN target_duplicate_count > 0 THEN 'TARGET_NOT_UNIQUE=' || target_duplicate_count END,
   CASE WHEN unmatched_distinct_count > 0 THEN 'SOURCE_VALUES_UNMATCHED=' || unmatched_distinct_count END,
   CASE WHEN source_distinct_count = 0 THEN 'SOURCE_HAS_NO_DISTINCT_VALUES=0' END) AS counterevidence FROM {_METRICS}""")
def overlap_metrics(spark, sf):
    return J.overlap_metrics(_all_pairs(spark, sf)).withColumn("counterevidence", items_text("counterevidence"))


@R.add("relationship_status", f"SELECT source_id, target_id, CASE WHEN link_eligible THEN 'PROPOSAL_ONLY' ELSE 'COUNTEREVIDENCE_ONLY' END AS status FROM {_METRICS}")
def relationship_status(spark, sf):
    return J.overlap_metrics(_all_pairs(spark, sf)).select("source_id", "target_id", "status")


# --- candidate pairs over the derived estate: suppliers are schemas, so names and types do repeat ------
PAIR_TEXTS = {
    "pc_profiled": """SELECT 'SCH_' || CAST(l_suppkey AS STRING) AS schema_name, 'R_' || CAST(l_partkey AS STRING) AS relation_name,
       'k' || CAST(l_linenumber AS STRING) || '_' || CAST(l_partkey % 50 AS STRING) AS column_name, MAX(CASE WHEN l_linenumber > 4 THEN 'int8' ELSE 'text' END) AS native_type
       FROM {lineitem} WHERE l_returnflag <> 'N' GROUP BY l_suppkey, l_partkey, l_linenumber""",
    "pc_constraints": """SELECT 'SCH_' || CAST(l_suppkey AS STRING) AS schema_name, 'R_' || CAST(l_partkey AS STRING) AS relation_name,
       'c_' || l_returnflag || l_linestatus AS constraint_name,
       CASE WHEN l_returnflag = 'A' THEN 'PRIMARY_KEY' WHEN l_linestatus = 'O' THEN 'UNIQUE' ELSE 'FOREIGN_KEY' END AS constraint_kind,
       'k' || CAST(l_linenumber AS STRING) || '_' || CAST(l_partkey % 50 AS STRING) AS column_name,
       'SCH_' || CAST(l_suppkey AS STRING) AS referenced_schema_name, 'R_' || CAST(l_partkey + 50 AS STRING) AS referenced_relation_name,
       'k' || CAST(l_linenumber AS STRING) || '_' || CAST(l_partkey % 50 AS STRING) AS referenced_column_name FROM {lineitem} WHERE l_discount <= 0.02""",
}


@R.add("candidate_pairs", ctes("pc_profiled", "pc_constraints", texts=PAIR_TEXTS) + """, single AS (
   SELECT schema_name, relation_name, constraint_name, constraint_kind, max(column_name) AS column_name FROM pc_constraints
   WHERE constraint_kind IN ('PRIMARY_KEY', 'UNIQUE') GROUP BY ALL HAVING count(*) = 1)
  , tgt AS (SELECT s.*, p.native_type FROM single s JOIN pc_profiled p USING (schema_name, relation_name, column_name))
  SELECT p.schema_name AS source_schema_name, p.relation_name AS source_relation_name, t.schema_name AS target_schema_name, t.relation_name AS target_relation_name,
   p.column_name, p.native_type, t.constraint_kind, t.constraint_name FROM pc_profiled p JOIN tgt t ON p.column_name = t.column_name AND p.native_type = t.native_type
   WHERE (p.schema_name, p.relation_name) <> (t.schema_name, t.relation_name)
   AND NOT EXISTS (SELECT 1 FROM pc_constraints f WHERE f.constraint_kind = 'FOREIGN_KEY' AND f.schema_name = p.schema_name AND f.relation_name = p.relation_name
     AND f.column_name = p.column_name AND f.referenced_schema_name = t.schema_name AND f.referenced_relation_name = t.relation_name AND f.referenced_column_name = t.column_name)""")
def candidate_pairs(spark, sf):
    p, c = portable(spark, sf, PAIR_TEXTS["pc_profiled"]), portable(spark, sf, PAIR_TEXTS["pc_constraints"])
    return J.candidate_pairs(p, c)


_CAND = LINKS + [("customer", "c_custkey", "orders", "o_custkey"), ("part", "p_partkey", "lineitem", "l_partkey"), ("lineitem", "l_linenumber", "supplier", "s_suppkey"), ("supplier", "s_suppkey", "lineitem", "l_linenumber"),
                 ("documents", "doc_id", "labels", "doc_id"), ("orders", "o_orderkey", "customer", "c_custkey"), ("events", "user_id", "documents", "doc_id"), ("region", "r_regionkey", "nation", "n_regionkey")]


def _inclusion_sql(a, x, b, y):
    v = lambda t, c: f"(SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM {t} WHERE {c} IS NOT NULL)"
    return f"""SELECT '{a}.{x}' AS source_id, '{b}.{y}' AS target_id, CASE WHEN slo < dlo OR shi > dhi THEN 'OUT_OF_RANGE' WHEN sn > dn THEN 'MORE_DISTINCT_VALUES' WHEN missing > 0 THEN 'VALUE_MISSING' END AS reason, missing = 0 AS included
      FROM (SELECT min(v) AS slo, max(v) AS shi, count(*) AS sn FROM {v(a, x)}), (SELECT min(v) AS dlo, max(v) AS dhi, count(*) AS dn FROM {v(b, y)}), (SELECT count(*) AS missing FROM (SELECT v FROM {v(a, x)} EXCEPT SELECT v FROM {v(b, y)}))"""


@R.add("inclusion_candidates", " UNION ALL ".join(_inclusion_sql(*p) for p in _CAND))
def inclusion_candidates(spark, sf):
    """Which columns lie inside which: pairs refuted by sketches, the rest by their values. The sample's reason counts as the values'."""
    names = sorted({t for p in _CAND for t in (p[0], p[2])})
    tabs = dict(zip(names, load(spark, sf, *names)))
    cols = sorted({(p[0], p[1]) for p in _CAND} | {(p[2], p[3]) for p in _CAND})
    pairs = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(f"{a}.{x}").alias("source_id"), F.lit(f"{b}.{y}").alias("target_id")) for a, x, b, y in _CAND])))
    got = J.inclusions(J.column_values(tabs, cols), pairs)
    return got.select("source_id", "target_id", F.coalesce("refuted_by", F.when(~F.col("included"), "VALUE_MISSING")).alias("reason"), "included")


LINK_TEXTS = {  # a customer is a database; the tables of its orders are named after what was bought
    "il_columns": """SELECT DISTINCT 'DB_' || CAST(o_custkey AS STRING) AS scope,
       CASE l_suppkey % 4 WHEN 0 THEN 'Categories' WHEN 1 THEN 'sales_orders' WHEN 2 THEN 'customers' ELSE 'items_' || l_returnflag END AS table_name,
       CASE l_linenumber WHEN 1 THEN 'id' WHEN 2 THEN 'order_id' WHEN 3 THEN 'Category_ID' WHEN 4 THEN 'customer_id' WHEN 5 THEN 'items_n_id' ELSE 'note' END AS column_name,
       CASE l_linenumber WHEN 6 THEN TRUE ELSE FALSE END AS is_key FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "il_declared": """SELECT DISTINCT 'DB_' || CAST(o_custkey AS STRING) AS scope, 'customers' AS from_table, 'order_id' AS from_column, 'sales_orders' AS to_table, 'id' AS to_column
       FROM {orders} WHERE o_orderstatus = 'F'""",
}


@R.add("inferred_links", ctes("il_columns", "il_declared", texts=LINK_TEXTS) + r""", t AS (SELECT scope, table_name, bool_or(is_key OR lower(column_name) = 'id') AS k,
    regexp_replace(regexp_replace(lower(table_name), 'ies$', 'y'), 's$', '') AS ts FROM il_columns GROUP BY ALL),
  l AS (SELECT scope, table_name, column_name, regexp_replace(regexp_replace(regexp_replace(lower(column_name), '_id$', ''), 'ies$', 'y'), 's$', '') AS stem
    FROM il_columns WHERE regexp_matches(lower(column_name), '_id$'))
  SELECT 'inferred_key_name' AS kind, l.scope, l.table_name AS from_table, l.column_name AS from_column, t.table_name AS to_table, 'id' AS to_column,
   0.65::DOUBLE AS confidence, 'name-pattern:' || l.column_name AS evidence FROM l JOIN t ON l.scope = t.scope AND l.table_name <> t.table_name AND t.k AND (stem = ts OR ends_with(ts, stem))
  WHERE NOT EXISTS (SELECT 1 FROM il_declared d WHERE d.scope = l.scope AND d.from_table = l.table_name AND d.from_column = l.column_name AND d.to_table = t.table_name AND d.to_column = 'id')""")
def inferred_links(spark, sf):
    return J.inferred_links(portable(spark, sf, LINK_TEXTS["il_columns"]), portable(spark, sf, LINK_TEXTS["il_declared"]))


@R.add("declared_links", ctes("e_constraints") + """SELECT 'declared_foreign_key' AS kind, schema_name AS scope, relation_name AS from_table, column_name AS from_column,
   referenced_relation_name AS to_table, referenced_column_name AS to_column, 1.0::DOUBLE AS confidence, 'pragma:' || relation_name || ':' || constraint_name AS evidence
   FROM e_constraints WHERE constraint_kind = 'FOREIGN_KEY'""")
def declared_links(spark, sf):
    return J.declared_links(estate(spark, sf, "constraints"))


@R.add("orphan_values", "SELECT doc_id AS orphan_value, count(*) AS row_count FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en') GROUP BY 1")
def orphan_values(spark, sf):
    l, d = load(spark, sf, "labels", "documents")
    return J.orphan_values(l, "doc_id", d.filter("lang = 'en'"), "doc_id")


@R.add("orphan_probe", """SELECT 'orphan_probe' AS test, 'orders.o_custkey->customer.c_custkey' AS relationship, count(*) = 0 AS passed, count(*) AS orphan_rows,
    count(DISTINCT o_custkey) AS orphan_values FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def orphan_probe(spark, sf):
    o, c = load(spark, sf, "orders", "customer")
    return J.orphan_probe(o, "o_custkey", c, "c_custkey", "orders.o_custkey->customer.c_custkey")


COVER_TEXTS = {
    "tc_targets": """SELECT CAST(l_orderkey AS STRING) || '/' || CAST(l_partkey AS STRING) || '/' || CAST(l_suppkey AS STRING) || '/' || CAST(l_linenumber AS STRING) AS target_id,
       CASE WHEN l_linenumber <= 3 THEN 'RELATIONSHIP' ELSE 'COLUMN' END AS kind, l_returnflag AS schema_name, 'R_' || CAST(l_partkey AS STRING) AS relation_name,
       'c' || CAST(l_linenumber AS STRING) AS column_name, l_linestatus AS dst_schema_name, 'S_' || CAST(l_suppkey AS STRING) AS dst_relation_name, 'id' AS dst_column_name FROM {lineitem}""",
    "tc_cover": """SELECT l_returnflag AS schema_name, 'R_' || CAST(l_partkey AS STRING) AS relation_name, 'c' || CAST(l_linenumber AS STRING) AS column_name,
       CASE WHEN SUM(l_quantity) > 60 THEN 'COMPLETE' WHEN SUM(l_quantity) > 30 THEN 'PARTIAL' ELSE 'DENIED' END AS state FROM {lineitem}
       WHERE l_discount > 0.02 GROUP BY l_returnflag, l_partkey, l_linenumber
       UNION ALL SELECT l_linestatus, 'S_' || CAST(l_suppkey AS STRING), 'id', CASE WHEN MAX(l_tax) > 0.05 THEN 'COMPLETE' ELSE 'PARTIAL' END FROM {lineitem} GROUP BY l_linestatus, l_suppkey""",
}


@R.add("target_coverage", ctes("tc_targets", "tc_cover", texts=COVER_TEXTS) + """, e AS (
   SELECT target_id, kind, schema_name, relation_name, column_name FROM tc_targets UNION ALL
   SELECT target_id, kind, dst_schema_name, dst_relation_name, dst_column_name FROM tc_targets WHERE kind = 'RELATIONSHIP'),
  g AS (SELECT target_id, kind, count(state) AS covered, count(*) FILTER (WHERE state = 'COMPLETE') AS complete, CASE WHEN kind = 'RELATIONSHIP' THEN 2 ELSE 1 END AS need
   FROM e LEFT JOIN tc_cover USING (schema_name, relation_name, column_name) GROUP BY target_id, kind)
  SELECT target_id, kind, covered, complete, covered = need AS visible,
   CASE WHEN covered <> need THEN 'TARGET_NOT_VISIBLE' WHEN complete < need THEN 'TARGET_COVERAGE_DENIED' ELSE 'ALLOWED' END AS verdict FROM g""")
def target_coverage(spark, sf):
    return J.target_coverage(portable(spark, sf, COVER_TEXTS["tc_targets"]), portable(spark, sf, COVER_TEXTS["tc_cover"]))


# --- evidence tables ----------------------------------------------------------------------------------
_PROFILED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
_PROF = "(" + " UNION ALL ".join(
    f"SELECT 'orders.{x}' AS target_id, count(*) AS row_count, count(*) - count({x}) AS null_count, count(DISTINCT {x}) AS distinct_count FROM orders" for x in _PROFILED) + ")"


def _hash_sql(**fields):
    parts = ", ".join(f"'{k}=' || coalesce(CAST({v} AS VARCHAR), chr(0) || 'null')" for k, v in sorted(fields.items()))
    return f"sha256(concat_ws(chr(31), 'v2', {parts}))"


_STORE = f"""(WITH m AS (SELECT *, {_hash_sql(source_id='source_id', target_id='target_id', source_non_null_count='source_non_null_count',
   source_distinct_count='source_distinct_count', target_distinct_count='target_distinct_count', matched_distinct_count='matched_distinct_count')} AS obs FROM {_METRICS}),
  m2 AS (SELECT *, {_hash_sql(_obs='obs', overlap_bps='overlap_bps', target_coverage_bps='target_coverage_bps', eligible='eligible', confidence='confidence')} AS cmp FROM m),
  m3 AS (SELECT *, {_hash_sql(_obs='obs', _cmp='cmp', source_id='source_id', target_id='target_id', confidence='confidence', overlap_bps='overlap_bps')} AS cand FROM m2)
  SELECT {_hash_sql(target_id='target_id', row_count='row_count', null_count='null_count', distinct_count='distinct_count')} AS evidence_id, 'COLUMN_PROFILE' AS fact_kind,
    'OBSERVED' AS observation_kind, target_id AS source_id, NULL AS target_id, NULL AS confidence, NULL AS confidence_bps FROM {_PROF}
  UNION ALL SELECT obs, 'RELATIONSHIP_OVERLAP', 'OBSERVED', source_id, target_id, NULL, NULL FROM m3
  UNION ALL SELECT cmp, 'RELATIONSHIP_SCORE', 'COMPUTED', source_id, target_id, confidence, NULL FROM m3
  UNION ALL SELECT cand, 'RELATIONSHIP_CANDIDATE', 'INFERRED', source_id, target_id, confidence, overlap_bps FROM m3 WHERE eligible)"""


def _profiles(spark, sf):
    p = P.profile_table(load(spark, sf, "orders"), _PROFILED)
    return p.withColumn("target_id", F.concat(F.lit("orders."), "column_name"))


def _store(spark, sf):
    return E.evidence_store(_profiles(spark, sf), J.overlap_metrics(_all_pairs(spark, sf)))


@R.add("evidence_store", "SELECT * FROM " + _STORE)
def evidence_store(spark, sf):
    return _store(spark, sf)


@R.add("review_steps", f"""SELECT *, {_hash_sql(action='action', source_id='source_id', target_id='target_id', confidence='confidence', evidence_id='evidence_id',
     review_state='review_state', execution_authority='execution_authority')} AS step_sha256 FROM (SELECT
   CASE WHEN fact_kind = 'COLUMN_PROFILE' THEN 'REVIEW_COLUMN_PROFILE' ELSE 'REVIEW_RELATIONSHIP_CANDIDATE' END AS action, source_id, target_id, confidence, evidence_id,
   'REVIEW_REQUIRED' AS review_state, 'NONE' AS execution_authority FROM {_STORE} WHERE fact_kind IN ('COLUMN_PROFILE', 'RELATIONSHIP_CANDIDATE'))""")
def review_steps(spark, sf):
    return E.review_steps(_store(spark, sf))


@R.add("report_summary", f"""SELECT p.*, o.*, profiled_columns + candidates AS plan_steps FROM (SELECT count(*) AS profiled_columns, count(*) FILTER (WHERE null_count > 0) AS columns_with_nulls FROM {_PROF}) p,
   (SELECT count(*) AS evaluated_pairs, count(*) FILTER (WHERE eligible) AS candidates, count(*) FILTER (WHERE confidence = 'HIGH') AS high_confidence_candidates,
    count(*) FILTER (WHERE NOT eligible) AS low_confidence_rejected FROM {_METRICS}) o""")
def report_summary(spark, sf):
    return E.report_summary(_profiles(spark, sf), J.overlap_metrics(_all_pairs(spark, sf)))


@R.add("report_blind_spots", """SELECT o_custkey AS source_id, concat_ws(',', CASE WHEN max(n) >= 6 THEN 'profiles-are-bounded-samples-not-full-population' END,
    CASE WHEN sum(links) = 0 THEN 'no-declared-foreign-keys' END, CASE WHEN sum(kpis) = 0 THEN 'kpi-semantics-require-user-confirmation' END) AS blind_spots FROM (
   SELECT o_custkey, o_orderkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'F') AS links, count(*) FILTER (WHERE l_discount >= 0.09) AS kpis
   FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL) GROUP BY 1""")
def report_blind_spots(spark, sf):
    l, o = load(spark, sf, "lineitem", "orders")
    t = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("source_id"), "o_orderkey").agg(
        F.count(F.lit(1)).alias("sampled_rows"), F.count_if((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).alias("declared_links"),
        F.count_if(F.col("l_discount") >= 0.09).alias("kpis"))
    return E.report_blind_spots(t, 6, ["source_id"]).withColumn("blind_spots", F.array_join("blind_spots", ","))


@R.add("candidate_counts", f"SELECT fact_kind, count(*) AS n FROM {_STORE} GROUP BY 1")
def candidate_counts(spark, sf):
    return E.candidate_counts(_store(spark, sf), "fact_kind")


@R.add("dangling_refs", f"""SELECT DISTINCT 'e' || event_id AS item_id, ref AS evidence_ref FROM (SELECT event_id, unnest(['u' || user_id, 'u' || (user_id + 120), 'p' || CAST(floor(value) AS BIGINT)]) AS ref FROM events)
   WHERE ref NOT IN (SELECT 'u' || user_id FROM events) AND ref NOT IN (SELECT 'p' || p_partkey FROM part WHERE p_size > 10)""")
def dangling_refs(spark, sf):
    e, p = load(spark, sf, "events", "part")
    items = e.select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("item_id"), F.array(
        F.concat(F.lit("u"), F.col("user_id").cast("string")), F.concat(F.lit("u"), (F.col("user_id") + 120).cast("string")),
        F.concat(F.lit("p"), F.floor("value").cast("string"))).alias("refs"))
    known = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id")).unionByName(
        p.filter("p_size > 10").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id")))
    return E.dangling_refs(items, "item_id", "refs", known, "id").distinct()


@R.add("control_binding", """WITH ev AS (SELECT 'e' || event_id AS evidence_id, 'k' || CAST(floor(value * 10) AS BIGINT) AS probe_key, event_type AS receipt_state FROM events),
  r AS (SELECT 'k' || p_partkey AS probe_key, count(*) AS rn FROM part GROUP BY 1), t AS (SELECT 'k' || o_custkey AS probe_key, count(*) AS tn,
   min(CASE o_orderstatus WHEN 'F' THEN 'view' WHEN 'O' THEN 'click' ELSE 'error' END) AS result_state FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
  SELECT evidence_id, probe_key, v AS violation FROM (SELECT *, CASE WHEN rn IS NULL THEN 'RESERVATION_MISSING' WHEN rn > 1 THEN 'RESERVATION_AMBIGUOUS' WHEN tn IS NULL THEN 'RECEIPT_MISSING'
   WHEN tn > 1 THEN 'RECEIPT_AMBIGUOUS' WHEN result_state <> receipt_state THEN 'STATE_MISMATCH' END AS v FROM ev LEFT JOIN r USING (probe_key) LEFT JOIN t USING (probe_key)) WHERE v IS NOT NULL""")
def control_binding(spark, sf):
    e, p, o = load(spark, sf, "events", "part", "orders")
    ev = e.select(F.expr("'e' || event_id").alias("evidence_id"), F.expr("'k' || floor(value * 10)").alias("probe_key"), F.col("event_type").alias("receipt_state"))
    rec = o.filter("o_orderpriority = '1-URGENT'").select(F.expr("'k' || o_custkey").alias("probe_key"),
        F.expr("case o_orderstatus when 'F' then 'view' when 'O' then 'click' else 'error' end").alias("result_state"))
    return E.control_binding(ev, p.select(F.expr("'k' || p_partkey").alias("probe_key")), rec)


@R.add("relationship_list", ctes("e_constraints", "e_stored", "e_dependencies") + """SELECT 'FOREIGN_KEY' AS relationship_kind, 'CATALOG_DECLARED' AS relationship_authority, false AS inferred,
    constraint_name AS relationship_name, schema_name AS from_schema_name, relation_name AS from_object_name, column_name AS from_column_name, referenced_schema_name AS to_schema_name,
    referenced_relation_name AS to_object_name, referenced_column_name AS to_column_name FROM e_constraints WHERE constraint_kind = 'FOREIGN_KEY'
   UNION ALL SELECT 'SYNONYM_TARGET', 'CATALOG_DECLARED', false, object_name, schema_name, object_name, NULL, status, coalesce(status, source_hash_sha256), NULL FROM e_stored
   UNION ALL SELECT native_dependency_kind, resolution_state, column_resolution_state = 'PROVEN', NULL, source_schema_name, source_object_name, NULL, target_schema_name, target_object_name, NULL FROM e_dependencies""")
def relationship_list(spark, sf):
    con, st, dep = estate(spark, sf, "constraints", "stored", "dependencies")
    syn = st.select("schema_name", F.col("object_name").alias("synonym_name"), F.col("status").alias("target_schema_name"),
                    F.col("status").alias("target_object_name"), F.col("source_hash_sha256").alias("target_reference"))
    d = dep.select(F.col("native_dependency_kind").alias("dependency_kind"), F.col("resolution_state").alias("relationship_authority"),
                   (F.col("column_resolution_state") == "PROVEN").alias("inferred"), "source_schema_name", F.col("source_object_name").alias("source_relation_name"),
                   "target_schema_name", F.col("target_object_name").alias("target_relation_name"))
    return E.relationship_list(con, syn, d)


@R.add("union_branches", ctes("e_constraints", "e_indexes") + """SELECT schema_name, relation_name, column_name, constraint_name, constraint_kind, NULL AS index_name, referenced_schema_name, referenced_relation_name, referenced_column_name
    FROM e_constraints UNION ALL SELECT schema_name, relation_name, column_name, NULL, NULL, index_name, NULL, NULL, NULL FROM e_indexes""")
def union_branches(spark, sf):
    return E.union_branches(*estate(spark, sf, "constraints", "indexes"))


@R.add("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def distinct_rows(spark, sf):
    return E.distinct_rows(load(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


@R.add("edge_dedup", "SELECT DISTINCT sha256(l_suppkey || '>' || l_partkey) AS edge_sha256, l_suppkey, l_partkey FROM lineitem")
def edge_dedup(spark, sf):
    e = load(spark, sf, "lineitem").select(F.sha2(F.expr("l_suppkey || '>' || l_partkey"), 256).alias("edge_sha256"), "l_suppkey", "l_partkey")
    return E.dedupe_edges(e)


@R.add("duplicate_hashes", "SELECT sha256(l_suppkey || '>' || l_partkey) AS edge_sha256, count(*) AS copies FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def duplicate_hashes(spark, sf):
    return E.duplicate_hashes(load(spark, sf, "lineitem").select(F.sha2(F.expr("l_suppkey || '>' || l_partkey"), 256).alias("edge_sha256")), "edge_sha256")


_DECIDE = """cand AS (SELECT sha256('c' || p_partkey) AS candidate_sha256, p_brand, p_type FROM part),
  dec AS (SELECT sha256('c' || ps) AS candidate_sha256, CASE WHEN q > 30 THEN 'APPROVED' ELSE 'REJECTED' END AS decision FROM
   (SELECT l_partkey AS ps, max(l_quantity) AS q FROM lineitem WHERE l_linestatus = 'F' AND l_discount = 0.1 GROUP BY 1
    UNION ALL SELECT l_partkey, 50 FROM lineitem WHERE l_discount = 0.0 AND l_tax = 0.0 AND l_linenumber = 1))"""


def _decisions(spark, sf):
    p, l = load(spark, sf, "part", "lineitem")
    cand = p.select(F.sha2(F.expr("'c' || p_partkey"), 256).alias("candidate_sha256"), "p_brand", "p_type")
    a = l.filter("l_linestatus = 'F' and l_discount = 0.1").groupBy("l_partkey").agg(F.max("l_quantity").alias("q"))
    b = l.filter("l_discount = 0.0 and l_tax = 0.0 and l_linenumber = 1").select("l_partkey", F.lit(50.0).alias("q"))
    d = a.unionByName(b).select(F.sha2(F.expr("'c' || l_partkey"), 256).alias("candidate_sha256"), F.expr("case when q > 30 then 'APPROVED' else 'REJECTED' end").alias("decision"))
    return cand, d


@R.add("curated_candidates", f"WITH {_DECIDE} SELECT cand.*, decision FROM cand JOIN (SELECT candidate_sha256, min(decision) AS decision FROM dec GROUP BY 1 HAVING count(*) = 1) USING (candidate_sha256) WHERE decision = 'APPROVED'")
def curated_candidates(spark, sf):
    return E.curated_candidates(*_decisions(spark, sf))


@R.add("undecided_candidates", f"WITH {_DECIDE} SELECT candidate_sha256, coalesce(n, 0) AS decisions FROM cand LEFT JOIN (SELECT candidate_sha256, count(*) AS n FROM dec GROUP BY 1) USING (candidate_sha256) WHERE coalesce(n, 0) <> 1")
def undecided_candidates(spark, sf):
    return E.undecided(*_decisions(spark, sf))
