"""Hashing, contracts, coverage, catalog questions and row rules over the derived estate."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import text as X
from ..operators import catalog as C
from ..operators import coverage as V
from ..operators import evidence as E
from ..operators import rules as U
from ..operators.disclosure import disclosure_walk as walk
from .base import Registry, load
from .estate import SOURCES, ctes, each_source, estate, one_source, portable, sources

R = Registry()

# --- hashing ------------------------------------------------------------------------------------------
_ORD = ["o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority", "o_orderstatus"]


def order_text_sql(cols=_ORD, prio="o_orderpriority"):
    def one(x):
        v = "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f')" if x == "o_orderdate" else prio if x == "o_orderpriority" else f"CAST({x} AS VARCHAR)"
        return f"'{x}=' || coalesce({v}, chr(0) || 'null')"
    return "concat_ws(chr(31), 'v2', " + ", ".join(one(x) for x in sorted(cols)) + ")"


@R.add("canonical_text", "SELECT o_orderkey, " + order_text_sql(prio="nullif(o_orderpriority, '4-NOT SPECIFIED')") + " AS canonical_text FROM orders")
def canonical_text(spark, sf):
    o = load(spark, sf, "orders").select(*_ORD).withColumn("o_orderpriority", F.expr("nullif(o_orderpriority, '4-NOT SPECIFIED')"))
    return o.select("o_orderkey", H.canonical(o).alias("canonical_text"))


@R.add("content_hash", "SELECT o_orderkey, sha256(" + order_text_sql() + ") AS object_sha256 FROM orders")
def content_hash(spark, sf):
    return H.with_hash(load(spark, sf, "orders").select(*_ORD)).select("o_orderkey", "object_sha256")


@R.add("text_hash", "SELECT doc_id, sha256('v2' || chr(31) || 'text=' || nfc_normalize(regexp_replace(text, '\\r\\n?', chr(10), 'g'))) AS object_sha256 FROM documents")
def text_hash(spark, sf):
    """Whole document texts, NFC and LF folded."""
    return H.with_hash(load(spark, sf, "documents"), ["text"]).select("doc_id", "object_sha256")


_FOLD = """, l0 AS (SELECT k, h AS p, h || ':' || count(*) AS v, count(*) AS n FROM rows_ GROUP BY k, h),
 l1 AS (SELECT k, substr(p, 1, 6) AS p, sha256(string_agg(v, ',' ORDER BY v)) AS d, sum(n) AS n FROM l0 GROUP BY 1, 2),
 l2 AS (SELECT k, substr(p, 1, 3) AS p, sha256(string_agg(p || ':' || d, ',' ORDER BY p || ':' || d)) AS d, sum(n) AS n FROM l1 GROUP BY 1, 2),
 l3 AS (SELECT k, sha256(string_agg(p || ':' || d, ',' ORDER BY p || ':' || d)) AS d, sum(n) AS n FROM l2 GROUP BY 1)"""


@R.add("table_digest", "WITH rows_ AS (SELECT o_orderstatus AS k, sha256(" + order_text_sql() + ") AS h FROM orders)" + _FOLD +
       " SELECT k AS o_orderstatus, CAST(n AS BIGINT) AS row_count, d AS digest_sha256 FROM l3")
def table_digest(spark, sf):
    return H.table_digest(H.with_hash(load(spark, sf, "orders").select(*_ORD)), ["o_orderstatus"])


@R.add("tamper_check", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '5-LOW'")
def tamper_check(spark, sf):
    o = H.with_hash(load(spark, sf, "orders").select(*_ORD))
    changed = o.withColumn("o_orderpriority", F.when(F.col("o_orderpriority") == "5-LOW", "0-NONE").otherwise(F.col("o_orderpriority")))
    return H.verify_hash(changed, _ORD).select("o_orderkey")


# --- contracts and scope --------------------------------------------------------------------------------
@R.add("contract_violations", ctes("e_extracts") + """SELECT snapshot_id, query_id, v AS violation FROM (SELECT *, unnest(list_filter([
   CASE WHEN state NOT IN ('SUCCEEDED','PARTIAL','DENIED','UNSUPPORTED','TIMEOUT','ERROR') THEN 'STATE_UNKNOWN' END,
   CASE WHEN state = 'SUCCEEDED' AND reason_code IS NOT NULL THEN 'REASON_ON_SUCCESS' END,
   CASE WHEN state <> 'SUCCEEDED' AND NOT coalesce(regexp_full_match(reason_code, '[A-Z][A-Z0-9_]{2,127}'), false) THEN 'REASON_MISSING' END,
   CASE WHEN state NOT IN ('SUCCEEDED','PARTIAL') AND row_count > 0 THEN 'ROWS_IN_INVISIBLE_STATE' END], lambda x: x IS NOT NULL)) AS v FROM e_extracts)""")
def contract_violations(spark, sf):
    return U.check_contract(estate(spark, sf, "extracts")).select("snapshot_id", "query_id", "violation")


_SCOPE = "SELECT 'SCH_' || c_custkey AS schema_name FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')"


def _scope(spark, sf):
    return load(spark, sf, "customer").filter("c_mktsegment in ('BUILDING', 'MACHINERY')").select(F.expr("'SCH_' || c_custkey").alias("schema_name"))


@R.add("scope_filter", ctes("e_relations") + f"SELECT * FROM e_relations WHERE schema_name IN ({_SCOPE})")
def scope_filter(spark, sf):
    return U.in_scope(estate(spark, sf, "relations"), _scope(spark, sf))


_AMB = """SELECT CASE WHEN s_acctbal < 0 THEN 'db_owner' WHEN s_acctbal < 2000 THEN 'guest' WHEN s_acctbal < 3000 THEN 'db_datareader' ELSE 'SCH_' || CAST(s_suppkey AS STRING) END AS schema_name, s_suppkey FROM {supplier}"""


@R.add("ambient_schemas", "WITH a AS (" + _AMB.format(supplier="supplier") + ") SELECT * FROM a WHERE schema_name NOT IN ('db_owner', 'db_datareader')")
def ambient_schemas(spark, sf):
    a = portable(spark, sf, _AMB)
    return U.drop_ambient(a, a.filter("schema_name = 'guest'"))


@R.add("scope_violations", ctes("e_constraints") + f"""SELECT constraint_name, column_name, 'OUT_OF_SCOPE' AS violation FROM e_constraints WHERE schema_name NOT IN ({_SCOPE})
   UNION ALL SELECT constraint_name, column_name, 'REFERENCE_OUT_OF_SCOPE' FROM e_constraints WHERE referenced_schema_name NOT IN ({_SCOPE})""")
def scope_violations(spark, sf):
    return U.scope_violations(estate(spark, sf, "constraints"), _scope(spark, sf)).select("constraint_name", "column_name", "violation")


@R.add("allowed_targets", ctes("e_columns", "e_comments", "e_constraints") + """SELECT schema_name, relation_name, column_name, CASE
   WHEN (schema_name, relation_name, column_name) IN (SELECT (schema_name, relation_name, column_name) FROM e_constraints WHERE constraint_kind = 'FOREIGN_KEY') THEN 'SENSITIVE_DENIED'
   WHEN (schema_name, relation_name, column_name) IN (SELECT (schema_name, relation_name, column_name) FROM e_comments) THEN 'ALLOWED' ELSE 'NOT_ALLOWLISTED' END AS verdict FROM e_columns""")
def allowed_targets(spark, sf):
    cols, com, con = estate(spark, sf, "columns", "comments", "constraints")
    return U.allowed_targets(cols.select(*U.TARGET_KEYS), com, con.filter("constraint_kind = 'FOREIGN_KEY'"))


@R.add("type_family", ctes("e_columns") + """SELECT schema_name, relation_name, column_name, data_type, CASE WHEN data_type IN ('int4', 'numeric') THEN 'NUMERIC' WHEN data_type = 'varchar' THEN 'TEXT' WHEN data_type = 'timestamp' THEN 'TEMPORAL' END AS family,
   CASE WHEN data_type IN ('int4', 'numeric') THEN 'numeric' WHEN data_type = 'timestamp' THEN 'temporal' WHEN data_type = 'varchar' THEN 'text' END AS declared_family FROM e_columns""")
def type_family(spark, sf):
    return estate(spark, sf, "columns").select(
        "schema_name", "relation_name", "column_name", "data_type", U.type_family("data_type").alias("family"), U.declared_family("data_type").alias("declared_family"))


@R.add("budget_check", ctes("e_extracts") + """SELECT snapshot_id, queries, largest_query, total_rows, concat_ws(',', CASE WHEN queries > 70 THEN 'QUERIES' END, CASE WHEN largest_query > 88 THEN 'ROWS_PER_QUERY' END,
    CASE WHEN total_rows > 1500 THEN 'TOTAL_ROWS' END) AS exceeded, queries <= 70 AND largest_query <= 88 AND total_rows <= 1500 AS within_budget FROM
   (SELECT snapshot_id, count(*) AS queries, max(row_count) AS largest_query, CAST(sum(row_count) AS BIGINT) AS total_rows FROM e_extracts GROUP BY 1)""")
def budget_check(spark, sf):
    return V.budget_check(estate(spark, sf, "extracts"), 70, 88, 1500).withColumn("exceeded", F.array_join("exceeded", ","))


@R.add("object_ref", ctes("e_relations", "e_columns", "e_sizes", "e_arguments", "e_dependencies") + """SELECT 'relations' AS category, schema_name, relation_name, NULL AS column_name, relation_name AS object_name FROM e_relations
   UNION ALL SELECT 'columns', schema_name, relation_name, column_name, column_name FROM e_columns UNION ALL SELECT 'sizes', schema_name, NULL, NULL, segment_name FROM e_sizes
   UNION ALL SELECT 'stored-arguments', schema_name, NULL, NULL, argument_name FROM e_arguments
   UNION ALL SELECT 'stored-dependencies', source_schema_name, NULL, NULL, source_object_name FROM e_dependencies""")
def object_ref(spark, sf):
    names = {"relations": "relations", "columns": "columns", "sizes": "sizes", "arguments": "stored-arguments", "dependencies": "stored-dependencies"}
    return E.union_branches(*[U.object_ref(estate(spark, sf, k), v) for k, v in names.items()])


# --- coverage -------------------------------------------------------------------------------------------
_STATES = ["SUCCEEDED", "PARTIAL", "DENIED", "UNSUPPORTED", "TIMEOUT", "ERROR"]


def _sc(states):
    return ", ".join(f"count(*) FILTER (WHERE state = '{s}') AS {s.lower()}_count" for s in states)


_VIS = """CASE state WHEN 'SUCCEEDED' THEN 'VISIBLE_COMPLETE' WHEN 'PARTIAL' THEN 'VISIBLE_PARTIAL' WHEN 'DENIED' THEN 'INVISIBLE' WHEN 'UNSUPPORTED' THEN 'NOT_APPLICABLE' ELSE 'UNKNOWN' END AS visibility,
   CASE WHEN state = 'SUCCEEDED' AND row_count = 0 THEN 'VERIFIED_EMPTY' ELSE 'NOT_CLAIMED' END AS empty_interpretation"""


@R.add("coverage_ledger", ctes("e_extracts") + f"""SELECT snapshot_id, count(*) AS total_queries, {_sc(_STATES)}, count(*) FILTER (WHERE state = 'SUCCEEDED') AS complete_queries,
   count(*) FILTER (WHERE state = 'PARTIAL') AS partial_queries, count(*) FILTER (WHERE state IN ('DENIED', 'TIMEOUT', 'ERROR')) AS invisible_or_unknown_queries,
   count(*) FILTER (WHERE state = 'SUCCEEDED' AND row_count = 0) AS verified_empty_queries, bool_and(state = 'SUCCEEDED') AS all_complete FROM e_extracts GROUP BY 1""")
def coverage_ledger(spark, sf):
    return V.coverage_ledger(estate(spark, sf, "extracts"))


@R.add("profiling_coverage", ctes("e_extracts") + f""", a AS (SELECT snapshot_id, CASE state WHEN 'ERROR' THEN 'TAMPER' ELSE state END AS state FROM e_extracts)
   SELECT snapshot_id, count(*) AS total_attempts, {_sc(['SUCCEEDED', 'PARTIAL', 'DENIED', 'UNSUPPORTED', 'TIMEOUT', 'TAMPER'])}, count(*) FILTER (WHERE state = 'SUCCEEDED') AS complete_attempts,
   count(*) FILTER (WHERE state = 'PARTIAL') AS partial_attempts, count(*) FILTER (WHERE state <> 'SUCCEEDED') AS non_claimed_attempts FROM a GROUP BY 1""")
def profiling_coverage(spark, sf):
    return V.profiling_coverage(estate(spark, sf, "extracts").withColumn("state", F.expr("case state when 'ERROR' then 'TAMPER' else state end")))


_OBJ = """SELECT 'SNAP_' || CAST(o_custkey AS STRING) AS snapshot_id, 'T_' || CAST(o_orderkey AS STRING) AS object_name, 'q.' || CASE o_orderstatus WHEN 'F' THEN 'view' WHEN 'O' THEN 'click' ELSE 'error' END AS query_id FROM {orders}"""
_LED = """SELECT snapshot_id, query_id, state, CASE WHEN state = 'SUCCEEDED' THEN NULL ELSE 'WHY_' || state END AS reason_code FROM (SELECT 'SNAP_' || CAST(user_id AS STRING) AS snapshot_id, 'q.' || event_type AS query_id,
   CASE WHEN MIN(value) < 0.5 THEN 'DENIED' WHEN MIN(value) < 1 THEN 'TIMEOUT' WHEN MIN(value) < 1.5 THEN 'PARTIAL' WHEN MIN(value) < 2 THEN 'UNSUPPORTED' ELSE 'SUCCEEDED' END AS state FROM {events} GROUP BY user_id, event_type)"""
_OC = "WITH o AS (" + _OBJ.format(orders="orders") + "), l AS (" + _LED.format(events="events") + """), c AS (SELECT snapshot_id, query_id, object_name,
   CASE WHEN state = 'SUCCEEDED' THEN 'COMPLETE' WHEN state IN ('PARTIAL', 'DENIED', 'UNSUPPORTED') THEN state ELSE 'UNKNOWN' END AS state, reason_code FROM o LEFT JOIN l USING (snapshot_id, query_id))"""


@R.add("object_coverage", _OC + " SELECT * FROM c")
def object_coverage(spark, sf):
    return V.object_coverage(portable(spark, sf, _OBJ), portable(spark, sf, _LED))


@R.add("coverage_gate", _OC + f""" SELECT *, CASE WHEN coverage_bps >= 9500 THEN 'THRESHOLD' ELSE 'BLOCKED' END AS breadth_gate FROM (SELECT snapshot_id, count(*) AS visible_objects,
   count(*) FILTER (WHERE state <> 'UNKNOWN') AS classified_objects, {_sc(['COMPLETE', 'PARTIAL', 'DENIED', 'UNSUPPORTED', 'UNKNOWN'])},
   count(*) FILTER (WHERE state <> 'UNKNOWN') * 10000 // count(*) AS coverage_bps FROM c GROUP BY 1)""")
def coverage_gate(spark, sf):
    return V.coverage_gate(V.object_coverage(portable(spark, sf, _OBJ), portable(spark, sf, _LED)))


@R.add("blind_spots", ctes("e_extracts") + f"""SELECT 'PACK_' || p_brand AS code, p_type AS description, 'QUERY_PACK_DECLARATION' AS source, NULL AS snapshot_id, NULL AS query_id, NULL AS coverage_state, NULL AS reason_code
   FROM (SELECT DISTINCT p_brand, p_type FROM part) UNION ALL SELECT 'QUERY_' || state, '{V.BLIND_TEXT}', 'COVERAGE_LEDGER', snapshot_id, query_id, state, reason_code FROM e_extracts WHERE state <> 'SUCCEEDED'""")
def blind_spots(spark, sf):
    d = load(spark, sf, "part").select(F.expr("'PACK_' || p_brand").alias("code"), F.col("p_type").alias("description")).distinct()
    return V.blind_spots(d, estate(spark, sf, "extracts"))


_CAV = """CASE WHEN state = 'SUCCEEDED' AND row_count = 0 THEN 'Collector succeeded with verified empty metadata for its bounded scope.' WHEN state = 'SUCCEEDED' THEN 'Collector succeeded for its bounded scope.'
  WHEN state = 'PARTIAL' THEN 'Collector returned partial metadata; do not treat omissions as absence.' WHEN state = 'DENIED' THEN 'Collector was denied; evidence is invisible, not absent.'
  WHEN state = 'TIMEOUT' THEN 'Collector timed out; evidence is unknown.' WHEN state = 'ERROR' THEN 'Collector errored; evidence is unknown.'
  ELSE 'Collector state is not interpreted as object absence.' END AS caveat"""


@R.add("coverage_rows", ctes("e_extracts") + f"SELECT *, {_VIS}, {_CAV} FROM e_extracts")
def coverage_rows(spark, sf):
    return V.coverage_rows(estate(spark, sf, "extracts"))


# --- overviews --------------------------------------------------------------------------------------------
CATS = {"relations": "relations", "columns": "columns", "comments": "comments", "stored": "stored-objects", "arguments": "stored-arguments", "errors": "stored-errors"}


def _facts(spark, sf):
    return C.facts({v: estate(spark, sf, k) for k, v in CATS.items()})


_OV = """(SELECT schema_name, CAST(sum(r) AS BIGINT) AS relation_count, CAST(sum(c) AS BIGINT) AS column_count, CAST(sum(s) AS BIGINT) AS stored_object_count, CAST(sum(i) AS BIGINT) AS invalid_object_count, CAST(sum(e) AS BIGINT) AS compile_issue_count FROM (
   SELECT schema_name, 1 AS r, 0 AS c, 0 AS s, 0 AS i, 0 AS e FROM e_relations UNION ALL SELECT schema_name, 0, 1, 0, 0, 0 FROM e_columns UNION ALL
   SELECT schema_name, 0, 0, 1, CASE WHEN status <> 'VALID' THEN 1 ELSE 0 END, 0 FROM e_stored UNION ALL SELECT schema_name, 0, 0, 0, 0, 1 FROM e_errors UNION ALL
   SELECT schema_name, 0, 0, 0, 0, 0 FROM e_comments UNION ALL SELECT schema_name, 0, 0, 0, 0, 0 FROM e_arguments) GROUP BY 1)"""
_OVC = ctes("e_relations", "e_columns", "e_stored", "e_errors", "e_comments", "e_arguments")


@R.add("schema_summary", _OVC[:-1] + ", " + ctes("e_extracts")[5:] + f"""SELECT *, (SELECT count(*) FILTER (WHERE state IN ('DENIED', 'TIMEOUT', 'ERROR', 'PARTIAL')) FROM e_extracts) AS denied_unknown_count,
    (SELECT bool_and(state = 'SUCCEEDED') FROM e_extracts) AS all_complete FROM {_OV}""")
def schema_summary(spark, sf):
    return C.schema_summary({v: estate(spark, sf, k) for k, v in CATS.items()}, estate(spark, sf, "extracts"))


@R.add("schema_overview", _OVC + "SELECT * FROM " + _OV)
def schema_overview(spark, sf):
    return C.schema_overview(_facts(spark, sf))


_CAPC = ctes("e_relations", "e_columns", "e_constraints", "e_indexes", "e_statistics", "e_sizes")
_CAP = """(SELECT r.schema_name, r.relation_name, r.relation_kind,
   (SELECT count(*) FROM e_columns c WHERE upper(c.schema_name) = upper(r.schema_name) AND upper(c.relation_name) = upper(r.relation_name)) AS column_count,
   (SELECT count(*) FROM e_constraints c WHERE upper(c.schema_name) = upper(r.schema_name) AND upper(c.relation_name) = upper(r.relation_name)) AS constraint_count,
   (SELECT count(*) FROM e_indexes c WHERE upper(c.schema_name) = upper(r.schema_name) AND upper(c.relation_name) = upper(r.relation_name)) AS index_count,
   num_rows_estimate, last_analyzed, stale_stats, bytes, blocks, size_semantics, row_count_semantics FROM e_relations r
   LEFT JOIN e_statistics s ON upper(s.schema_name) = upper(r.schema_name) AND upper(s.relation_name) = upper(r.relation_name)
   LEFT JOIN e_sizes z ON upper(z.schema_name) = upper(r.schema_name) AND upper(z.segment_name) = upper(r.relation_name))"""


def _capacity(spark, sf):
    return C.table_capacity(*estate(spark, sf, "relations", "columns", "constraints", "indexes", "statistics", "sizes"))


@R.add("table_capacity", _CAPC + "SELECT * FROM " + _CAP)
def table_capacity(spark, sf):
    return _capacity(spark, sf)


@R.add("capacity_enrichment", _CAPC + f"SELECT * FROM {_CAP}")
def capacity_enrichment(spark, sf):
    """J9 where sources repeat: doubling the right sides must change nothing."""
    r, c, k, i, st, sz = estate(spark, sf, "relations", "columns", "constraints", "indexes", "statistics", "sizes")
    return C.table_capacity(r, c, k, i, st.unionByName(st), sz.unionByName(sz))


_COD = """SELECT o.schema_name, o.object_name, o.object_kind, o.status, coalesce(a.n, 0) AS signature_count, coalesce(e.n, 0) AS compile_issue_count, coalesce(d.n, 0) AS depends_on_count, coalesce(u.n, 0) AS used_by_count,
   o.source_line_count, o.source_hash_sha256 FROM e_stored o LEFT JOIN (SELECT schema_name, object_name, count(*) AS n FROM e_arguments GROUP BY ALL) a USING (schema_name, object_name)
   LEFT JOIN (SELECT schema_name, object_name, count(*) AS n FROM e_errors GROUP BY ALL) e USING (schema_name, object_name)
   LEFT JOIN (SELECT source_schema_name AS schema_name, source_object_name AS object_name, count(*) AS n FROM e_dependencies GROUP BY ALL) d USING (schema_name, object_name)
   LEFT JOIN (SELECT target_schema_name AS schema_name, target_object_name AS object_name, count(*) AS n FROM e_dependencies GROUP BY ALL) u USING (schema_name, object_name)"""


@R.add("code_dependencies", ctes("e_stored", "e_arguments", "e_errors", "e_dependencies") + _COD)
def code_dependencies(spark, sf):
    return C.code_dependencies(*estate(spark, sf, "stored", "arguments", "errors", "dependencies"))


_RELC = ctes("e_relations", "e_columns", "e_comments")
_REL = """(SELECT schema_name, relation_name, relation_kind, len(s)::BIGINT AS deterministic_score, array_to_string(s, ', ') AS signal_summary, 'DETERMINISTIC_TECHNICAL_CANDIDATE' AS candidate_label FROM (
  SELECT *, list_filter([CASE WHEN (schema_name, relation_name) IN (SELECT (schema_name, relation_name) FROM e_comments) THEN 'comment_metadata_present' END,
    CASE WHEN d THEN 'dimension_hint_column' END, CASE WHEN m THEN 'measure_hint_column' END, CASE WHEN relation_kind IN ('TABLE', 'MATERIALIZED_VIEW') THEN 'persisted_relation' END,
    CASE WHEN t THEN 'time_column' END], lambda x: x IS NOT NULL) AS s FROM e_relations LEFT JOIN (SELECT schema_name, relation_name,
     bool_or(regexp_matches(column_name, '(?i)(date|time|period|month|year|created|updated)')) AS t,
     bool_or(regexp_matches(column_name, '(?i)(amount|total|qty|quantity|count|price|cost|value|measure)')) AS m,
     bool_or(regexp_matches(column_name, '(?i)(id|key|code|type|status|category|name)')) AS d FROM e_columns GROUP BY ALL) USING (schema_name, relation_name)) WHERE len(s) > 0)"""


def _relevance(spark, sf):
    return C.bi_relevance(*estate(spark, sf, "relations", "columns", "comments"))


@R.add("bi_relevance", _RELC + "SELECT * FROM " + _REL)
def bi_relevance(spark, sf):
    return _relevance(spark, sf)


@R.add("name_hints", ctes("e_columns") + """SELECT schema_name, relation_name, column_name, regexp_matches(column_name, '(?i)(date|time|period|month|year|created|updated)') AS time_hint,
    regexp_matches(column_name, '(?i)(amount|total|qty|quantity|count|price|cost|value|measure)') AS measure_hint, regexp_matches(column_name, '(?i)(id|key|code|type|status|category|name)') AS dimension_hint
    FROM e_columns""")
def name_hints(spark, sf):
    return U.name_hints(estate(spark, sf, "columns")).select("schema_name", "relation_name", "column_name", "time_hint", "measure_hint", "dimension_hint")


@R.add("column_detail", ctes("e_columns", "e_relations") + """SELECT schema_name, relation_name, column_name, ordinal_position, data_type, is_nullable,
    coalesce((SELECT max(relation_kind) FROM e_relations r WHERE r.relation_kind <> 'VIEW' AND r.schema_name = c.schema_name AND r.relation_name = c.relation_name), 'UNKNOWN') AS relation_kind FROM e_columns c""")
def column_detail(spark, sf):
    c, r = estate(spark, sf, "columns", "relations")
    return C.column_detail(c, r.filter("relation_kind <> 'VIEW'"))


# --- questions --------------------------------------------------------------------------------------------
@R.add("q_largest_tables", _CAPC + f"""SELECT schema_name, relation_name, relation_kind, bytes, blocks, num_rows_estimate, size_semantics, row_count_semantics FROM {_CAP}
   ORDER BY bytes DESC NULLS LAST, num_rows_estimate DESC NULLS LAST, schema_name, relation_name LIMIT 100""")
def q_largest_tables(spark, sf):
    return C.answer("largest_tables", {"capacity": _capacity(spark, sf)}, limit=100)


@R.add("q_row_estimates_freshness", _CAPC + f"""SELECT schema_name, relation_name, relation_kind, num_rows_estimate, last_analyzed, stale_stats, row_count_semantics FROM {_CAP}
   ORDER BY last_analyzed NULLS LAST, schema_name, relation_name LIMIT 100""")
def q_row_estimates_freshness(spark, sf):
    return C.answer("row_estimates_freshness", {"capacity": _capacity(spark, sf)}, limit=100)


@R.add("q_object_inventory_validity", _OVC + f"SELECT * FROM {_OV} ORDER BY schema_name")
def q_object_inventory_validity(spark, sf):
    return C.answer("object_inventory_validity", {"overview": C.schema_overview(_facts(spark, sf))})


_WANT = "(SELECT DISTINCT 'SCH_' || p_partkey AS schema_name, 'P_' || p_partkey AS object_name FROM part WHERE p_size = 50)"
_DEPS = f"""(SELECT *, 'DEPENDS_ON' AS direction FROM e_dependencies WHERE (source_schema_name, source_object_name) IN (SELECT (schema_name, object_name) FROM {_WANT})
   UNION ALL SELECT *, 'USED_BY' FROM e_dependencies WHERE (target_schema_name, target_object_name) IN (SELECT (schema_name, object_name) FROM {_WANT}))"""


def _want(spark, sf):
    return load(spark, sf, "part").filter("p_size = 50").select(F.expr("'SCH_' || p_partkey").alias("schema_name"), F.expr("'P_' || p_partkey").alias("object_name"))


@R.add("object_dependencies", ctes("e_dependencies") + f"SELECT * FROM {_DEPS}")
def object_dependencies(spark, sf):
    return C.object_dependencies(estate(spark, sf, "dependencies"), _want(spark, sf))


@R.add("q_dependencies", ctes("e_dependencies") + f"""SELECT direction, source_object_name, target_object_name FROM {_DEPS}
   ORDER BY direction, source_schema_name, source_object_name, target_schema_name, target_object_name, native_dependency_kind""")
def q_dependencies(spark, sf):
    return C.answer("dependencies", {"deps": estate(spark, sf, "dependencies")}, objects=_want(spark, sf)).select("direction", "source_object_name", "target_object_name")


@R.add("q_stored_logic_signatures", ctes("e_stored", "e_arguments", "e_errors") + """SELECT category, schema_name, object_name FROM (SELECT 'stored-objects' AS category, schema_name, object_name FROM e_stored
   UNION ALL SELECT 'stored-arguments', schema_name, argument_name FROM e_arguments UNION ALL SELECT 'stored-errors', schema_name, object_name FROM e_errors) ORDER BY schema_name, object_name, category""")
def q_stored_logic_signatures(spark, sf):
    return C.answer("stored_logic_signatures", {"facts": _facts(spark, sf)}).select("category", "schema_name", "object_name")


_OPS = """SELECT CASE event_type WHEN 'error' THEN 'oracle.operations.scheduler' WHEN 'view' THEN 'oracle.structure.mview_refresh' ELSE 'oracle.operations.db_links' END AS query_id,
   'SCH_' || CAST(user_id AS STRING) AS schema_name, 'J_' || CAST(event_id AS STRING) AS object_name, event_type AS status FROM {events}"""


@R.add("q_scheduler_mv_refresh", "WITH o AS (" + _OPS.format(events="events") + """) SELECT query_id, schema_name, object_name FROM o WHERE query_id LIKE '%.operations.scheduler' OR query_id LIKE '%.structure.mview_refresh'
   ORDER BY schema_name, object_name""")
def q_scheduler_mv_refresh(spark, sf):
    return C.answer("scheduler_mv_refresh", {"facts": C.facts({"operations": portable(spark, sf, _OPS)})}).select("query_id", "schema_name", "object_name")


@R.add("q_coverage_blind_spots", ctes("e_extracts") + f"""SELECT *, {_VIS}, {_CAV} FROM e_extracts
   ORDER BY CASE state WHEN 'DENIED' THEN 0 WHEN 'TIMEOUT' THEN 1 WHEN 'ERROR' THEN 2 WHEN 'PARTIAL' THEN 3 ELSE 4 END, query_id""")
def q_coverage_blind_spots(spark, sf):
    return C.answer("coverage_blind_spots", {"coverage": V.coverage_rows(estate(spark, sf, "extracts"))})


@R.add("q_bi_relevance_candidates", _RELC + f"SELECT * FROM {_REL} ORDER BY deterministic_score DESC, schema_name, relation_name LIMIT 100")
def q_bi_relevance_candidates(spark, sf):
    return C.answer("bi_relevance_candidates", {"relevance": _relevance(spark, sf)}, limit=100)


@R.add("q_provenance", ctes("e_extracts") + f"SELECT query_id, category, state, {_VIS}, {_CAV} FROM e_extracts WHERE category IN ('statistics', 'relations')")
def q_provenance(spark, sf):
    return C.answer_provenance("row_estimates_freshness", V.coverage_rows(estate(spark, sf, "extracts"))).select(
        "query_id", "category", "state", "visibility", "empty_interpretation", "caveat")


def _sug(kind, pattern, why):
    return f"""SELECT * FROM (SELECT '{kind}' AS suggestion_type, '{kind}_' || substr(sha256('estate-v1:{kind}:' || schema_name || ':' || relation_name || ':' || column_name), 1, 16) AS suggestion_id,
     schema_name || '.' || relation_name || '.' || column_name AS label, 'Technical {why} hint from column name and type ' || data_type || '.' AS rationale
     FROM f WHERE regexp_matches(column_name, '{pattern}'))"""


@R.add("q_guidance", _RELC + ", f AS (SELECT * FROM e_columns) " + " UNION ALL ".join([
    _sug("kpi", U.GUIDE_KPI, "measure"), _sug("dim", U.GUIDE_DIMENSION, "dimension"), _sug("time", U.GUIDE_TIME, "time"),
    f"""SELECT * FROM (SELECT 'drill', 'drill_' || substr(sha256('estate-v1:drill:' || schema_name || ':' || relation_name), 1, 16), schema_name || '.' || relation_name, 'Catalog BI relevance signals: ' || signal_summary || '.'
      FROM {_REL})"""]))
def q_guidance(spark, sf):
    return C.guidance("estate-v1", estate(spark, sf, "columns"), _relevance(spark, sf))


_PT = {"pt_columns": "SELECT DISTINCT 'tbl_' || LOWER(p_type) AS table_name, REPLACE(p_name, ' ', '_') AS column_name FROM {part}",
       "pt_objectives": "SELECT p_partkey AS objective_id, p_name || ' by ' || p_type AS objective FROM {part}"}


@R.add("q_table_priority", ctes("pt_columns", "pt_objectives", texts=_PT) + """, w AS (SELECT objective_id, unnest(regexp_split_to_array(lower(objective), '[^a-z0-9]+')) AS w FROM pt_objectives), w4 AS (SELECT * FROM w WHERE length(w) > 3)
  SELECT objective_id, table_name, CAST(sum(s) AS BIGINT) AS score FROM (
   SELECT objective_id, table_name, 3 AS s FROM w4, (SELECT DISTINCT table_name FROM pt_columns) t WHERE contains(lower(table_name), w) UNION ALL
   SELECT objective_id, table_name, 1 FROM w4, pt_columns WHERE contains(lower(column_name), w)) GROUP BY ALL""")
def q_table_priority(spark, sf):
    return C.prioritize_tables(portable(spark, sf, _PT["pt_columns"]), portable(spark, sf, _PT["pt_objectives"]))


@R.add("q_canonical_order", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def q_canonical_order(spark, sf):
    return C.canonical_order(load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_orderstatus", "o_custkey"])


_HIT = """(SELECT 'relations' AS category, schema_name, relation_name, relation_name AS object_name, relation_kind AS object_kind, NULL AS column_name, 'relations' AS query_id FROM e_relations
    WHERE contains(lower(relation_name), 't_1_') OR contains(lower(schema_name), 'amount_1') UNION ALL
   SELECT 'columns', schema_name, relation_name, column_name, NULL, column_name, 'columns' FROM e_columns WHERE contains(lower(column_name), 'amount_1') UNION ALL
   SELECT 'comments', schema_name, relation_name, column_name, NULL, column_name, 'comments' FROM e_comments WHERE contains(lower(column_name), 'amount_1'))"""


@R.add("q_search", _OVC + f"SELECT * FROM {_HIT} ORDER BY schema_name, relation_name NULLS FIRST, object_name NULLS FIRST, column_name NULLS FIRST, category")
def q_search(spark, sf):
    return C.search(_facts(spark, sf), "AMOUNT_1")


_NAMES = """SELECT DISTINCT CASE WHEN o_orderpriority = '1-URGENT' THEN 'sch_' || CAST(o_custkey AS STRING) || '.t_' || CAST(o_orderkey AS STRING)
   WHEN o_orderpriority = '2-HIGH' THEN 't_' || CAST(o_orderkey AS STRING) WHEN o_orderpriority = '3-MEDIUM' THEN 'sch_x.t_' || CAST(o_orderkey AS STRING) ELSE 'arg_' || CAST(o_custkey AS STRING) END AS name FROM {orders}"""


_RESOLVE = ", w AS (" + _NAMES.format(orders="orders") + """), o AS (SELECT schema_name, relation_name AS object_name FROM e_relations UNION SELECT schema_name, object_name FROM e_stored),
   p AS (SELECT name, CASE WHEN contains(name, '.') THEN upper(split_part(name, '.', 1)) END AS s, upper(CASE WHEN contains(name, '.') THEN split_part(name, '.', 2) ELSE name END) AS n FROM w),
   g AS (SELECT name, count(o.object_name) AS matches, max(o.schema_name) AS sn, max(o.object_name) AS onm FROM p LEFT JOIN o ON upper(o.object_name) = n AND (s IS NULL OR upper(o.schema_name) = s) GROUP BY 1)
   SELECT name, matches, CASE WHEN matches = 1 THEN 'RESOLVED' WHEN matches = 0 THEN 'NOT_FOUND' ELSE 'AMBIGUOUS' END AS status, CASE WHEN matches = 1 THEN sn END AS schema_name, CASE WHEN matches = 1 THEN onm END AS object_name FROM g"""


@R.add("q_resolve", ctes("e_relations", "e_stored") + _RESOLVE)
def q_resolve(spark, sf):
    return C.resolve(_facts(spark, sf), portable(spark, sf, _NAMES))


_SNAPS = "SELECT CAST(user_id % 40 AS STRING) AS source_id, 'S_' || CAST(event_id AS STRING) AS snapshot_id, ts AS analyzed_at, event_type <> 'error' AS active FROM {events}"


@R.add("active_snapshot", "WITH s AS (" + _SNAPS.format(events="events") + """) SELECT source_id, snapshot_id, analyzed_at, active FROM s WHERE active
   QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY analyzed_at DESC, snapshot_id DESC) = 1""")
def active_snapshot(spark, sf):
    return C.active_snapshot(portable(spark, sf, _SNAPS))


@R.add("inventory_list", ctes("e_relations", "e_columns") + """SELECT object_kind, schema_name, relation_name, object_name, query_id, object_sha256, query_sha256, n FROM (
   SELECT 'RELATIONS' AS object_kind, schema_name, relation_name, relation_name AS object_name, 'q.' || relation_kind AS query_id, sha256(schema_name || relation_name) AS object_sha256,
     sha256('sql ' || 'q.' || relation_kind) AS query_sha256, 4 AS n FROM e_relations
   UNION ALL SELECT 'COLUMNS', schema_name, relation_name, column_name, 'q.' || data_type, sha256(schema_name || relation_name || column_name), NULL, 6 FROM e_columns)""")
def inventory_list(spark, sf):
    r, c = estate(spark, sf, "relations", "columns")
    r = r.withColumn("query_id", F.expr("'q.' || relation_kind")).withColumn("object_sha256", F.sha2(F.expr("schema_name || relation_name"), 256))
    c = c.withColumn("query_id", F.expr("'q.' || data_type")).withColumn("object_sha256", F.sha2(F.expr("schema_name || relation_name || column_name"), 256))
    b = r.select("query_id").distinct().withColumn("query_sha256", F.sha2(F.expr("'sql ' || query_id"), 256))
    out = E.inventory({"relations": r, "columns": c}, b)
    return out.withColumn("n", F.size(F.json_object_keys("detail_json"))).drop("detail_json")


@R.add("query_binding_check", ctes("e_extracts", "e_relations") + """, b AS (SELECT query_id FROM e_extracts WHERE state <> 'ERROR' UNION ALL SELECT query_id FROM e_extracts WHERE state = 'PARTIAL' UNION ALL SELECT 'q.' || relation_kind FROM e_relations)
   SELECT query_id, coalesce(n, 0) AS bindings FROM (SELECT DISTINCT query_id FROM e_extracts) FULL JOIN (SELECT query_id, count(*) AS n FROM b GROUP BY 1) USING (query_id) WHERE coalesce(n, 0) <> 1""")
def query_binding_check(spark, sf):
    x, r = estate(spark, sf, "extracts", "relations")
    b = x.filter("state <> 'ERROR'").select("query_id").unionByName(x.filter("state = 'PARTIAL'").select("query_id")).unionByName(
        r.select(F.expr("'q.' || relation_kind").alias("query_id")))
    return E.binding_violations(x, b)


@R.add("receipt_counts", "SELECT event_type AS result_state, count(*) AS n FROM events GROUP BY 1")
def receipt_counts(spark, sf):
    return E.receipt_counts(load(spark, sf, "events").withColumnRenamed("event_type", "result_state"))


@R.add("probe_counts", "SELECT user_id, event_type AS result_state, count(*) AS n FROM events GROUP BY 1, 2")
def probe_counts(spark, sf):
    return E.receipt_counts(load(spark, sf, "events").withColumnRenamed("event_type", "result_state"), ["user_id", "result_state"])


@R.add("stored_summary", ctes("e_stored") + """SELECT schema_name, count(*) AS object_count, count(*) FILTER (WHERE object_kind = 'PROCEDURE') AS procedures, count(*) FILTER (WHERE object_kind = 'FUNCTION') AS functions,
   count(*) FILTER (WHERE object_kind = 'TRIGGER') AS triggers, count(*) FILTER (WHERE status = 'VALID') AS visible_hashed, count(*) FILTER (WHERE coalesce(status, '') <> 'VALID') AS encrypted_or_invisible FROM e_stored GROUP BY 1""")
def stored_summary(spark, sf):
    s = estate(spark, sf, "stored").withColumn("definition_visibility", F.expr("case when status = 'VALID' then 'VISIBLE_HASHED' else 'ENCRYPTED_OR_INVISIBLE' end"))
    return E.stored_summary(s, ["schema_name"])


# --- several databases with equal names ----------------------------------------------------------------------
_BY = ["source_id"]
_OV_NAMES = ["e_relations", "e_columns", "e_stored", "e_errors", "e_comments", "e_arguments"]
_CAP_NAMES = ["e_relations", "e_columns", "e_constraints", "e_indexes", "e_statistics", "e_sizes"]


def _source_facts(spark, sf):
    return C.facts(dict(zip(CATS.values(), sources(spark, sf, *CATS))), keys=_BY)


def _source_capacity(spark, sf):
    return C.table_capacity(*sources(spark, sf, *[n[2:] for n in _CAP_NAMES]), keys=_BY)


@R.add("sources_schema_overview", each_source("SELECT * FROM " + _OV, *_OV_NAMES))
def sources_schema_overview(spark, sf):
    return C.schema_overview(_source_facts(spark, sf), keys=_BY)


@R.add("sources_table_capacity", each_source("SELECT * FROM " + _CAP, *_CAP_NAMES))
def sources_table_capacity(spark, sf):
    return _source_capacity(spark, sf)


@R.add("sources_code_dependencies", each_source(_COD, "e_stored", "e_arguments", "e_errors", "e_dependencies"))
def sources_code_dependencies(spark, sf):
    return C.code_dependencies(*sources(spark, sf, "stored", "arguments", "errors", "dependencies"), keys=_BY)


def _source_sug(source):
    def one(kind, pattern, why):
        return f"""SELECT '{kind}' AS suggestion_type, '{kind}_' || substr(sha256('{source}:{kind}:' || schema_name || ':' || relation_name || ':' || column_name), 1, 16) AS suggestion_id,
          schema_name || '.' || relation_name || '.' || column_name AS label, 'Technical {why} hint from column name and type ' || data_type || '.' AS rationale FROM e_columns WHERE regexp_matches(column_name, '{pattern}')"""
    drill = f"""SELECT 'drill', 'drill_' || substr(sha256('{source}:drill:' || schema_name || ':' || relation_name), 1, 16), schema_name || '.' || relation_name, 'Catalog BI relevance signals: ' || signal_summary || '.' FROM {_REL}"""
    parts = [one("kpi", U.GUIDE_KPI, "measure"), one("dim", U.GUIDE_DIMENSION, "dimension"), one("time", U.GUIDE_TIME, "time"), drill]
    return f"SELECT '{source}' AS source_id, * FROM ({one_source(source, 'e_relations', 'e_columns', 'e_comments')}" + " UNION ALL ".join(parts) + ")"


@R.add("sources_guidance", " UNION ALL ".join(_source_sug(s) for s in SOURCES))
def sources_guidance(spark, sf):
    """Suggestions of two databases at once, each with ids of its own."""
    r, c, k = sources(spark, sf, "relations", "columns", "comments")
    return C.guidance(None, c, C.bi_relevance(r, c, k, keys=_BY), keys=_BY)


@R.add("sources_bi_relevance", each_source("SELECT * FROM " + _REL, "e_relations", "e_columns", "e_comments"))
def sources_bi_relevance(spark, sf):
    return C.bi_relevance(*sources(spark, sf, "relations", "columns", "comments"), keys=_BY)


@R.add("sources_column_detail", each_source("""SELECT schema_name, relation_name, column_name, ordinal_position, data_type, is_nullable,
    coalesce((SELECT max(relation_kind) FROM e_relations r WHERE r.schema_name = c.schema_name AND r.relation_name = c.relation_name), 'UNKNOWN') AS relation_kind FROM e_columns c""", "e_columns", "e_relations"))
def sources_column_detail(spark, sf):
    return C.column_detail(*sources(spark, sf, "columns", "relations"), keys=_BY)


@R.add("sources_object_dependencies", each_source(f"SELECT * FROM {_DEPS}", "e_dependencies"))
def sources_object_dependencies(spark, sf):
    want = _want(spark, sf).select("*", F.explode(F.array(*[F.lit(s) for s in SOURCES])).alias("source_id"))
    return C.object_dependencies(sources(spark, sf, "dependencies")[0], want, keys=_BY)


@R.add("sources_resolve", each_source(_RESOLVE, "e_relations", "e_stored"))
def sources_resolve(spark, sf):
    names = portable(spark, sf, _NAMES).select("*", F.explode(F.array(*[F.lit(s) for s in SOURCES])).alias("source_id"))
    return C.resolve(_source_facts(spark, sf), names, keys=_BY)


@R.add("sources_largest_tables", one_source("DB_B", *_CAP_NAMES) + f"""SELECT schema_name, relation_name, relation_kind, bytes, blocks, num_rows_estimate, size_semantics, row_count_semantics FROM {_CAP}
   ORDER BY bytes DESC NULLS LAST, num_rows_estimate DESC NULLS LAST, schema_name, relation_name LIMIT 100""")
def sources_largest_tables(spark, sf):
    return C.answer("largest_tables", {"capacity": _source_capacity(spark, sf)}, limit=100, scope={"source_id": "DB_B"})


# --- text rules ---------------------------------------------------------------------------------------------
def _flag_sql(col):
    rules = [(U.SECRET_VALUE, "SECRET_VALUE"), (U.CONNECTION, "CONNECTION_STRING"), (U.RAW_SQL, "RAW_SQL"), (U.DENIED_TEXT, "DENIED_TEXT"), (U.CONTROL, "CONTROL_CHARACTER")]
    return "concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches({col}, '{p}') THEN '{n}' END" for p, n in rules) + ")"


@R.add("disclosure_documents", f"SELECT doc_id, {_flag_sql('text')} AS text_flags FROM documents")
def disclosure_documents(spark, sf):
    return U.disclosure_scan(load(spark, sf, "documents"), ["text"]).select("doc_id", F.array_join("text_flags", ",").alias("text_flags"))


@R.add("disclosure_pages", f"SELECT page_id, {_flag_sql('url')} AS url_flags, {_flag_sql('html')} AS html_flags FROM pages")
def disclosure_pages(spark, sf):
    return U.disclosure_scan(load(spark, sf, "pages"), ["url", "html"]).select(
        "page_id", F.array_join("url_flags", ",").alias("url_flags"), F.array_join("html_flags", ",").alias("html_flags"))


_KEYS = """SELECT event_id, '{"' || CASE event_type WHEN 'view' THEN 'apiKey' WHEN 'click' THEN 'records' WHEN 'signup' THEN 'raw_sql' WHEN 'purchase' THEN 'Sample Value' ELSE 'token' END || '": 1, "k": 2}' AS body FROM {events}"""


_B, _E = "chr(123)", "chr(125)"
_NEST = f"""SELECT event_id, {_B} || '"a": ' || {_B} || '"' || CASE event_type WHEN 'view' THEN 'apiKey' WHEN 'click' THEN 'records' ELSE 'fine' END || '": [' || {_B} || '"'
   || CASE user_id % 3 WHEN 0 THEN 'password' WHEN 1 THEN 'note' ELSE 'raw_sql' END || '": "' || CASE WHEN value < 5 THEN 'select a from b' WHEN value < 8 THEN '' ELSE 'plain' END || '"' || {_E}
   || ', 7, null, "' || CASE WHEN value > 60 THEN 'delete from t' ELSE 'x' END || '"]' || {_E} || ', "list": [["x", ' || {_B} || '"' || CASE user_id % 4 WHEN 0 THEN 'dsn' ELSE 'ok' END || '": 1' || {_E} || ']]'
   || CASE WHEN event_type = 'error' THEN '' ELSE {_E} END AS body FROM {{events}}"""


@R.add("disclosure_walk", "WITH d AS (" + _NEST.format(events="events") + f"""), t AS (SELECT d.event_id, j.fullkey AS path, CASE WHEN ends_with(j.fullkey, ']') THEN NULL ELSE j.key END AS k, j.type, CASE WHEN j.type = 'VARCHAR' THEN j.atom ->> '$' END AS x
     FROM (SELECT * FROM d WHERE json_valid(body)) d, json_tree(d.body) j)
  SELECT event_id, path, unnest(list_filter([CASE WHEN regexp_matches(k, '{U.SECRET_KEY}') THEN 'SECRET_KEY' END, CASE WHEN regexp_matches(k, '{U.ROW_KEY}') THEN 'SOURCE_ROW_KEY' END, CASE WHEN regexp_matches(k, '{U.SQL_KEY}') THEN 'RAW_SQL_KEY' END,
    CASE WHEN lower(regexp_replace(regexp_replace(k, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[ .-]+', '_', 'g')) IN ({", ".join(f"'{x}'" for x in U.UNSAFE_KEYS)}) THEN 'UNSAFE_EVIDENCE_KEY' END,
    CASE WHEN x = '' THEN 'TEXT_DENIED' END, CASE WHEN x IN ('select a from b', 'delete from t') THEN 'RAW_SQL' END], lambda v: v IS NOT NULL)) AS flag FROM t
  UNION ALL SELECT event_id, '$', 'NOT_JSON' FROM d WHERE NOT json_valid(body)""")
def disclosure_walk(spark, sf):
    """Keys and texts at any depth and in arrays, with their paths."""
    return walk(portable(spark, sf, _NEST), ["event_id"], "body")


@R.add("disclosure_keys", """SELECT event_id, CASE event_type WHEN 'view' THEN 'SECRET_KEY,UNSAFE_EVIDENCE_KEY' WHEN 'click' THEN 'SOURCE_ROW_KEY' WHEN 'signup' THEN 'RAW_SQL_KEY' WHEN 'purchase' THEN 'UNSAFE_EVIDENCE_KEY'
    ELSE 'SECRET_KEY,UNSAFE_EVIDENCE_KEY' END AS flags FROM events""")
def disclosure_keys(spark, sf):
    return portable(spark, sf, _KEYS.replace('{"', "{{\"").replace("2}'", "2}}'")).select("event_id", F.array_join(U.key_flags("body"), ",").alias("flags"))


def _route_sql(col, rules, default, lower=False):
    c = f"lower({col})" if lower else col
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '{p}') THEN '{n}'" for n, p in rules) + (f" ELSE '{default}'" if default else "") + " END"


@R.add("intent_routing", f"""SELECT conv_id, turn, {_route_sql('text', U.INTENT_RULES, None)} AS family, nullif(regexp_extract(text, '{U.OBJECT_MENTION}', 1), '') AS mentioned_object,
    {_route_sql('text', U.TASK_RULES, 'extraction', True)} AS task_class FROM conversations""")
def intent_routing(spark, sf):
    return U.route_intent(load(spark, sf, "conversations"), "text").select("conv_id", "turn", "family", "mentioned_object", "task_class")


_FP = """SELECT event_id, CASE WHEN value < 20 THEN 'v0' ELSE 'v1' END AS contract_version, CASE WHEN value > 80 THEN 'unknown' ELSE 'compatible' END AS compatibility, ts AS observed_at,
   CASE WHEN event_type = 'view' THEN CAST(864000 AS BIGINT) END AS max_age_seconds, event_type AS content_sha256, CASE WHEN user_id < 20 THEN 'x' ELSE event_type END AS canonical_sha256,
   CASE WHEN user_id < 40 THEN 'click' END AS expected_sha256, CAST(user_id AS STRING) AS target, CASE WHEN user_id > 100 THEN '120' END AS expected_target,
   CASE WHEN event_type IN ('view', 'click') THEN 'publish dashboard' ELSE 'read' END AS action FROM {events}"""


@R.add("freshness_gate", "WITH f AS (" + _FP.format(events="events") + """), r AS (SELECT *, concat_ws(',', CASE WHEN contract_version <> 'v1' THEN 'CONTRACT_DENIED' END, CASE WHEN compatibility <> 'compatible' THEN 'INCOMPATIBLE' END,
   CASE WHEN epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(observed_at) > coalesce(max_age_seconds, 86400) * 1000000 THEN 'STALE' END, CASE WHEN content_sha256 <> canonical_sha256 THEN 'HASH_MISMATCH' END,
   CASE WHEN expected_sha256 <> content_sha256 THEN 'CONTENT_DRIFT' END, CASE WHEN expected_target <> target THEN 'TARGET_MISMATCH' END) AS reasons FROM f)
   SELECT event_id, reasons, CASE WHEN reasons <> '' THEN 'BLOCKED' WHEN action = 'read' THEN 'ALLOWED_READ_ONLY' ELSE 'READY_FOR_REVIEW' END AS status FROM r""")
def freshness_gate(spark, sf):
    return U.freshness_gate(portable(spark, sf, _FP), "2024-01-31 00:00:00", "v1").select("event_id", F.array_join("reasons", ",").alias("reasons"), "status")


_TXT = """SELECT event_id, ts, CASE CAST(FLOOR(value) AS BIGINT) % 5 WHEN 0 THEN 'col_' || CAST(event_id AS STRING) WHEN 1 THEN '9col' WHEN 2 THEN 'a b' WHEN 3 THEN '' ELSE 'x$' END AS nm,
   CASE event_type WHEN 'view' THEN '2024-02-30T00:00:00.000Z' WHEN 'click' THEN '2024-02-28T23:59:59.120Z' WHEN 'signup' THEN '2024-02-28 23:59:59' WHEN 'purchase' THEN '2024-13-01T00:00:00.000Z' END AS iso FROM {events}"""


@R.add("text_functions", "WITH t AS (" + _TXT.format(events="events") + """) SELECT event_id, regexp_full_match(nm, '[A-Za-z_][A-Za-z0-9_$]{0,62}') AS identifier, length(nm) > 0 AS scoped_name,
   CASE WHEN iso = '2024-02-28T23:59:59.120Z' THEN TIMESTAMP '2024-02-28 23:59:59.120' END AS strict, ts + INTERVAL 3600 SECOND AS stale_after FROM t""")
def text_functions(spark, sf):
    t = portable(spark, sf, _TXT)
    return t.select("event_id", X.valid_identifier("nm").alias("identifier"), X.valid_scoped_name("nm").alias("scoped_name"), X.strict_iso("iso").alias("strict"), X.stale_after("ts", 3600).alias("stale_after"))
