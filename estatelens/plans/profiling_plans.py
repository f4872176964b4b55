"""Profiling operators bound to the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profiling as P
from ..operators import typed_values as V
from .base import Registry, items_text, load, stringify

R = Registry()

LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
            "l_returnflag", "l_linestatus", "l_shipdate"]
SCHEMAS = {  # table -> column, kind of text in the oracle (n number, t time, s text)
    "lineitem": [(x, "t" if x == "l_shipdate" else "s" if x in ("l_returnflag", "l_linestatus") else "n") for x in LINEITEM],
    "orders": [("o_orderkey", "n"), ("o_custkey", "n"), ("o_orderstatus", "s"), ("o_totalprice", "n"), ("o_orderdate", "t"), ("o_orderpriority", "s")],
    "customer": [("c_custkey", "n"), ("c_name", "s"), ("c_nationkey", "n"), ("c_acctbal", "n"), ("c_mktsegment", "s")],
    "documents": [("doc_id", "n"), ("text", "s"), ("lang", "s"), ("source", "s"), ("n_chars", "n")],
}
FAMILY = {"n": "NUMERIC", "t": "TEMPORAL", "s": "TEXT"}
TS = "%Y-%m-%d %H:%M:%S.%f"


def _ext(expr, kind):
    if kind == "t":
        return f"strftime({expr}, '{TS}')"
    return f"CAST({expr} AS VARCHAR)" if kind == "n" else "CAST(NULL AS VARCHAR)"


def table_profile_sql(table: str) -> str:
    parts = []
    for i, (x, k) in enumerate(SCHEMAS[table]):
        parts.append(
            f"SELECT '{x}' AS column_name, {i + 1} AS ordinal_position, '{FAMILY[k]}' AS type_family, count(*) AS row_count, "
            f"count(*) - count({x}) AS null_count, {_ext(f'min({x})', k)} AS minimum, {_ext(f'max({x})', k)} AS maximum, "
            f"count(DISTINCT {x}) AS distinct_count, true AS distinct_exact FROM {table}")
    return " UNION ALL ".join(parts)


def _one(name, table, col, fam, kind):
    ext = f", {_ext(f'min({col})', kind)} AS minimum, {_ext(f'max({col})', kind)} AS maximum" if fam in ("NUMERIC", "TEMPORAL") else ""
    if fam == "TEMPORAL":
        ext += f", {_ext(f'max({col})', kind)} AS freshness_maximum"
    sql = (f"SELECT '{col}' AS column_name, '{fam}' AS type_family, count(*) AS row_count, count(*) - count({col}) AS null_count, "
           f"count(DISTINCT {col}) AS distinct_count{ext} FROM {table}")

    @R.add(name, sql)
    def run(spark, sf):
        return P.profile(load(spark, sf, table), col, fam)


_one("profile_numeric", "lineitem", "l_extendedprice", "NUMERIC", "n")
_one("profile_temporal", "orders", "o_orderdate", "TEMPORAL", "t")
_one("profile_category", "customer", "c_mktsegment", "CATEGORY", "s")
_one("profile_text", "part", "p_name", "TEXT", "s")


@R.add("profile_boolean", """SELECT 'toxic' AS column_name, 'BOOLEAN' AS type_family, count(*) AS row_count,
    count(*) - count(toxic) AS null_count, count(DISTINCT toxic) AS distinct_count FROM labels""")
def profile_boolean(spark, sf):
    return P.profile(load(spark, sf, "labels").select((F.col("toxic") == 1).alias("toxic")), "toxic", "BOOLEAN")


_PRIO = "nullif(o_orderpriority, '4-NOT SPECIFIED')"


@R.add("profile_counts", f"""SELECT 'o_orderpriority' AS column_name, count(*) AS row_count,
    count(*) FILTER (WHERE {_PRIO} IS NULL) AS null_count, count(DISTINCT {_PRIO}) AS distinct_count FROM orders
    UNION ALL SELECT 'o_custkey', count(*), count(*) FILTER (WHERE o_custkey IS NULL), count(DISTINCT o_custkey) FROM orders""")
def profile_counts(spark, sf):
    o = load(spark, sf, "orders").withColumn("o_orderpriority", F.expr(_PRIO))
    return P.profile_counts(o, ["o_orderpriority", "o_custkey"])


def _whole(table):
    @R.add("profile_table_" + table, table_profile_sql(table))
    def run(spark, sf):
        return P.profile_table(load(spark, sf, table))


for _t in SCHEMAS:
    _whole(_t)


@R.add("profile_table_screened", " UNION ALL ".join(
    f"SELECT '{x}' AS column_name, count(DISTINCT {x}) AS distinct_count, true AS distinct_exact FROM orders" for x in ("o_orderkey", "o_totalprice")))
def profile_table_screened(spark, sf):
    """Exact distinct counts only where the sketch leaves a column possible as a key."""
    return P.profile_table(load(spark, sf, "orders"), distinct="screened").filter("distinct_exact").select(
        "column_name", "distinct_count", "distinct_exact")


@R.add("column_summary", f"""SELECT count(*) AS row_count, count(*) - count(p) AS null_count, count(DISTINCT p) AS distinct_count
    FROM (SELECT {_PRIO} AS p FROM orders)""")
def column_summary(spark, sf):
    o = load(spark, sf, "orders").withColumn("p", F.expr(_PRIO))
    return P.column_summary(o, "p")


_MS = "%Y-%m-%dT%H:%M:%S.%g"


@R.add("temporal_coverage", f"""SELECT count(*) AS row_count, count(*) - count(o_orderdate) AS null_count,
    count(DISTINCT o_orderdate) AS distinct_count, strftime(min(o_orderdate), '{_MS}') AS minimum, strftime(max(o_orderdate), '{_MS}') AS maximum,
    strftime(max(o_orderdate), '{_MS}') AS freshness_maximum FROM orders""")
def temporal_coverage(spark, sf):
    return P.temporal_coverage(load(spark, sf, "orders"), "o_orderdate")


@R.add("quality_indicators", """SELECT count(*) AS row_count, count(*) - count(o_custkey) AS null_count, count(DISTINCT o_custkey) AS distinct_count
    FROM orders""")
def quality_indicators(spark, sf):
    return P.quality_indicators(load(spark, sf, "orders"), "o_custkey")


_QM = """, m AS (SELECT *, row_count - null_count AS non_null_count, row_count - null_count - distinct_count AS duplicate_count FROM p)
SELECT column_name, row_count, null_count, distinct_count, non_null_count, duplicate_count,
  CASE WHEN row_count = 0 THEN 0 ELSE null_count * 10000 // row_count END AS null_rate_bps,
  CASE WHEN non_null_count = 0 THEN 0 ELSE distinct_count * 10000 // non_null_count END AS distinct_rate_bps,
  row_count > 0 AND null_count = 0 AND duplicate_count = 0 AS key_eligible,
  concat_ws(';', CASE WHEN null_count > 0 THEN 'NULLS_OBSERVED=' || null_count END,
    CASE WHEN duplicate_count > 0 THEN 'DUPLICATES_OBSERVED=' || duplicate_count END,
    CASE WHEN row_count = 0 THEN 'EMPTY_BOUNDED_SCOPE=0' END) AS counterevidence FROM m"""


@R.add("quality_metrics", f"""WITH p AS (SELECT 'o_orderpriority' AS column_name, count(*) AS row_count, count(*) - count({_PRIO}) AS null_count,
    count(DISTINCT {_PRIO}) AS distinct_count FROM orders UNION ALL
    SELECT 'o_orderkey', count(*), count(*) - count(o_orderkey), count(DISTINCT o_orderkey) FROM orders UNION ALL
    SELECT 'o_custkey', count(*), count(*) - count(o_custkey), count(DISTINCT o_custkey) FROM orders)""" + _QM)
def quality_metrics(spark, sf):
    o = load(spark, sf, "orders").withColumn("o_orderpriority", F.expr(_PRIO))
    q = P.quality_metrics(P.profile_counts(o, ["o_orderpriority", "o_orderkey", "o_custkey"]))
    return q.withColumn("counterevidence", items_text("counterevidence"))


@R.add("temporal_completeness", """SELECT 'l_shipdate' AS column_name, count(*) - count(d) AS null_count, count(*) AS row_count,
    (count(*) - count(d)) * 10000 // count(*) AS null_rate_bps
    FROM (SELECT CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_shipdate END AS d FROM lineitem)""")
def temporal_completeness(spark, sf):
    l = load(spark, sf, "lineitem").select(F.expr("CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_shipdate END").alias("l_shipdate"))
    return P.temporal_completeness(P.profile(l, "l_shipdate", "TEMPORAL")).select("column_name", "null_count", "row_count", "null_rate_bps")


def _q_sql(table, cols, exact=False):
    rank = {"median_value": "n // 2", "q1": "CAST(floor((n - 1) * 0.25) AS BIGINT)", "q3": "CAST(floor((n - 1) * 0.75) AS BIGINT)"}
    pick = ", ".join(f"CAST(max(v) FILTER (WHERE r = {r}) AS DOUBLE) AS {q}" + (f", CAST(max(v) FILTER (WHERE r = {r}) AS VARCHAR) AS {q}_exact" if exact else "") for q, r in rank.items())
    return " UNION ALL ".join(f"""SELECT '{x}' AS column_name, {pick}
        FROM (SELECT {x} AS v, row_number() OVER (ORDER BY {x}) - 1 AS r, count(*) OVER () AS n FROM {table} WHERE {x} IS NOT NULL)""" for x in cols)


_WANTED = {"median_value": P.UPPER_MEDIAN, "q1": 0.25, "q3": 0.75}


@R.add("rank_quantiles", _q_sql("lineitem", ["l_extendedprice", "l_quantity", "l_discount"]))
def rank_quantiles(spark, sf):
    q = V.exact_quantiles(load(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity", "l_discount"], _WANTED)
    return q.select("column_name", *[F.col(x).cast("double").alias(x) for x in _WANTED])


_BIG = {"big_long": "CASE WHEN l_linenumber % 2 = 0 THEN 9007199254740992 + l_orderkey ELSE -9007199254740992 - l_partkey END",
        "wide_decimal": "CAST(concat(CASE WHEN l_linenumber % 3 = 0 THEN '-' ELSE '' END, CAST(l_orderkey AS STRING), '12345678901234567890.', lpad(CAST(l_partkey AS STRING), 8, '0')) AS DECIMAL(38, 8))",
        "small_decimal": "CAST(l_discount - 0.05 AS DECIMAL(9, 4))"}


@R.add("rank_quantiles_exact", " UNION ALL ".join(
    f"""SELECT '{x}' AS column_name, CAST(max(v) FILTER (WHERE r = n // 2) AS VARCHAR) AS median_value,
    CAST(max(v) FILTER (WHERE r = CAST(floor((n - 1) * 0.25) AS BIGINT)) AS VARCHAR) AS q1, CAST(max(v) FILTER (WHERE r = CAST(floor((n - 1) * 0.75) AS BIGINT)) AS VARCHAR) AS q3
    FROM (SELECT v, row_number() OVER (ORDER BY v) - 1 AS r, count(*) OVER () AS n FROM (SELECT {e.replace('STRING', 'VARCHAR')} AS v FROM lineitem) WHERE v IS NOT NULL)""" for x, e in _BIG.items()))
def rank_quantiles_exact(spark, sf):
    """Integers above 2**53, decimals of more than 30 digits, small decimals, as exact text; narrowed in several rounds."""
    wide = load(spark, sf, "lineitem").select(*[F.expr(e).alias(x) for x, e in _BIG.items()])
    return V.exact_quantiles(wide, list(_BIG), _WANTED, digits=2, closing=100)


@R.add("rank_quantiles_two_rounds", _q_sql("orders", ["o_totalprice"]))
def rank_quantiles_two_rounds(spark, sf):
    o = load(spark, sf, "orders").groupBy(F.lit("o_totalprice").alias("column_name"), F.col("o_totalprice").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return P.histogram_quantiles(o, ["column_name"], "v", "n", {"median_value": P.UPPER_MEDIAN, "q1": 0.25, "q3": 0.75}, rounds=2, coarse=8, fine=8)


SAMPLE = {"customer": (["c_custkey", "c_nationkey", "c_acctbal"], ["c_name", "c_mktsegment"]),
          "part": (["p_partkey", "p_size", "p_retailprice"], ["p_name", "p_brand", "p_type"]),
          "events": (["event_id", "user_id", "value"], ["event_type", "props"])}


def _sample_cte(table):
    nums, texts = SAMPLE[table]
    base = " UNION ALL ".join(
        f"""SELECT '{x}' AS column_name, sum(n) AS sampled, coalesce(sum(n) FILTER (WHERE v IS NULL), 0) AS nulls, count(v) AS distinct_sampled,
        coalesce(sum(n - 1) FILTER (WHERE v IS NOT NULL), 0) AS duplicate_sampled, '{'NUMERIC' if x in nums else 'TEXT'}' AS type_family
        FROM (SELECT {x} AS v, count(*) AS n FROM {table} GROUP BY 1)""" for x in nums + texts)
    ends = " UNION ALL ".join(f"SELECT '{x}' AS column_name, CAST(min({x}) AS DOUBLE) AS min_value, CAST(max({x}) AS DOUBLE) AS max_value, CAST(min({x}) AS VARCHAR) AS min_value_exact, CAST(max({x}) AS VARCHAR) AS max_value_exact FROM {table}" for x in nums)
    return f"""(SELECT b.column_name, CAST(sampled AS BIGINT) AS sampled, CAST(nulls AS BIGINT) AS nulls, distinct_sampled,
      CAST(duplicate_sampled AS BIGINT) AS duplicate_sampled, type_family, min_value, max_value, median_value, q1, q3, min_value_exact, max_value_exact, median_value_exact, q1_exact, q3_exact
      FROM ({base}) b LEFT JOIN ({ends}) e USING (column_name) LEFT JOIN ({_q_sql(table, nums, True)}) q USING (column_name))"""


def _sample(table):
    @R.add("sample_profile_" + table, f"SELECT * FROM {_sample_cte(table)}")
    def run(spark, sf):
        nums, texts = SAMPLE[table]
        return P.sample_profile(load(spark, sf, table), nums + texts)


for _t in SAMPLE:
    _sample(_t)

_ALL = " UNION ALL ".join(f"SELECT '{t}' AS table_name, * FROM {_sample_cte(t)}" for t in SAMPLE)
_ANOMALY = f"""WITH p AS ({_ALL}), o AS (SELECT count(*) AS n FROM labels ANTI JOIN (SELECT * FROM documents WHERE lang <> 'fr') d USING (doc_id)),
a AS (
 SELECT 'missing_values' AS anomaly_type, table_name, column_name, CASE WHEN nulls >= 0.25 * greatest(1, sampled) THEN 'high' ELSE 'medium' END AS severity FROM p WHERE nulls > 0
 UNION ALL SELECT 'negative_values', table_name, column_name, 'high' FROM p WHERE min_value < 0
 UNION ALL SELECT 'duplicate_values', table_name, column_name, 'medium' FROM p WHERE regexp_matches(column_name, '(?i)(email|code|number|reference|serial)') AND duplicate_sampled > 0
 UNION ALL SELECT 'extreme_values', table_name, column_name, 'medium' FROM p WHERE sampled >= 5 AND q3 > q1 AND max_value > q3 + 3 * (q3 - q1)),
found AS (SELECT *, 'profile:' || table_name || '.' || column_name AS evidence, CAST(NULL AS VARCHAR) AS relationship FROM a
 UNION ALL SELECT 'orphan_relationship', NULL, NULL, 'high', 'link-test', 'labels.doc_id->documents.doc_id' FROM o WHERE n > 0)"""


def _found(spark, sf):
    profs = None
    for t, (nums, texts) in SAMPLE.items():
        p = P.sample_profile(load(spark, sf, t), nums + texts).withColumn("table_name", F.lit(t))
        profs = p if profs is None else profs.unionByName(p)
    from ..operators.relationships import orphan_values
    l, d = load(spark, sf, "labels", "documents")
    kids = orphan_values(l, "doc_id", d.filter("lang <> 'fr'"), "doc_id").agg((F.count(F.lit(1)) > 0).alias("is_orphan"))
    return P.anomalies(profs, kids.withColumn("relationship", F.lit("labels.doc_id->documents.doc_id")).withColumn("evidence", F.lit("link-test")))


@R.add("anomalies", _ANOMALY + " SELECT * FROM found")
def anomalies(spark, sf):
    return _found(spark, sf)


@R.add("anomaly_causes", _ANOMALY + """ SELECT anomaly_type || ' may affect KPI trust or process performance' AS hypothesis, 0.45::DOUBLE AS confidence,
    'requires-targeted-domain-test' AS status, evidence FROM found""")
def anomaly_causes(spark, sf):
    return P.cause_rows(_found(spark, sf))


@R.add("profile_candidates", f"""WITH p AS ({table_profile_sql('orders')}), c AS (SELECT *, row_count > 0 AND null_count = 0 AND distinct_count = row_count AS uq FROM p)
SELECT column_name, type_family, row_count, null_count, distinct_count, candidate_type, rule_id, signals, 'REVIEW_REQUIRED' AS review_state, 'UNKNOWN' AS classification_state FROM (
 SELECT *, 'KEY' AS candidate_type, 'UNIQUE_COMPLETE_AGGREGATE_V1' AS rule_id, 'ALL_ROWS_NON_NULL,ALL_ROWS_DISTINCT' AS signals FROM c WHERE uq
 UNION ALL SELECT *, 'AMOUNT', 'NON_UNIQUE_NUMERIC_FAMILY_V1', 'NUMERIC_TYPE_FAMILY,NOT_UNIQUE_COMPLETE' FROM c WHERE NOT uq AND type_family = 'NUMERIC'
 UNION ALL SELECT *, 'TIME', 'TEMPORAL_FAMILY_V1', 'TEMPORAL_TYPE_FAMILY' FROM c WHERE type_family = 'TEMPORAL'
 UNION ALL SELECT *, 'CATEGORY', 'BOUNDED_CARDINALITY_FAMILY_V1', type_family || '_TYPE_FAMILY' FROM c WHERE type_family IN ('CATEGORY', 'BOOLEAN')
 UNION ALL SELECT *, 'QUALITY', 'NULL_AND_DISTINCT_OBSERVATION_V1', CASE WHEN null_count = 0 THEN 'NO_NULLS_OBSERVED' ELSE 'NULLS_OBSERVED' END || ',' ||
   CASE WHEN row_count > null_count AND distinct_count = row_count - null_count THEN 'ALL_NON_NULL_VALUES_DISTINCT' ELSE 'REPEATED_NON_NULL_VALUES' END FROM c)""")
def profile_candidates(spark, sf):
    return stringify(P.profile_candidates(P.profile_table(load(spark, sf, "orders"))), "signals")


@R.add("bounded_scan", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 64")
def bounded_scan(spark, sf):
    return P.first_rows(load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), 64, ["o_orderkey"])
