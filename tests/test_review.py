"""Inputs that the bound queries do not show: doubled keys, left-out name parts, source lists, emptied tables, long chains."""

from pyspark.sql import functions as F

from estatelens.operators import catalog as C
from estatelens.operators import decisions as D
from estatelens.operators import evidence as E
from estatelens.operators import graph as G
from estatelens.operators import relationships as L
from estatelens.operators import sqltext as S
from estatelens.sources import sinks as K
from estatelens.sources.collectors.mssql import name_part


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_name_parts_left_out(spark):
    df = spark.createDataFrame([("db..obj",), ("[a]]b].[c]",), ("..o",), (None,)], "n string")
    got = [tuple(r) for r in df.select(*[name_part("n", i) for i in (1, 2, 3, 4)]).collect()]
    assert got == [("obj", None, "db", None), ("c", "a]b", None, None), ("o", None, None, None), (None, None, None, None)]


def test_table_refs_of_lists_and_calls(spark):
    texts = {
        "list": "SELECT * FROM s.t1, s.t2 x, t3 AS y WHERE a = 1", "call": "SELECT extract(year FROM ts) AS y FROM t", "quoted": "SELECT a FROM [my table]",
        "mixed": "SELECT a FROM t1, (SELECT b FROM t2) q", "join": "SELECT a FROM t1 x JOIN t2 y ON x.a = y.a, t3", "function": "SELECT a FROM f(1)",
        "inner": "SELECT a, (SELECT max(b) FROM u, v) FROM t1 LEFT JOIN t2 ON t1.a = t2.a AND t1.b IN (1, 2) ORDER BY a, b", "plain": "SELECT a, b FROM [s].[t] GROUP BY a, b"}
    got = S.sql_table_refs(spark.createDataFrame(list(texts.items()), "id string, q string"), "q", ["id"])
    edges = {}
    for r in got.collect():
        edges.setdefault(r.id, set()).add((r.target_schema_name, r.target_object_name) if r.gap_state is None else r.gap_state)
    gap = {"UNSUPPORTED_SYNTAX_BLIND_SPOT"}
    assert edges == {"list": {("s", "t1"), ("s", "t2"), (None, "t3")}, "call": gap, "quoted": gap, "mixed": gap, "join": gap, "function": gap,
                     "inner": {(None, "u"), (None, "v"), (None, "t1"), (None, "t2")}, "plain": {("s", "t")}}


def test_audit_denies_sources_by_comma(spark):
    df = spark.createDataFrame([("SELECT name FROM sys.tables, dbo.payroll",), ("SELECT t.name, c.name FROM sys.tables t JOIN sys.columns c ON t.id = c.id, dbo.payroll p",),
                                ("SELECT a, b FROM sys.tables WHERE x IN (1, 2) ORDER BY a, b",)], "q string").withColumn("engine", F.lit("mssql"))
    assert [r.verdict for r in S.audit_sql(df, "q").collect()] == ["SOURCE_BOUNDARY_DENIED", "SOURCE_BOUNDARY_DENIED", "ALLOWED"]


def test_doubled_keys_do_not_double_rows(spark):
    cols = spark.createDataFrame([("s", "r", "c")], "schema_name string, relation_name string, column_name string")
    rels = spark.createDataFrame([("s", "r", "VIEW"), ("s", "r", "TABLE")], "schema_name string, relation_name string, relation_kind string")
    assert [r.relation_kind for r in C.column_detail(cols, rels).collect()] == ["TABLE"]
    bound = spark.createDataFrame([("q", "2", "u"), ("q", "1", "u")], "query_id string, query_sha256 string, source_reference_url string")
    assert [r.query_sha256 for r in E.bind_queries(spark.createDataFrame([("q",)], "query_id string"), bound).collect()] == ["1"]


def test_every_table_is_ranked(spark):
    cols = spark.createDataFrame([("order_lines", "price"), ("other", "x"), ("third", "line_order")], "table_name string, column_name string")
    assert rows(C.rank_tables(cols, "orders by line and order")) == [("order_lines", 6), ("other", 0), ("third", 2)]


def test_guidance_is_complete_unless_capped(spark):
    cols = spark.range(400).select(F.lit("s").alias("schema_name"), F.lit("r").alias("relation_name"), F.format_string("amount_%03d", "id").alias("column_name"),
                                   F.lit("int").alias("data_type"), F.col("id").cast("int").alias("ordinal_position"))
    rel = spark.createDataFrame([], "schema_name string, relation_name string, deterministic_score long, signal_summary string")
    kinds = lambda df: df.where("suggestion_type = 'kpi'").count()
    assert (kinds(C.guidance("v", cols, rel)), kinds(C.guidance("v", cols, rel, scan=300)), kinds(C.guidance("v", cols, rel, most={"kpi": 20}))) == (400, 300, 20)


def test_large_means_keep_their_spread(spark):
    df = spark.createDataFrame([(None, 1e9 + x, "a", i) for i, x in enumerate((0.0, 0.1, 0.2))], "g string, v double, s string, k int")
    z = D.profile_summary(df, ["g"], "v", "s", ["k"]).first().outlier_z_max
    assert abs(z - 1.2247) < 1e-3


def test_candidates_without_objects_are_taken(spark):
    df = spark.createDataFrame([("a", 5, ["x"]), ("b", 4, ["x"]), ("c", 3, []), ("d", 2, None)], "candidate_id string, expected_gain_bps int, objects array<string>")
    assert rows(D.object_capped_selection(df, 1).select("candidate_id")) == [("a",), ("c",), ("d",)]


def test_emptied_table_loses_its_rows(spark, tmp_path):
    root = str(tmp_path)
    snaps = spark.createDataFrame([("src", "s 1", "2024-01-01"), ("oth", "s2", "2024-01-01")], "source_id string, snapshot_id string, analyzed_at string")
    full = spark.createDataFrame([("s 1", 1), ("s2", 2)], "snapshot_id string, x int")
    K.ingest({"t": full}, snaps, root)
    less = full.where("x = 2")
    assert rows(K.readback(spark, {"t": less}, root, snaps)) == [("t", "s 1", 0, 1, False), ("t", "s2", 1, 1, True)]
    K.ingest({"t": less}, snaps, root)
    assert rows(K.readback(spark, {"t": less}, root, snaps)) == [("t", "s2", 1, 1, True)]
    assert rows(K.readback(spark, {"none": less}, root)) == [("none", "s2", 1, 0, False)]


def test_chain_of_levels(spark):
    n = 12
    nodes = spark.range(n).select(F.col("id").alias("node"))
    got = G.dependency_levels(nodes, spark.range(1, n).select(F.col("id").alias("node"), (F.col("id") - 1).alias("needs")))
    assert rows(got.select("node", "level")) == sorted(((i, i) for i in range(n)), key=repr)


def test_equal_names_in_two_databases_stay_apart(spark):
    rel = spark.createDataFrame([("x", "s", "r", "TABLE"), ("y", "s", "r", "VIEW")], "source_id string, schema_name string, relation_name string, relation_kind string")
    col = spark.createDataFrame([("x", "s", "r", "a"), ("x", "s", "r", "b"), ("y", "s", "r", "a")], "source_id string, schema_name string, relation_name string, column_name string")
    f, by = C.facts({"relations": rel, "columns": col}, keys=["source_id"]), ["source_id"]
    assert rows(C.schema_overview(f, by).select("source_id", "relation_count", "column_count")) == [("x", 1, 2), ("y", 1, 1)]
    assert rows(C.column_detail(col, rel, by).select("source_id", "column_name", "relation_kind")) == [("x", "a", "TABLE"), ("x", "b", "TABLE"), ("y", "a", "VIEW")]
    names = spark.createDataFrame([("x", "r"), ("y", "r"), ("z", "r")], "source_id string, name string")
    assert rows(C.resolve(f, names, by).select("source_id", "status")) == [("x", "RESOLVED"), ("y", "RESOLVED"), ("z", "NOT_FOUND")]
    assert rows(C.search(f, "b!", keys=by)) == [] and [r.source_id for r in C.search(f, "view", keys=by).collect()] == ["y"]


def test_candidate_pairs_of_one_database(spark):
    prof = spark.createDataFrame([("x", "s", "a", "id", "int"), ("x", "s", "b", "id", "int"), ("y", "s", "b", "id", "int")], "source_id string, schema_name string, relation_name string, column_name string, native_type string")
    con = spark.createDataFrame([("x", "s", "a", "k", "PRIMARY_KEY", "id"), ("y", "s", "b", "k", "PRIMARY_KEY", "id")], "source_id string, schema_name string, relation_name string, constraint_name string, constraint_kind string, column_name string")
    con = con.selectExpr("*", "cast(null as string) referenced_schema_name", "cast(null as string) referenced_relation_name", "cast(null as string) referenced_column_name")
    got = L.candidate_pairs(prof, con, keys=["source_id"])
    assert rows(got.select("source_id", "source_relation_name", "target_relation_name")) == [("x", "b", "a")]
