"""Faults found by the review of round 3: hot keys, and rows that were shuffled without need."""

import re

import pytest
from pyspark.sql import functions as F

from estatelens.operators import evidence as E
from estatelens.operators import lineage as N
from estatelens.operators import relationships as L
from estatelens.sources import sinks as K


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def keys(df):
    """What the plan groups by."""
    return [line.split("functions=")[0] for line in plan(df).splitlines() if "Aggregate(key" in line]


@pytest.fixture
def small_broadcasts(spark):
    """Tables of 20 kB and more are too large to broadcast, as a table of gigabytes is by default."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_candidate_pairs_are_not_shuffled_to_find_declared_ones(spark):
    prof = [("s", "a", "id", "int"), ("s", "b", "id", "int"), ("s", "c", "id", "int"), ("t", "b", "id", "int"), ("t", "b", "id", "int"), (None, "x", "id", "int"), ("s", None, "id", "int"), ("s", "d", "id", None)]
    con = [("s", "a", "pk", "PRIMARY_KEY", "id", None, None, None), ("t", "b", "u", "UNIQUE", "id", None, None, None),
           ("s", "b", "f", "FOREIGN_KEY", "id", "s", "a", "id"), ("s", "b", "f", "FOREIGN_KEY", "id", "s", "a", "id"), ("s", "b", "f", "FOREIGN_KEY", "id", None, "a", "id"),
           ("s", "c", "f", "FOREIGN_KEY", "id", "t", "b", "other"), ("s", "a", "f", "FOREIGN_KEY", "id", "t", "b", "id"), (None, "x", "f", "FOREIGN_KEY", "id", "s", "a", "id")]
    names = "schema_name string, relation_name string, "
    p = spark.createDataFrame(prof, names + "column_name string, native_type string")
    c = spark.createDataFrame(con, names + "constraint_name string, constraint_kind string, column_name string, referenced_schema_name string, referenced_relation_name string, referenced_column_name string")
    got = L.candidate_pairs(p, c)
    assert got.columns == ["source_schema_name", "source_relation_name", "target_schema_name", "target_relation_name", "column_name", "native_type", "constraint_kind", "constraint_name"]
    targets = [("s", "a", "PRIMARY_KEY", "pk"), ("t", "b", "UNIQUE", "u"), ("t", "b", "UNIQUE", "u")]  # profiled twice, a target twice
    fks = {(x[0], x[1], x[5], x[6]) for x in con if x[3] == "FOREIGN_KEY" and x[7] == "id" and None not in x}
    differ = lambda a, b: a is not None and a != b
    want = [(s, r, ts, tr, "id", "int", k, n) for s, r, _, ty in prof if ty for ts, tr, k, n in targets if (differ(s, ts) or differ(r, tr)) and (s, r, ts, tr) not in fks]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert "LeftAnti" not in plan(got)


def test_rows_of_a_hot_query_id_do_not_meet_in_one_task(spark, small_broadcasts):
    rows = spark.range(50_000).select(F.when(F.col("id") > 0, "q").alias("query_id"), "id")
    bound = spark.range(50_000).select(F.when(F.col("id") >= 0, "q").alias("query_id"), (F.col("id") % 3 + 1).cast("string").alias("query_sha256"))
    got = E.bind_queries(rows, bound)
    assert got.columns == ["query_id", "id", "query_sha256"] and "SortMergeJoin" not in plan(got)
    assert got.agg(F.count("*"), F.count_if(F.col("query_sha256") == "1")).first()[:] == (50_000, 49_999)


def test_stored_rows_of_a_snapshot_are_not_dealt_by_it(spark, tmp_path, small_broadcasts):
    df = spark.range(30_000).select(F.lit("s").alias("snapshot_id"), "id", F.col("id").cast("string").alias("t"))
    snaps = spark.createDataFrame([("a", "s", "2024"), ("a", "none", "2024")], "source_id string, snapshot_id string, analyzed_at string")
    K.ingest({"t": df}, snaps, str(tmp_path))
    got = K.readback(spark, {"t": df}, str(tmp_path), snaps)
    assert not re.search(r"SortMergeJoin[^\n]*LeftSemi", plan(got))
    assert [tuple(r) for r in got.collect()] == [("t", "s", 30_000, 30_000, True)]


def test_rows_of_one_snapshot_are_written_where_they_are(spark, tmp_path, monkeypatch):
    df = spark.range(100).select(F.lit("s").alias("snapshot_id"), "id")
    snaps = spark.createDataFrame([("a", "s", "2024")], "source_id string, snapshot_id string, analyzed_at string")
    hints = []
    plain = type(df).hint
    monkeypatch.setattr(type(df), "hint", lambda self, name, *a: hints.append(name) or plain(self, name, *a))
    K.ingest({"t": df}, snaps, str(tmp_path))
    assert hints == [] and spark.read.parquet(f"{tmp_path}/t").count() == 100
    two = df.withColumn("snapshot_id", F.when(F.col("id") < 50, "s").otherwise("z"))
    K.ingest({"t": two}, snaps.unionByName(snaps.withColumn("snapshot_id", F.lit("z"))), str(tmp_path))
    assert hints == ["rebalance"]
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/t").groupBy("snapshot_id").count().collect())) == [("s", 50), ("z", 50)]


def _deps(spark):
    rows = [("s", "p", "PROCEDURE", "s", "t", "TABLE", "c", "PROVEN", "RESOLVED", "REF"), ("s", "p", "PROCEDURE", "s", "t", "TABLE", "d", "PROVEN", "RESOLVED", "REF"), ("s", "q", "VIEW", "s", "t", "TABLE", None, "NOT_PROVEN", "RESOLVED", "REF"),
            ("s", "q", "VIEW", None, "u", "TABLE", None, "NOT_PROVEN", "RESOLVED", "REF"), ("s", "q", "VIEW", "s", "t", "TABLE", None, "NOT_PROVEN", "UNRESOLVED", "REF")]
    return spark.createDataFrame(rows, ", ".join(f"{x} string" for x in [*N.EDGE, "target_column_name", "column_resolution_state", "resolution_state", "native_dependency_kind"]))


def test_edges_are_made_distinct_before_their_ids_are_made(spark):
    e = N.object_edges(_deps(spark))
    assert e.count() == 3 and e.columns == ["source_object_id", "target_object_id", *N.EDGE, "native_dependency_kind", "edge_sha256"]
    assert not any("object_id" in line for line in keys(e))


def test_edges_of_both_snapshots_are_not_shuffled_whole_to_be_counted_once(spark):
    d = _deps(spark)
    lin = N.lineage(N.object_edges(d), N.column_edges(d))
    changes = lin.select(F.col("source_object_id").alias("object_id"))
    app = spark.createDataFrame([("1", "s", "t", "c"), ("2", "s", "t", "x"), ("3", "s", "u", "c")], "candidate_id string, schema_name string, relation_name string, column_name string")
    got = N.impact(changes, lin, lin, app)
    assert sorted((r.candidate_id, r.impact_class) for r in got.collect()) == [("1", "AFFECTED_NATIVE_COLUMN"), ("2", "POTENTIALLY_AFFECTED_NATIVE_OBJECT")]
    assert not any("evidence_sha256" in line for line in keys(got))
