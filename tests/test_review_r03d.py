"""Faults found by the review of round 3, fourth part: a task's memory that grows with its input, and work that is done twice."""

import os
import uuid

from estatelens.operators import catalog as C
from estatelens.operators import graph as G
from estatelens.plans import estate as S


def test_results_are_dealt_by_their_number(spark, monkeypatch):
    columns = spark.createDataFrame([("Sales_Order", f"order_{i}") for i in range(30)] + [("orders", "x"), (None, "border")], "table_name string, column_name string")
    objectives = spark.createDataFrame([(i, "order by ORDER, sales") for i in range(40)] + [(7, "sales"), (None, "border")], "objective_id int, objective string")
    monkeypatch.setattr(C, "PART_ROWS", 10)
    got = C.prioritize_tables(columns, objectives)
    want = {(i, "Sales_Order"): 2 * 33 + 3 for i in range(40)} | {(i, "orders"): 6 for i in range(40)} | {(i, None): 2 for i in range(40)} | {(None, None): 1}
    want[7, "Sales_Order"] += 3
    assert {tuple(r)[:2]: r.score for r in got.collect()} == want
    assert got.rdd.getNumPartitions() >= len(want) // 10


def test_large_tables_are_dealt_by_order(spark, monkeypatch, tmp_path):
    spark.sql("SELECT id AS o_orderkey, id % 7 AS o_custkey, 'F' AS o_orderstatus FROM range(200)").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("SELECT id DIV 3 AS l_orderkey, id % 11 AS l_partkey, id % 5 AS l_suppkey, id % 3 AS l_linenumber, 'A' AS l_returnflag FROM range(620)").write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = lambda df: sorted(map(tuple, df.collect()))
    plain, both = S.estate(spark, str(tmp_path), "columns"), S.sources(spark, str(tmp_path), "columns", "relations")
    want = rows(plain), *map(rows, both)
    assert len(want[0]) == 600 and S.dealt(spark, str(tmp_path)) == {}  # orders 200 to 206 are not there
    monkeypatch.setattr(S, "PART_ROWS", 40)
    assert {t: d.rdd.getNumPartitions() for t, d in S.dealt(spark, str(tmp_path)).items()} == {"orders": 21, "lineitem": 21}
    assert (rows(S.estate(spark, str(tmp_path), "columns")), *map(rows, S.sources(spark, str(tmp_path), "columns", "relations"))) == want


def test_members_of_clusters_are_worked_out_once(spark, tmp_path):
    folder = str(tmp_path)

    def seen(batches):
        open(os.path.join(folder, uuid.uuid4().hex), "w").close()
        yield from batches

    members = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c"), ("d", "d"), ("e", "d"), (None, None)], "node string, component string").coalesce(1).mapInArrow(seen, "node string, component string")
    links = spark.createDataFrame([("a", "b", "PROPOSAL_ONLY", 0), ("b", "a", "COUNTEREVIDENCE_ONLY", 2), ("c", "c", "PROPOSAL_ONLY", 1), ("a", "c", "PROPOSAL_ONLY", 5), ("b", "d", "PROPOSAL_ONLY", 5), (None, "a", "PROPOSAL_ONLY", 1), ("a", "z", "PROPOSAL_ONLY", 1)], "src string, dst string, status string, counter_count int")
    got = G.cluster_summary(members, links).select("component", "member_count", "support", "counter")
    assert {tuple(r) for r in got.collect()} == {("a", 2, 1, 2), ("c", 1, 1, 1), ("d", 2, 0, 0), (None, 1, 0, 0)}
    assert len(os.listdir(folder)) == 1
