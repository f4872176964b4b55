"""Dependency levels of long chains, cycles and random graphs."""

import os
import random

from pyspark.sql import functions as F

from estatelens import session
from estatelens.operators import graph


def brute(nodes, edges):
    needs = {n: {b for a, b in edges if a == n and b in nodes and b != n} for n in nodes}
    level = {}
    while True:
        new = {n: 1 + max((level[b] for b in needs[n]), default=-1) for n in nodes if n not in level and needs[n] <= level.keys()}
        if not new:
            return {n: level.get(n) for n in nodes}
        level |= new


def test_a_long_chain_and_a_long_cycle(spark, monkeypatch):
    n, folders, rounds = 2000, [], []
    shared, keep = session.shared_folder, session.Scratch.keep
    monkeypatch.setattr(session, "shared_folder", lambda s: folders.append(shared(s)) or folders[-1])
    monkeypatch.setattr(session.Scratch, "keep", lambda self, df, outlives=False: rounds.append(1) or keep(self, df, outlives))
    chain = spark.range(n).select(F.concat(F.lit("c"), "id").alias("node"), F.concat(F.lit("c"), F.col("id") - 1).alias("needs"))
    ring = spark.range(n).select(F.concat(F.lit("r"), "id").alias("node"), F.concat(F.lit("r"), (F.col("id") + 1) % n).alias("needs"))
    behind = spark.createDataFrame([("after", "r7"), ("after", "c5"), ("both", "c9"), ("both", "c1990")], "node string, needs string")
    edges = chain.unionByName(ring).unionByName(behind)
    got = {r.node: r.level for r in graph.dependency_levels(edges.select("node"), edges).collect()}
    assert all(got[f"c{i}"] == i for i in range(n)) and all(got[f"r{i}"] is None for i in range(n))
    assert got["after"] is None and got["both"] == 1991
    assert len(rounds) < 60  # tables written: by the logarithm of the length, not by the length
    assert len(os.listdir(folders[-1])) == 1  # the result alone is left


def test_random_graphs(spark):
    for seed in range(3):
        rnd = random.Random(seed)
        nodes = [f"n{i}" for i in range(60)]
        edges = [(f"n{i}", f"n{rnd.randrange(max(0, i - 6), i + (rnd.random() < 0.02) * 5 + 1)}") for i in range(60) for _ in range(rnd.choice([0, 1, 1, 1, 2, 3]))]
        edges += [("n3", "absent"), ("absent", "n4"), ("n5", "n5")] + edges[:5]
        got = {r.node: r.level for r in graph.dependency_levels(spark.createDataFrame([(x,) for x in nodes], "node string"), spark.createDataFrame(edges, "node string, needs string")).collect()}
        assert got == brute(set(nodes), edges)


def test_no_nodes(spark):
    assert graph.dependency_levels(spark.createDataFrame([], "node string"), spark.createDataFrame([], "node string, needs string")).count() == 0
