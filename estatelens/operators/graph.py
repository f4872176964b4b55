"""Connected clusters, dependency levels and role candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clamp
from ..session import Scratch, cut_lineage, measured


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """G1. (node, component): the least node id of each component; nodes with no edge stand alone.

    Alternating large-star and small-star over (child, parent) edges; every round is a min per node, a combinable
    aggregate, and an equi-join back, which adaptive execution splits where a hub is hot. Rounds grow with the
    logarithm of the component size. Each round is checkpointed so that a lost executor costs one round.
    """
    e = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).filter("u <> v").distinct()
    e = cut_lineage(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut_lineage(moved.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        children = e.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        open_ = children.filter("n > 1").select("u").unionByName(
            e.select(F.col("v").alias("u")).distinct().join(children.select("u"), "u", "left_semi"))
        if open_.isEmpty():
            return nodes.select(F.col("node")).distinct().join(e.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").withColumn(
                "component", F.coalesce("component", "node"))


def clusters(tables: DataFrame, links: DataFrame) -> DataFrame:
    """G1 over proposed links only: counterevidence never merges two tables, unknown tables never join.

    tables: node. links: src, dst, status.
    """
    known = measured(tables.select("node").distinct())
    e = links.filter("status = 'PROPOSAL_ONLY'").select("src", "dst").distinct()
    e = e.join(known.select(F.col("node").alias("src")), "src", "left_semi").join(known.select(F.col("node").alias("dst")), "dst", "left_semi")
    return connected_components(known, e)


def cluster_summary(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members, and the support and counterevidence among links that lie inside a cluster, with confidence bounds.

    links: src, dst, status, counter_count (number of counterevidence items), link_id. Members are worked out once. A link of two
    nodes lies inside a cluster of several members, so only those nodes meet such links.
    """
    m = measured(members.select(F.col("node"), "component"))
    several = m.join(m.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "component", "left_semi")

    def inside(l, of):
        return l.join(of.select(F.col("node").alias("src"), F.col("component").alias("c1")), "src").join(
            of.select(F.col("node").alias("dst"), F.col("component").alias("c2")), "dst").filter("c1 = c2").select("c1", "status", "counter_count")

    l = inside(links.where("src <> dst"), several).unionByName(inside(links.where("src = dst"), m))
    s = l.groupBy(F.col("c1").alias("component")).agg(
        F.count_if(F.col("status") == "PROPOSAL_ONLY").alias("support"), F.sum("counter_count").alias("counter"))
    g = m.groupBy("component").agg(F.count(F.lit(1)).alias("member_count")).join(s, "component", "left")
    g = g.withColumns({"support": F.coalesce("support", F.lit(0)).cast("long"), "counter": F.coalesce("counter", F.lit(0)).cast("long")})
    return with_confidence(g)


def with_confidence(df: DataFrame, support: str = "support", counter: str = "counter") -> DataFrame:
    """Bounds in basis points: clamp(3000 + 1500 support - 1250 counter), and 3000 above it, capped."""
    lo = clamp(F.lit(3000) + F.col(support) * 1500 - F.col(counter) * 1250, 0, 10000)
    return df.withColumn("lower_bps", lo.cast("long")).withColumn("upper_bps", F.greatest(F.col("lower_bps"), F.least(F.col("lower_bps") + 3000, F.lit(10000))).cast("long"))


def _shortcuts(scratch: Scratch, p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pointers (node, t, a, b), level(node) = max(a, level(t) + b), followed to where no pointer starts; and the nodes of
    pointers that never end, which lead into a cycle. Pointers are doubled, so rounds are the logarithm of the longest run that
    ends. A pointer at its end is set aside and only looked up. Where runs remain that end, some end in every round, as each
    holds all shorter ones; so once none does, the pointers left never end."""
    ended, going = [], p.select("node", "t", "a", "b")
    while True:
        n = reduce(DataFrame.unionByName, ended, going)
        if ended:
            n = n.join(going.select(F.col("t").alias("node")).distinct(), "node", "left_semi")
        j = going.join(n.select(F.col("node").alias("t"), F.col("t").alias("t2"), F.col("a").alias("a2"), F.col("b").alias("b2")), "t", "left")
        on = F.col("t2").isNotNull()
        step = scratch.keep(j.select("node", F.coalesce("t2", "t").alias("t"), F.when(on, F.greatest("a", F.col("a2") + F.col("b"))).otherwise(F.col("a")).alias("a"), F.when(on, F.col("b") + F.col("b2")).otherwise(F.col("b")).alias("b"), on.alias("_on")))
        done, left = step.agg(F.count_if(~F.col("_on")), F.count_if(F.col("_on"))).first()
        going = step.where("_on").select("node", "t", "a", "b")
        if done:
            ended.append(step.where("not _on").select("node", "t", "a", "b"))
        if not done or not left:
            return reduce(DataFrame.unionByName, ended) if ended else going.limit(0), going.select("node")


def dependency_levels(nodes: DataFrame, depends: DataFrame) -> DataFrame:
    """G2. Level of each node (0 needs nothing known); a node on or behind a cycle has no level.

    nodes: node. depends: node, needs. A table holds each open node's number of open needs and the level that its placed needs
    ask for; placing nodes lowers the numbers. A node with one open need is a pointer to it: runs of pointers are doubled to
    their ends and set aside, edges into them go to the ends, and they get their levels when the ends have theirs. So
    a chain takes rounds by the logarithm of its length, and so does a cycle; only a run of nodes that keep two open needs
    each takes a round per node. Tables of past rounds are removed. Needs that are not nodes are dangling, see
    ``dangling_needs``, and do not block.
    """
    with Scratch(nodes.sparkSession) as scratch:
        known = scratch.keep(nodes.select("node").where("node is not null").distinct())
        e = depends.filter("node <> needs").select("node", "needs").distinct().join(known.select(F.col("node").alias("needs")), "needs", "left_semi").join(known, "node", "left_semi")
        zero = F.lit(0).cast("long")
        e = scratch.keep(e.select("node", "needs", zero.alias("a"), F.lit(1).cast("long").alias("b")))
        open_ = scratch.keep(known.join(e.groupBy("node").agg(F.count(F.lit(1)).alias("n")), "node", "left").select("node", F.coalesce("n", zero).alias("n"), zero.alias("best")))
        placed, aside = [], []
        while True:
            found = open_.agg(F.count_if(F.col("n") == 0), F.count_if(F.col("n") == 1)).first()
            if not found[0] and not found[1]:
                break
            ready = open_.where("n = 0").select("node", F.col("best").alias("level"))
            single = scratch.keep(open_.where("n = 1").join(e, "node").select("node", F.col("needs").alias("t"), F.greatest("a", "best").alias("a"), "b"))
            ends, endless = _shortcuts(scratch, single) if found[1] else (single, single.select("node"))
            ends = scratch.keep(ends)
            at = ends.join(ready.select(F.col("node").alias("t"), "level"), "t", "left")
            now = scratch.keep(ready.unionByName(at.where("level is not null").select("node", F.greatest("a", F.col("level") + F.col("b")).alias("level"))))
            later = scratch.keep(at.where("level is null").select("node", "t", "a", "b"))
            placed.append(now)
            aside.append(later)
            rest = open_.where("n > 1")
            x = e.join(rest.select("node"), "node", "left_semi").join(now.withColumnRenamed("node", "needs"), "needs", "left")
            x = scratch.keep(x.join(later.select(F.col("node").alias("needs"), "t", F.col("a").alias("a2"), F.col("b").alias("b2")), "needs", "left"))
            asks = x.where("level is not null").groupBy("node").agg(F.max(F.greatest("a", F.col("level") + F.col("b"))).alias("asked"))
            moved = F.col("t").isNotNull()
            edges = x.where("level is null").groupBy("node", F.coalesce("t", "needs").alias("needs")).agg(
                F.max(F.when(moved, F.greatest("a", F.col("a2") + F.col("b"))).otherwise(F.col("a"))).alias("a"), F.max(F.when(moved, F.col("b") + F.col("b2")).otherwise(F.col("b"))).alias("b"))
            edges = scratch.keep(edges)
            counts = edges.groupBy("node").agg(F.count(F.lit(1)).alias("m"))
            new = scratch.keep(rest.join(asks, "node", "left").join(counts, "node", "left").select("node", F.coalesce("m", zero).alias("n"), F.greatest("best", F.coalesce("asked", zero)).alias("best")))
            scratch.drop(open_, e, x, ends, single)
            open_, e = new, edges
            if len(placed) > 16:  # one table instead of many
                old, placed = placed, [scratch.keep(reduce(DataFrame.unionByName, placed))]
                scratch.drop(*old)
        levels = reduce(DataFrame.unionByName, placed) if placed else known.limit(0).withColumn("level", zero)
        for later in reversed(aside):  # ends of a round were placed or set aside in a later one
            if not later.isEmpty():
                got = later.join(levels.withColumnRenamed("node", "t"), "t").select("node", F.greatest("a", F.col("level") + F.col("b")).alias("level"))
                levels = scratch.keep(levels.unionByName(got))
        out = known.join(levels.withColumn("level", F.col("level").cast("int")), "node", "left")
        return scratch.keep(out.withColumn("status", F.when(F.col("level").isNull(), "CYCLE").otherwise("ORDERED")), outlives=True)


def dangling_needs(nodes: DataFrame, depends: DataFrame) -> DataFrame:
    """G2. Needs that point at nothing."""
    return depends.select("node", "needs").join(nodes.select(F.col("node").alias("needs")), "needs", "left_anti").select("node", "needs").distinct()


def self_needs(depends: DataFrame) -> DataFrame:
    """G2. Nodes that need themselves."""
    return depends.filter("node = needs").select("node").distinct()


def role_candidates(evidence: DataFrame) -> DataFrame:
    """G6. Key, temporal-axis, quality-review and link roles with support, counterevidence and confidence.

    evidence: evidence_id, method, state, inferred (bool), target, dst_target, counter (array of reason codes),
    receipt_id. A link proposal gives its role to both of its ends.
    """
    q = F.size("counter") > 0
    roles = F.array_compact(F.array(
        F.when((F.col("method") == "COLUMN_SUMMARY") & F.col("inferred"), F.struct(F.lit("KEY_CANDIDATE").alias("k"), F.col("target").alias("t"))),
        F.when((F.col("method") == "TEMPORAL_COVERAGE") & F.col("state").isin("COMPLETE", "PARTIAL"), F.struct(F.lit("TEMPORAL_AXIS_CANDIDATE").alias("k"), F.col("target").alias("t"))),
        F.when((F.col("method") == "QUALITY_INDICATORS") & q, F.struct(F.lit("QUALITY_REVIEW_CANDIDATE").alias("k"), F.col("target").alias("t"))),
        F.when((F.col("method") == "RELATIONSHIP_OVERLAP") & F.col("inferred"), F.struct(F.lit("RELATIONSHIP_LINK_CANDIDATE").alias("k"), F.col("target").alias("t"))),
        F.when((F.col("method") == "RELATIONSHIP_OVERLAP") & F.col("inferred"), F.struct(F.lit("RELATIONSHIP_LINK_CANDIDATE").alias("k"), F.col("dst_target").alias("t")))))
    r = evidence.select("evidence_id", "receipt_id", "counter", F.explode(roles).alias("r")).select(
        F.col("r.k").alias("role_kind"), F.col("r.t").alias("target"), "evidence_id", "receipt_id", "counter")
    # references are counted, not gathered: a hot target may rest on a third of all evidence
    sup = r.select("role_kind", "target", "evidence_id").distinct().groupBy("role_kind", "target").agg(F.count(F.lit(1)).alias("support"))
    cnt = r.select("role_kind", "target", "evidence_id", F.explode("counter").alias("c")).distinct().groupBy("role_kind", "target").agg(F.count(F.lit(1)).alias("counter"))
    rec = r.select("role_kind", "target", "receipt_id").distinct().groupBy("role_kind", "target").agg(F.count(F.lit(1)).alias("receipts"))
    out = sup.join(cnt, ["role_kind", "target"], "left").join(rec, ["role_kind", "target"]).withColumn("counter", F.coalesce("counter", F.lit(0)).cast("long"))
    return with_confidence(out)


