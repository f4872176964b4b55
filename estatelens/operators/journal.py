"""Outcome journals as an associative scan.

An event moves a context from one state to the next if the step is legal and, where the event names an expected version, if
the version is that one; each accepted event adds one to the version. What a run of events does to a context is a map: for
each state a default (next state, events accepted), and exceptions for the versions that one of its events names. Maps
compose, so a context is cut into blocks of sequence numbers, blocks become maps, maps compose pairwise in a tree of joins,
and the way back down gives each block its first state. No task sees more of a context than one block. Neighbouring blocks that
hold few events are one, as a map has a row for each state and would be larger than the events it stands for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import JOURNAL_START, JOURNAL_TRANSITIONS
from ..functions.scalars import int_div
from ..functions.scans import complete_groups
from ..session import Scratch

STATES = sorted({s for a, _, b in JOURNAL_TRANSITIONS for s in (a, b)})
EVENTS = sorted({e for _, e, _ in JOURNAL_TRANSITIONS})
NEXT = np.full((len(STATES), len(EVENTS) + 1), -1)  # the last column: an event that no state knows
for _a, _e, _b in JOURNAL_TRANSITIONS:
    NEXT[STATES.index(_a), EVENTS.index(_e)] = STATES.index(_b)
VERDICTS = np.array(["ACCEPTED", "ILLEGAL_TRANSITION", "STALE_VERSION"], object)
EVENTS_PER_BLOCK = 1024
FEW = 16  # events; blocks that begin within the same so many of a context are one


class _Blocks:
    """Events of several whole blocks, walked side by side: step t takes the t-th event of every block that has one."""

    def __init__(self, df: pd.DataFrame):
        new = (df[["context_digest", "j"]] != df[["context_digest", "j"]].shift()).any(axis=1).to_numpy()
        first = np.flatnonzero(new)
        length = np.diff(np.r_[first, len(df)])
        order = np.argsort(-length, kind="stable")
        self.first, self.length = first[order], length[order]
        self.code = pd.Index(EVENTS).get_indexer(df["event_type"])
        self.named = df["expected_version"].notna().to_numpy()
        self.version = df["expected_version"].fillna(0).to_numpy(np.int64)

    def steps(self) -> Iterator[np.ndarray]:
        for t in range(int(self.length.max(initial=0))):
            yield self.first[:np.searchsorted(-self.length, -t, side="left")] + t


def block_maps(df: pd.DataFrame) -> pd.DataFrame:
    """(context_digest, j, m, s, v0, to_s, add) of whole blocks: defaults have no v0, exceptions start at version v0."""
    b = _Blocks(df)
    n, k = len(b.first), len(STATES)
    state, count = np.tile(np.arange(k), (n, 1)), np.zeros((n, k), np.int64)
    part = [np.zeros(0, np.int64) for _ in range(5)]  # exceptions under way: block, first state, first version, state, count
    for at in b.steps():
        code, named, version = b.code[at], b.named[at], b.version[at]
        blk, s0, v0, s, c = part
        going = np.flatnonzero(blk < len(at))
        e = blk[going]
        to = NEXT[s[going], code[e]]
        ok = (to >= 0) & (~named[e] | (version[e] == v0[going] + c[going]))
        s[going[ok]] = to[ok]
        c[going[ok]] += 1
        to = NEXT[state[:len(at)], code[:, None]]
        legal = to >= 0
        row, col = np.nonzero(legal & named[:, None])
        born = [row, col, version[row] - count[row, col], to[row, col], count[row, col] + 1]
        part = [np.concatenate(x) for x in zip(part, [x[born[2] >= 0] for x in born])]
        free = legal & ~named[:, None]
        state[:len(at)][free] = to[free]
        count[:len(at)] += free
    blk, s0, v0, s, c = part
    order = np.lexsort((np.arange(len(blk)), v0, s0, blk))
    same = np.r_[False, (blk[order][1:] == blk[order][:-1]) & (s0[order][1:] == s0[order][:-1]) & (v0[order][1:] == v0[order][:-1])] if len(blk) else np.zeros(0, bool)
    keep = order[~same]  # the event that meets a version first decides
    heads = df.iloc[b.first]
    rows = np.r_[np.repeat(np.arange(n), k), blk[keep]]
    return pd.DataFrame({
        "context_digest": heads["context_digest"].to_numpy()[rows], "j": heads["j"].to_numpy()[rows], "m": heads["m"].to_numpy()[rows],
        "s": np.r_[np.tile(np.arange(k), n), s0[keep]], "v0": pd.array(np.r_[np.full(n * k, -1), v0[keep]], "Int64").astype("Int64"),
        "to_s": np.r_[state.ravel(), s[keep]], "add": np.r_[count.ravel(), c[keep]]})


def block_verdicts(df: pd.DataFrame) -> pd.DataFrame:
    """verdict and to_state of each event of whole blocks, whose rows carry their block's first state s and version v."""
    b = _Blocks(df)
    state, version = df["s"].to_numpy()[b.first].copy(), df["v"].to_numpy()[b.first].copy()
    verdict, to_state = np.zeros(len(df), np.int64), np.full(len(df), -1)
    for at in b.steps():
        n = len(at)
        to = NEXT[state[:n], b.code[at]]
        stale = b.named[at] & (b.version[at] != version[:n])
        ok = ~stale & (to >= 0)
        verdict[at] = np.where(stale, 2, np.where(ok, 0, 1))
        to_state[at[ok]] = to[ok]
        state[:n][ok] = to[ok]
        version[:n] += ok
    names = np.array([*STATES, None], object)
    return pd.DataFrame({"context_digest": df["context_digest"], "seq": df["seq"], "event_type": df["event_type"], "verdict": VERDICTS[verdict], "to_state": names[to_state]})


MAPS = "context_digest string, j long, m long, s int, v0 long, to_s int, add long"
OUT = "context_digest string, seq long, event_type string, verdict string, to_state string"


def _apply(starts: DataFrame, maps: DataFrame) -> DataFrame:
    """starts (context_digest, j, s, v) moved through the map of node j: default, or the exception for that version."""
    usual = maps.where("v0 < 0").select("context_digest", "j", "s", F.col("to_s").alias("d_s"), F.col("add").alias("d_n"))
    other = maps.where("v0 >= 0").select("context_digest", "j", "s", F.col("v0").alias("v"), F.col("to_s").alias("x_s"), F.col("add").alias("x_n"))
    met = starts.join(usual, ["context_digest", "j", "s"]).join(other, ["context_digest", "j", "s", "v"], "left")
    return met.select("context_digest", "j", F.coalesce("x_s", "d_s").alias("s"), (F.col("v") + F.coalesce("x_n", "d_n")).alias("v"))


def _compose(maps: DataFrame) -> DataFrame:
    """Maps of neighbouring nodes 2i and 2i + 1 as the map of node i; a last node without a neighbour stays."""
    key = ["context_digest", "p"]
    up = maps.withColumn("p", int_div(F.col("j"), F.lit(2))).withColumn("right", F.col("j") % 2 == 1)
    m = int_div(F.col("m") + 1, F.lit(2)).alias("m")
    pick = lambda d, pre: d.select(*key, "m", *[F.col(x).alias(pre + x) for x in ("s", "v0", "to_s", "add")])
    left, right = up.where("not right and j < m - 1"), up.where("right").drop("m").withColumn("m", F.lit(0))
    ad, ae = pick(left.where("v0 < 0"), "a_"), pick(left.where("v0 >= 0"), "a_")
    bd, be = pick(right.where("v0 < 0"), "b_").drop("m"), pick(right.where("v0 >= 0"), "b_").drop("m")
    row = lambda s, v, t, n: ["context_digest", F.col("p").alias("j"), m, F.col(s).alias("s"), v.alias("v0"), t.alias("to_s"), n.alias("add")]
    meets = lambda d: d.withColumn("b_s", F.col("a_to_s"))
    usual = meets(ad).join(bd, [*key, "b_s"]).select(row("a_s", F.lit(-1).cast("long"), F.col("b_to_s"), F.col("a_add") + F.col("b_add")))
    x = be.select(*key, "b_s", F.col("b_v0").alias("at"), F.col("b_to_s").alias("x_s"), F.col("b_add").alias("x_n"))
    first = meets(ae).join(bd, [*key, "b_s"]).withColumn("at", F.col("a_v0") + F.col("a_add")).join(x, [*key, "b_s", "at"], "left")
    first = first.select(row("a_s", F.col("a_v0"), F.coalesce("x_s", "b_to_s"), F.col("a_add") + F.coalesce("x_n", "b_add")))
    later = meets(ad).drop("a_v0").join(be, [*key, "b_s"]).withColumn("a_v0", F.col("b_v0") - F.col("a_add")).where("a_v0 >= 0")
    later = later.join(ae.select(*key, "a_s", "a_v0"), [*key, "a_s", "a_v0"], "left_anti").select(row("a_s", F.col("a_v0"), F.col("b_to_s"), F.col("a_add") + F.col("b_add")))
    alone = up.where("not right and j = m - 1").select("context_digest", F.col("p").alias("j"), m, "s", "v0", "to_s", "add")
    return usual.unionByName(first).unionByName(later).unionByName(alone)


def judge_events(events: DataFrame, known: DataFrame, block: int = EVENTS_PER_BLOCK) -> DataFrame:
    """T3/T4. Verdict of each event: (context_digest, seq, event_type, verdict, to_state).

    events: context_digest string, seq long (unique in a context), event_type, expected_version long or null. known:
    context_digest, state, version of contexts that are under way; others begin at the start state, version 0.
    ACCEPTED events move the context to to_state, ILLEGAL_TRANSITION and STALE_VERSION change nothing. Contexts with
    one block need no map; the tree is as high as the logarithm of the most blocks of a context.
    """
    with Scratch(events.sparkSession) as scratch:
        e = events.select("context_digest", "seq", "event_type", F.col("expected_version").cast("long"), int_div(F.col("seq"), F.lit(block)).alias("blk"))
        w = Window.partitionBy("context_digest")
        blocks = e.groupBy("context_digest", "blk").agg(F.count(F.lit(1)).alias("n"))
        begins = F.sum("n").over(w.orderBy("blk").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
        blocks = blocks.withColumn("at", F.when(F.col("blk").isNotNull(), int_div(begins, F.lit(FEW))))
        blocks = blocks.withColumn("j", (F.dense_rank().over(w.orderBy("at")) - 1).cast("long")).withColumn("m", F.max("j").over(w) + 1)
        blocks = scratch.keep(blocks.select("context_digest", "blk", "j", "m"))
        sort = lambda d: d.repartition("context_digest", "j").sortWithinPartitions("context_digest", "j", "seq")
        code = F.create_map(*[y for i, s in enumerate(STATES) for y in (F.lit(s), F.lit(i))])
        start = blocks.where("j = 0").select("context_digest", "j").distinct().join(known, "context_digest", "left").select("context_digest", "j", F.coalesce(code[F.col("state")], F.lit(STATES.index(JOURNAL_START))).alias("s"), F.coalesce(F.col("version"), F.lit(0)).cast("long").alias("v"))
        start = scratch.keep(start)
        most = blocks.agg(F.max("m")).first()[0] or 1
        if most > 1:
            many = e.join(blocks.where("m > 1"), ["context_digest", "blk"])
            levels = [scratch.keep(sort(many).mapInPandas(lambda it: map(block_maps, complete_groups(it, ["context_digest", "j"])), MAPS))]
            while 2 ** len(levels) < most:
                levels.append(scratch.keep(_compose(levels[-1])))
            for maps in reversed(levels):
                sizes = maps.select("context_digest", F.col("m").alias("_m")).distinct()
                left = start.withColumn("j", F.col("j") * 2)
                right = _apply(left, maps).withColumn("j", F.col("j") + 1).join(sizes, "context_digest").where("j < _m").drop("_m")
                start = scratch.keep(left.unionByName(right))
        ready = e.join(blocks.join(start, ["context_digest", "j"]), ["context_digest", "blk"])
        return scratch.keep(sort(ready).mapInPandas(lambda it: map(block_verdicts, complete_groups(it, ["context_digest", "j"])), OUT), outlives=True)


def states_after(verdicts: DataFrame, known: DataFrame) -> DataFrame:
    """(context_digest, state, version) of the contexts that the verdicts touch."""
    ok = F.col("verdict") == "ACCEPTED"
    moved = verdicts.groupBy("context_digest").agg(F.max_by("to_state", F.when(ok, F.col("seq"))).alias("_s"), F.count_if(ok).alias("_n"))
    return moved.join(known, "context_digest", "left").select(
        "context_digest", F.coalesce("_s", "state", F.lit(JOURNAL_START)).alias("state"), (F.coalesce("version", F.lit(0)) + F.col("_n")).cast("long").alias("version"))
