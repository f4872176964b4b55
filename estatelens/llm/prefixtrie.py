"""Prefix trie of conversations, in balanced parentheses.

A node is a distinct sequence of first turns. Each turn of each conversation gets the key of its prefix by a scan that
runs in blocks, so one very long conversation is spread over the cluster; a combinable aggregate over keys tells how many
conversations share each prefix. What only one conversation has is a chain: its first node goes into the trie as a leaf,
the nodes below need no tree. The rest, at most a few turns a conversation, is sorted as paths of keys, which is the order of
a depth-first walk, and cut into shards of bounded size. A shard writes its paths as balanced parentheses with blocks of
least excess: findclose delimits each subtree, the rank of "()" counts its leaves, and cumulative arrays give members and
savings. Neighbouring shards share a spine of ancestors; only those nodes are partial and are merged by key.

Paths longer than ``band`` turns are cut into bands, worked from the deepest: the totals of a band's root hang below the
node at which the band above ends. A path in a task is so at most a band long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatelens.llm.common import saved

BLOCK = 1024  # turns of one conversation scanned together
BAND = 1024  # longest path in one task
SHARD = 131_072  # nodes of one shard, but for its last path
EXCESS_BLOCK = 64
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


class Parentheses:
    """Balanced parentheses (True opens) with the least excess of each block and of pairs of blocks, level by level."""

    def __init__(self, opens: np.ndarray):
        self.opens = opens
        self.excess = np.cumsum(np.where(opens, 1, -1).astype(np.int32))
        self.rank = np.cumsum(opens)
        n = -(-len(opens) // EXCESS_BLOCK)
        padded = np.full(n * EXCESS_BLOCK, np.iinfo(np.int32).max, np.int32)
        padded[:len(opens)] = self.excess
        self.levels = [padded.reshape(n, EXCESS_BLOCK).min(axis=1)]
        while len(self.levels[-1]) > 1:
            low = self.levels[-1]
            if len(low) % 2:
                low = np.r_[low, np.iinfo(np.int32).max]
            self.levels.append(low.reshape(-1, 2).min(axis=1))

    def _scan(self, at: np.ndarray, goal: np.ndarray, which: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, ...]:
        """Put the first place from at on with excess at or below the goal into out, within at's block; return who has none there."""
        end = np.minimum((at // EXCESS_BLOCK + 1) * EXCESS_BLOCK, len(self.opens))
        none = []
        while len(at):
            hit = self.excess[at] <= goal
            out[which[hit]] = at[hit]
            over = ~hit & (at + 1 >= end)
            none.append((which[over], goal[over], end[over]))
            on = ~hit & ~over
            at, goal, which, end = at[on] + 1, goal[on], which[on], end[on]
        return tuple(map(np.concatenate, zip(*none)))

    def findclose(self, p: np.ndarray) -> np.ndarray:
        """Place of the parenthesis that closes each opening one at p."""
        out = np.full(len(p), -1, np.int64)
        which, goal, end = self._scan(p + 1, self.excess[p] - 1, np.arange(len(p)), out)
        block, level = end // EXCESS_BLOCK, np.zeros(len(end), np.int64)
        k, todo = 0, np.arange(len(which))
        while len(todo):  # up: the next block of a level that may hold the goal is at half the number, rounded up
            todo = todo[self.levels[k][block[todo]] > goal[todo]]
            block[todo] = (block[todo] + 1) // 2
            k += 1
            level[todo] = k
        for k in range(int(level.max(initial=0)) - 1, -1, -1):  # down: to the first half that holds it
            d = np.flatnonzero(level > k)
            block[d] *= 2
            block[d] += self.levels[k][block[d]] > goal[d]
        if len(which):
            self._scan(block * EXCESS_BLOCK, goal, which, out)
        return out


def _range_min(values: np.ndarray, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Least of values[lo:lo+size] for each pair, by tables of powers of two."""
    table = [values]
    while 2 << (len(table) - 1) <= len(values):
        step = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-step], table[-1][step:]))
    k = np.frexp(size.astype(np.float64))[1] - 1
    out = np.empty(len(lo), values.dtype)
    for j in np.unique(k):
        m = k == j
        out[m] = np.minimum(table[j][lo[m]], table[j][lo[m] + size[m] - (1 << int(j))])
    return out


def shard_nodes(stems: list[dict], shared_before: int, shared_after: int) -> dict[str, np.ndarray | list]:
    """Nodes of one shard of sorted, distinct paths, in the order of their first occurrence.

    Each stem has path (keys of 16 bytes, the shard's root first), sizes (bytes of each node's last turn), n, conv, digest,
    and leaves, kids, paid: totals of what hangs below its end in a deeper band. shared_before and shared_after: how
    many leading keys the first and last path share with the neighbouring shards (0 for none).
    """
    keys = [np.frombuffer(s["path"], "V16") for s in stems]
    length = np.array([len(k) for k in keys])
    shared = np.zeros(len(stems), np.int64)
    for i in range(1, len(stems)):
        m = min(length[i - 1], length[i])
        differ = np.flatnonzero(keys[i - 1][:m] != keys[i][:m])
        shared[i] = differ[0] if len(differ) else m
    new = length - shared
    runs = np.empty(2 * len(stems) + 1, np.int64)
    runs[0], runs[1::2] = 0, new
    runs[2::2] = np.r_[length[:-1] - shared[1:], length[-1]]
    tree = Parentheses(np.repeat(np.arange(len(runs)) % 2 == 1, runs))
    total = int(new.sum())
    first = np.cumsum(new) - new
    depth, parent, ends = np.empty(total, np.int64), np.empty(total, np.int64), np.empty(len(stems), np.int64)
    size, key = np.empty(total, np.int64), np.empty(total, "V16")
    owned = np.ones(total, bool)
    spine = np.zeros(total, bool)
    stack = np.full(int(length.max()), -1, np.int64)
    for i, s in enumerate(stems):
        a, z, f = int(shared[i]), int(length[i]), int(first[i])
        ids = np.arange(f, f + z - a)
        stack[a:z] = ids
        depth[ids], key[ids], size[ids] = np.arange(a, z), keys[i][a:], s["sizes"][a:]
        parent[ids] = stack[a - 1:z - 1] if a else np.r_[-1, ids[:-1]]
        ends[i] = stack[z - 1]
        if i == 0:
            owned[ids[:shared_before]] = False
            spine[ids[:shared_before]] = True
        if i == len(stems) - 1:
            spine[stack[:shared_after]] = True
    at = np.flatnonzero(tree.opens)
    sub = (tree.findclose(at) - at + 1) // 2
    lo = np.arange(total)
    hi = lo + sub
    over = lambda x: (c := np.r_[0, np.cumsum(x)])[hi] - c[lo]
    put = lambda name: np.bincount(ends, [s[name] or 0 for s in stems], total).astype(np.int64)
    n = over(put("n"))
    pairs = np.zeros(total, np.int64)
    pairs[tree.rank[np.flatnonzero(tree.opens[:-1] & ~tree.opens[1:])] - 1] = 1
    if shared_after == length[-1]:
        pairs[ends[-1]] = 0  # the next shard goes on below it
    conv = np.full(total, np.iinfo(np.int64).max)
    np.minimum.at(conv, ends, np.array([s["conv"] for s in stems], np.int64))
    kids = put("kids")
    child = owned & (parent >= 0)
    np.add.at(kids, parent[child], 1)
    below = put("leaves") - (put("kids") > 0)
    digest = [None] * total
    for e, s in zip(ends, stems):
        digest[e] = s["digest"]
    least = _range_min(conv, lo, sub)
    # savings: members times bytes over the subtree, less the bytes of each node once; both add up over shards
    return {"key": key, "parent": parent, "depth": depth, "spine": spine, "n": n, "conv": least, "kids": kids, "leaves": over(pairs + below),
            "saved": over(n * size - np.where(owned, size, 0)) + over(put("paid")), "digest": digest}


_STEM = [("pid", "long"), ("path", "binary"), ("sizes", "array<bigint>"), ("n", "long"), ("conv", "long"), ("digest", "string"), ("leaves", "long"), ("kids", "long"), ("paid", "long")]
_NODE = "key binary, parent binary, depth long, spine boolean, n long, conv long, kids long, leaves long, saved long, digest string, parent_conv long, parent_spine boolean"


def _shards(rows: Iterator[dict], around: dict[int, tuple[int, int]], nodes: int) -> Iterator[tuple[list[dict], int, int]]:
    """Runs of sorted stems of about so many nodes, with the lengths shared with the run before and after."""
    def common(a: bytes, b: bytes) -> int:
        m = min(len(a), len(b)) // 16
        d = np.flatnonzero(np.frombuffer(a, "V16", m) != np.frombuffer(b, "V16", m))
        return int(d[0]) if len(d) else m

    held: list[dict] = []
    before = weight = 0
    for s in rows:
        if held and (s["pid"] != held[-1]["pid"] or weight > nodes):
            same = s["pid"] == held[-1]["pid"]
            after = common(held[-1]["path"], s["path"]) if same else around[held[-1]["pid"]][1]
            yield held, before, after
            held, weight, before = [], 0, after if same else around[s["pid"]][0]
        elif not held:
            before = around[s["pid"]][0]
        held.append(s)
        weight += len(s["path"]) // 16
    if held:
        yield held, before, around[held[-1]["pid"]][1]


def _boundaries(sorted_stems: DataFrame) -> dict[int, tuple[int, int]]:
    """How many keys each partition's first and last path share with the neighbouring partition: two numbers a partition."""
    ends = sorted_stems.groupBy("pid").agg(F.min("path").alias("lo"), F.max("path").alias("hi"))
    w = Window.partitionBy(F.lit(0)).orderBy("pid")
    both = ends.select("pid", "lo", "hi", F.lag("hi").over(w).alias("before"), F.lead("lo").over(w).alias("after"))

    def shared(a: str, b: str) -> Column:
        n = F.least(F.length(a), F.length(b)) / 16
        at = F.filter(F.sequence(F.lit(0), F.greatest(n.cast("int") - 1, F.lit(0))), lambda i: F.substring(F.col(a), i * 16 + 1, F.lit(16)) != F.substring(F.col(b), i * 16 + 1, F.lit(16)))
        return F.when(F.col(a).isNull() | F.col(b).isNull(), 0).otherwise(F.coalesce(F.get(at, 0), n.cast("int")))

    return {r.pid: (r.b, r.a) for r in both.select("pid", shared("before", "lo").alias("b"), shared("hi", "after").alias("a")).collect()}


def _band_nodes(stems: DataFrame, parts: int, shard: int) -> DataFrame:
    """Nodes of one band: complete, shared spines merged, with the least conversation of their parents."""
    names = [n for n, _ in _STEM]
    cut = saved(stems.repartitionByRange(parts, "path").withColumn("pid", F.spark_partition_id().cast("long")).select(names))
    around = _boundaries(cut)

    def run(batches):
        def rows():
            for b in batches:
                yield from b.to_pylist()

        for held, before, after in _shards(rows(), around, shard):
            t = shard_nodes(held, before, after)
            up = t["parent"]
            known = np.maximum(up, 0)
            keys = [k.tobytes() for k in t["key"]]
            yield pa.RecordBatch.from_arrays([
                pa.array(keys, pa.binary()), pa.array([None if u < 0 else keys[u] for u in up], pa.binary()), pa.array(t["depth"]), pa.array(t["spine"]), pa.array(t["n"]), pa.array(t["conv"]),
                pa.array(t["kids"]), pa.array(t["leaves"]), pa.array(t["saved"]), pa.array(t["digest"], pa.string()), pa.array(t["conv"][known], mask=up < 0), pa.array(t["spine"][known], mask=up < 0)],
                names=[x.split()[0] for x in _NODE.split(", ")])

    nodes = saved(cut.repartition(parts, "pid").sortWithinPartitions("pid", "path").mapInArrow(run, _NODE))
    spine = nodes.where("spine").groupBy("key", "depth").agg(
        F.max("parent").alias("parent"), F.sum("n").alias("n"), F.min("conv").alias("conv"), F.sum("kids").alias("kids"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max("digest").alias("digest"))
    spine = saved(spine)
    cols = ["key", "parent", "depth", "n", "conv", "kids", "leaves", "saved", "digest"]
    done = nodes.where("not spine").select(*cols, "parent_conv", "parent_spine").unionByName(spine.select(*cols, F.lit(None).cast("long").alias("parent_conv"), F.lit(True).alias("parent_spine")))
    parents = spine.select(F.col("key").alias("parent"), F.col("depth").alias("_d"), F.col("conv").alias("_conv"))
    joined = done.withColumn("_d", F.col("depth") - 1).join(parents, ["parent", "_d"], "left")
    return joined.select(*cols, F.when(F.col("parent_spine"), F.col("_conv")).otherwise(F.col("parent_conv")).alias("parent_conv"))


def ordered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, t1, t2, size): turns numbered from 1 in each conversation, by turn (null first, ties by role and text's hash).

    The table is sorted by ranges, so a conversation may span many tasks; each task numbers its part, and the parts' sizes
    give what to add. Rows without a conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    base = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), F.col("turn"), F.xxhash64(F.lit(1), role, text).alias("t1"), F.xxhash64(F.lit(2), role, text).alias("t2"), F.octet_length(text).cast("long").alias("size"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("t1"), F.col("t2")]
    cut = saved(base.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "t1", "t2", "size", F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", 33).alias("part")
    parts = cut.groupBy("conv_id", part).agg(F.min("at").alias("lo"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("conv_id", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("lo") + 1).alias("add"))
    return cut.withColumn("part", part).join(parts, ["conv_id", "part"]).select("conv_id", (F.col("at") + F.col("add")).alias("pos"), "t1", "t2", "size")


def rebuilt(turns: DataFrame, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations and their lengths: (c, pos, t1, t2, size) and (c, len).

    Conversation c gets the first h turns of conversation c - c % family (all if fewer, none if absent) and its own turns
    after its first h, h being the crc32 of its decimal id modulo ``most``.
    """
    own = saved(ordered_turns(turns))
    sizes = own.groupBy(F.col("conv_id").alias("c")).agg(F.max("pos").alias("own_n"))
    convs = sizes.withColumns({"h": F.crc32(F.col("c").cast("string").cast("binary")) % most, "b": F.col("c") - F.col("c") % family})
    bases = sizes.select(F.col("c").alias("b"), F.col("own_n").alias("base_n")).where(F.col("b") % family == 0)
    convs = convs.join(bases, "b", "left").withColumn("take", F.least(F.col("h"), F.coalesce("base_n", F.lit(0))))
    convs = saved(convs.select("c", "b", "h", "take", (F.col("take") + F.greatest(F.col("own_n") - F.col("h"), F.lit(0))).alias("len")))
    heads = own.where((F.col("pos") < most) & (F.col("conv_id") % family == 0)).withColumnRenamed("conv_id", "b")
    first = convs.where("take > 0").select("c", "b", "take").join(heads, "b").where("pos <= take").select("c", "pos", "t1", "t2", "size")
    rest = own.withColumnRenamed("conv_id", "c").join(convs.select("c", "h", "take"), "c").where("pos > h").select("c", (F.col("pos") - F.col("h") + F.col("take")).alias("pos"), "t1", "t2", "size")
    return first.unionByName(rest), convs.select("c", "len")


def prefix_keys(rows: DataFrame) -> DataFrame:
    """rows (c, pos, t1, t2, size) with k1, k2: the exclusive-or of hashes of (place, turn) over all places up to pos.

    A block of a conversation is scanned on its own; one pair of numbers per block is carried on.
    """
    own = lambda seed: F.xxhash64(F.lit(seed), "pos", "t1", "t2")
    b = rows.withColumns({"blk": F.floor((F.col("pos") - 1) / BLOCK), "x1": own(3), "x2": own(4)})
    inner = Window.partitionBy("c", "blk").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = b.groupBy("c", "blk").agg(F.bit_xor("x1").alias("s1"), F.bit_xor("x2").alias("s2"))
    before = Window.partitionBy("c").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = total.select("c", "blk", *[F.coalesce(F.bit_xor(s).over(before), F.lit(0)).alias(s) for s in ("s1", "s2")])
    scanned = b.withColumns({"y1": F.bit_xor("x1").over(inner), "y2": F.bit_xor("x2").over(inner)}).drop("x1", "x2").join(carry, ["c", "blk"])
    return scanned.select("c", "pos", "t1", "t2", "size", F.col("y1").bitwiseXOR(F.col("s1")).alias("k1"), F.col("y2").bitwiseXOR(F.col("s2")).alias("k2"))


def end_digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, d, n, conv, digest) of rows (k1, k2, d, c): SHA-256 of each group's ids, ascending, decimal, joined by commas.

    The digest is one run over all ids of a group by its definition; ids are packed in sorted chunks by ranges first, so the
    task that hashes a hot group reads a few packed rows in order and never holds the group.
    """
    order = ["k1", "k2", "d", "c"]

    def pack(batches):
        for b in batches:
            k1, k2, d, c = (b.column(i).to_numpy() for i in range(4))
            cuts = np.r_[0, np.flatnonzero((np.diff(k1) != 0) | (np.diff(k2) != 0) | (np.diff(d) != 0)) + 1, len(c)] if len(c) else np.zeros(1, np.int64)
            lo, hi = cuts[:-1], cuts[1:]
            yield pa.RecordBatch.from_arrays([pa.array(k1[lo]), pa.array(k2[lo]), pa.array(d[lo]), pa.array(c[lo]), pa.array(hi - lo), pa.array([",".join(map(str, c[a:z].tolist())) for a, z in zip(lo, hi)], pa.string())], names=[*order, "n", "ids"])

    def digest(batches):
        at, sha, n, conv = None, None, 0, 0
        for b in batches:
            out = [[] for _ in range(6)]
            for k1, k2, d, c, m, ids in zip(*(x.to_pylist() for x in b.columns)):
                if (k1, k2, d) != at:
                    if at:
                        for o, v in zip(out, (*at, n, conv, sha.hexdigest())):
                            o.append(v)
                    at, sha, n, conv = (k1, k2, d), hashlib.sha256(ids.encode()), m, c
                else:
                    sha.update(b"," + ids.encode())
                    n += m
            yield pa.RecordBatch.from_arrays([*(pa.array(o, pa.int64()) for o in out[:5]), pa.array(out[5], pa.string())], names=["k1", "k2", "d", "n", "conv", "digest"])
        if at:
            yield pa.RecordBatch.from_arrays([*(pa.array([v], pa.int64()) for v in (*at, n, conv)), pa.array([sha.hexdigest()], pa.string())], names=["k1", "k2", "d", "n", "conv", "digest"])

    packed = ends.repartitionByRange(*order).sortWithinPartitions(*order).select(order).mapInArrow(pack, "k1 long, k2 long, d long, c long, n long, ids string")
    return packed.repartition("k1", "k2", "d").sortWithinPartitions(*order).mapInArrow(digest, "k1 long, k2 long, d long, n long, conv long, digest string")


def prefix_nodes(turns: DataFrame, family: int = 5, most: int = 9, band: int = BAND, shard: int = SHARD) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row per trie node.

    turns: conv_id, turn, role, text; other columns are ignored. Null roles and texts are empty, turns go by ``turn`` with
    nulls first, ties by a hash of role and text; repeated rows are turns of their own; rows without a conv_id belong to no
    conversation. A conversation without a turn left ends at the root; without a conversation there is no node, so an empty
    table gives an empty result. Two turns are one if 128 bits of hashes of role and text
    agree; prefixes that share a key but not their last turn raise an error.
    """
    rows, convs = rebuilt(turns, family, most)
    keyed = saved(prefix_keys(rows))
    nodes = keyed.groupBy("k1", "k2", "pos").agg(F.count("*").alias("n"), F.min("c").alias("c"), F.min("t1").alias("lo1"), F.max("t1").alias("hi1"), F.min("t2").alias("lo2"), F.max("t2").alias("hi2"))
    nodes = saved(nodes.select("k1", "k2", "pos", "n", "c", F.when((F.col("lo1") == F.col("hi1")) & (F.col("lo2") == F.col("hi2")), F.lit(True)).otherwise(F.raise_error(F.lit("two prefixes share a key")).cast("boolean")).alias("sound")))
    chain = nodes.where("n = 1 and sound").select("c", "pos")
    ends = saved(convs.join(chain.groupBy("c").agg(F.min("pos").alias("alone")), "c", "left"))
    deepest = F.coalesce("alone", "len")
    # stems: where each conversation enters the trie last, and what ends there
    sole = ends.where("alone is not null").select("c", F.col("alone").alias("d"), F.lit(1).cast("long").alias("n"), F.col("c").alias("conv"), F.when(F.col("alone") == F.col("len"), F.sha2(F.col("c").cast("string"), 256)).alias("digest"), (F.col("alone") < F.col("len")).cast("long").alias("kids"))
    joint = ends.where("alone is null").select("c", F.col("len").alias("d"))
    at_root = joint.where("d = 0").select(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "d", "c")
    deep = keyed.join(joint.where("d > 0"), "c").where("pos = d").select("k1", "k2", "d", "c")
    grouped = end_digests(at_root.unionByName(deep)).select(F.col("conv").alias("c"), "d", "n", "conv", "digest", F.lit(0).cast("long").alias("kids"))
    last_band = F.when(F.col("d") > 0, F.floor((F.col("d") - 1) / band)).otherwise(0).cast("int")
    stems = saved(sole.unionByName(grouped).withColumn("band", last_band))
    top = stems.agg(F.max("band"), F.sum(F.col("d") + 1)).first()
    if top[0] is None:
        return turns.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    parts = max(turns.sparkSession.sparkContext.defaultParallelism, -(-int(top[1]) // shard))
    # paths of the stems, cut into bands; the last node of a band is the root of the next
    inside = keyed.join(stems.select("c", "d"), "c").where("pos <= d").select("c", "pos", "k1", "k2", "size")
    inside = inside.unionByName(stems.select("c", F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), F.lit(0).cast("long").alias("size")))
    own = F.greatest(F.floor((F.col("pos") - 1) / band), F.lit(0)).cast("int")
    inside = inside.withColumn("band", F.explode(F.when((F.col("pos") > 0) & (F.col("pos") % band == 0), F.array(own, own + 1)).otherwise(F.array(own))))
    sixteen = lambda x: F.concat(F.lpad(F.hex(x["k1"]), 16, "0"), F.lpad(F.hex(x["k2"]), 16, "0"))
    paths = inside.groupBy("c", "band").agg(F.sort_array(F.collect_list(F.struct("pos", "k1", "k2", "size"))).alias("p"))
    root_free = F.transform("p", lambda x: F.when((x["pos"] == F.col("band") * band), F.lit(0).cast("long")).otherwise(x["size"]))
    paths = paths.select("c", "band", F.unhex(F.array_join(F.transform("p", sixteen), "")).alias("path"), root_free.alias("sizes"))
    many = int(top[0]) > 0
    paths = saved(paths) if many else paths
    zero = F.lit(0).cast("long")
    result, below, heads = None, None, None
    for k in range(int(top[0]), -1, -1):
        here = stems.where(F.col("band") == k).select("c", "n", "conv", "digest", F.col("kids").alias("leaves"), "kids", zero.alias("paid"))
        if below is not None:
            here = here.unionByName(below)
        here = paths.where(F.col("band") == k).drop("band").join(here, "c")
        if below is not None:  # several may end at one node
            here = here.groupBy("path").agg(F.first("sizes").alias("sizes"), F.sum("n").alias("n"), F.min("conv").alias("conv"), F.max("digest").alias("digest"), *[F.sum(x).alias(x) for x in ("leaves", "kids", "paid")])
        found = _band_nodes(here, parts, shard)
        found = saved(found) if many else found
        if heads is not None:  # the parents of the deeper band's first level are this band's last
            known = found.where(F.col("depth") == band).select(F.col("key").alias("parent"), F.col("conv").alias("_conv"))
            result = result.unionByName(heads.join(known, "parent").withColumn("parent_conv", F.col("_conv")).drop("_conv"))
            heads = None
        if k:
            below = found.where("depth = 0").select(F.col("conv").alias("c"), "n", "conv", F.lit(None).cast("string").alias("digest"), "leaves", "kids", F.col("saved").alias("paid"))
            heads = found.where("depth = 1").withColumn("depth", F.lit(k * band + 1).cast("long"))
            found = found.where("depth > 1")
        found = found.withColumn("depth", F.col("depth") + k * band)
        result = found if result is None else result.unionByName(found)
    inner = result.select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"),
                          F.col("saved").alias("saved_tokens"), F.coalesce("digest", F.lit(EMPTY_SHA)).alias("ends_sha256"))
    # the first node of a chain is in the trie; one child and so on below it
    tails = chain.join(ends.where("alone is not null"), "c")
    tails = tails.where("pos > alone").select(
        F.col("c").alias("conv_id"), F.col("pos").alias("depth"), F.col("c").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), F.when(F.col("pos") < F.col("len"), 1).otherwise(0).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), zero.alias("saved_tokens"), F.when(F.col("pos") == F.col("len"), F.sha2(F.col("c").cast("string"), 256)).otherwise(F.lit(EMPTY_SHA)).alias("ends_sha256"))
    return inner.unionByName(tails)
