"""Near copies by exact Jaccard similarity of word shingles, found through SimHash tiles and a complete search.

Equal shingle sets are one node. Candidates come from two searches. SimHash tiles (``simhash.links``) meet fingerprints of
the same shingles within a few bits, which connects most copies at once. A radius that would hold every pair of the wanted
similarity would meet most of the corpus, so prefixes find the rest: two sets of similarity s share a shingle among the
first n - ceil(s n) + 1 of each (n its size), in any order of shingles that is the same everywhere. The order puts
shingles that are frequent in a sample last, which keeps hot passages out of most prefixes; the sample has no say in the
result. So no pair is left to chance.

Under a shingle the nodes are first compared with one of them; nodes that are still in different groups are compared in tiles
of bounded size, so neither a hot shingle nor a large family is gathered. A tile takes the exclusive-or of bitmaps in which each shingle
flips one bit: its bits are at most as many as the sets differ by, so a pair with more is refuted for certain and never
a row. A long text fills such a bitmap, so a long text takes a wider one along, by which its pairs are refuted in the same tile;
pairs of long texts meet once more by bitmaps as wide as their sets ask for.
What is left is compared by whole sets: the members of a hub travel to it, each with its text once, in parts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from estatelens.llm import simhash
from estatelens.llm.common import components
from estatelens.llm.simhash import _LOWER, _SEED, one_per_group, text_hash
from estatelens.session import Scratch

_ROUND = 1e-9
BITS = 1024  # of a bitmap that goes through the tiles
TILE_BITS = 1 << 15  # at most, of the wider bitmap that a long text takes through the tiles
TILE = 512  # nodes of one side of a tile
MEMBERS = 1000  # nodes that meet one hub in one part


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Distinct hashes of the word shingles, ascending. A text of fewer words is one shingle; a text without a word has none."""
    from itertools import repeat
    w = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not w:
        return np.zeros(0, np.uint64)
    shingles = [b" ".join(w)] if len(w) < words else map(b" ".join, zip(*(w[i:] for i in range(words))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(_SEED)), np.uint64, max(1, len(w) - words + 1)))


def prefix(s: np.ndarray, similarity: float, hot: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The shingles of which one is shared by any set that is similar enough. hot: ascending hashes that come last, by weight."""
    n = len(s) - math.ceil(similarity * len(s) - _ROUND) + 1 if len(s) else 0
    if not len(hot):
        return s[:n]
    at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
    return s[np.argsort(np.where(hot[at] == s, weight[at], 0), kind="stable")[:n]]


def hot_shingles(docs: DataFrame, text: str, words: int, sample: int = 4000, most: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """(hashes ascending, counts) of shingles that several texts of a sample hold. They order the search, nothing else."""
    def run(batches):
        for b in batches:
            found = [shingle_set(x.as_py(), words) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found or [np.zeros(0, np.uint64)]).view(np.int64))], names=["h"])

    step = max(1, docs.count() // sample)
    some = docs.where(F.pmod(text_hash(text), F.lit(step)) == 0).select(text).distinct()
    rows = some.mapInArrow(run, "h long").groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(most).toPandas()
    h, n = rows["h"].to_numpy(np.int64).view(np.uint64), rows["count"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def stars(rows: DataFrame) -> DataFrame:
    """(h, hub, sid): under each shingle the least node and every other one, once. rows: (h, sid), repeated for equal texts."""
    def run(batches):
        last = None  # shingle, hub and node that the batch before ended in
        for b in batches:
            h, sid = np.asarray(b.column("h")), np.asarray(b.column("sid"))
            if not len(h):
                continue
            first = np.r_[last is None or h[0] != last[0], h[1:] != h[:-1]]
            at = np.maximum.accumulate(np.where(first, np.arange(len(h)), -1))
            hub = np.where(at >= 0, sid[np.maximum(at, 0)], 0 if last is None else last[1])
            again = np.r_[not first[0] and sid[0] == last[2], sid[1:] == sid[:-1]]
            last = h[-1], hub[-1], sid[-1]
            keep = ~first & ~again & (hub != sid)
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (h, hub, sid)], names=["h", "hub", "sid"])

    return rows.repartition("h").sortWithinPartitions("h", "sid").mapInArrow(run, "h long, hub long, sid long")


def bitmap(s: np.ndarray, bits: int = BITS) -> bytes:
    """Each shingle flips one bit."""
    return np.packbits((np.bincount((s % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(bool)).tobytes()


def wide_bitmap(s: np.ndarray) -> bytes | None:
    """A bitmap of two bits a shingle and more, by doubling; none where ``BITS`` are as many."""
    return bitmap(s, 1 << (2 * len(s) - 1).bit_length()) if 2 * len(s) > BITS else None


def tile_bitmap(s: np.ndarray) -> bytes | None:
    """A bitmap of half a bit to one bit a shingle, up to ``TILE_BITS``; none where ``BITS`` are as many. It goes through the tiles."""
    width = min(TILE_BITS, (1 << (len(s) - 1).bit_length()) // 2 if len(s) else 0)
    return bitmap(s, width) if width > BITS else None


def differing(x: bytes, y: bytes) -> int:
    """In how many bits two bitmaps differ; the halves of the wider one are folded into one until both are as wide."""
    a, b = (np.frombuffer(v, np.uint64) for v in (x, y))
    n = min(len(a), len(b))
    return int(np.bitwise_count(np.bitwise_xor.reduce(a.reshape(-1, n)) ^ np.bitwise_xor.reduce(b.reshape(-1, n))).sum())


def may_be_near(n_a, n_b, differ, similarity: float):
    """Whether sets of these sizes that differ in at least so many shingles can be similar enough."""
    return (np.minimum(n_a, n_b) >= similarity * np.maximum(n_a, n_b) - _ROUND) & (differ <= (1 - similarity) / (1 + similarity) * (n_a + n_b) + _ROUND)


def _bitmaps(column) -> np.ndarray:
    """Binary column as rows of 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, BITS // 64)


def _folded(column: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the distinct rows, folded to width bytes, and where each of rows is among them."""
    used, at = np.unique(rows, return_inverse=True)
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(column[i], np.uint64).reshape(-1, width // 8)) for i in used.tolist()]), at


def stay_near(x: tuple, y: tuple, r: np.ndarray, c: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs (row of x, row of y) the wider bitmaps of two long texts do not refute. x, y: (.., n, wide) as their last columns."""
    out = np.ones(len(r), bool)
    size = lambda column: np.array([len(v or b"") for v in column], np.int64)
    width = np.minimum(size(x[-1])[r], size(y[-1])[c])
    for w in np.unique(width[width > 0]).tolist():
        at = np.flatnonzero(width == w)
        (a, i), (b, j) = _folded(x[-1], r[at], w), _folded(y[-1], c[at], w)
        for lo in range(0, len(at), step := max(1, (1 << 22) // w)):
            some = at[lo:lo + step]
            differ = np.bitwise_count(a[i[lo:lo + step]] ^ b[j[lo:lo + step]]).sum(axis=1)
            out[some] = may_be_near(x[-2][r[some]], y[-2][c[some]], differ, similarity)
    return out


def possible(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The rows of pairs (a, b, ...) that sizes and bitmaps do not refute. nodes: (sid, n, bits)."""
    names = pairs.columns

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            n_a, n_b = (b.column(c).to_numpy().astype(np.int64) for c in ("n_a", "n_b"))
            differ = np.bitwise_count(_bitmaps(b.column("x")) ^ _bitmaps(b.column("y"))).sum(axis=1)
            yield b.select(names).filter(pa.array(may_be_near(n_a, n_b, differ, similarity)))

    side = lambda c, bits: nodes.select(F.col("sid").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(bits))
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema))


def sharper(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The rows of pairs (a, b) that wide bitmaps do not refute. nodes: (sid, n, more); more is null for short texts, whose pairs stay."""
    def run(batches):
        for b in batches:
            both = [(x, y) if x and y else None for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist())]
            known = np.fromiter((v is not None for v in both), bool, b.num_rows)
            differ = np.fromiter((differing(*v) if v else 0 for v in both), np.int64, b.num_rows)
            n_a, n_b = (np.asarray(b.column(c)).astype(np.int64) for c in ("n_a", "n_b"))
            yield b.select(["a", "b"]).filter(pa.array(~known | may_be_near(n_a, n_b, differ, similarity), pa.bool_()))

    side = lambda c, bits: nodes.where("more is not null").select(F.col("sid").alias(c), F.col("n").alias(f"n_{c}"), F.col("more").alias(bits))
    met = pairs.select("a", "b").join(side("a", "x"), "a", "left").join(side("b", "y"), "b", "left")
    return met.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_a", "n_b")}).mapInArrow(run, "a long, b long")


def verified(scratch: Scratch, pairs: DataFrame, wide: DataFrame, nodes: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, b) of distinct pairs that are similar enough by their whole sets. wide: (th, text); nodes: (sid, th, n, more).

    Only texts of nodes in these pairs are read out. A hub's text goes once to each of its parts of some ``MEMBERS`` pairs, a
    member's text once per pair.
    """
    pairs = scratch.keep(sharper(pairs, nodes, similarity))
    need = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct().join(nodes.select("sid", "th"), "sid")
    bodies = scratch.keep(wide.select("th", "text").join(need, "th").groupBy("sid").agg(F.first("text").alias("text")))

    def run(batches):
        known = np.zeros(0, np.uint64)
        for b in batches:
            keep = []
            for other, text in zip(b.column("b").to_pylist(), b.column("text")):
                s = shingle_set(text.as_py(), words)
                if other is None:
                    known = s
                    keep.append(False)
                else:
                    both = len(np.intersect1d(known, s, assume_unique=True))
                    keep.append(both >= similarity * (len(s) + len(known) - both) - _ROUND)
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).alias("parts"))
    keyed = pairs.select("a", "b").join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), "b")
    text = lambda c: bodies.withColumnRenamed("sid", c)
    heads = keyed.select("a", "part").distinct().join(text("a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    rows = heads.unionByName(keyed.join(text("b"), "b"))
    out = scratch.keep(rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first()).mapInArrow(run, "a long, b long"))
    scratch.drop(pairs, bodies)
    return out


def apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The rows of pairs (a, b, ...) whose nodes no link connects yet. label: (node, label) of connected nodes."""
    side = lambda c: label.select(F.col("node").alias(c), F.col("label").alias(f"_{c}"))
    j = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return j.where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select(pairs.columns)


def tile_pairs(members: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b, distinct: nodes under one shingle, of different labels, that bitmaps do not refute.

    members: (h, sid, label, n, bits, wide); wide, if there, is null for short texts. The members of a shingle are dealt into tiles of some ``TILE`` nodes; a label with many
    members has tiles of its own, which need not meet each other. A tile goes to one task, where the members of the tiles that it
    meets stream past it; pairs that fail are never rows. Shingles with the same members count once.
    """
    def run(batches):
        at, left, whole = None, [], False  # (h, tile), rows of the tile, whether its own pairs were compared
        out: tuple[list, list] = ([], [])

        def compare(x, y, own: bool) -> None:
            at = []
            for k in range(0, len(x[0]), 16):
                differ = np.bitwise_count(x[2][k:k + 16, None] ^ y[2][None]).sum(axis=2)
                r, c = np.nonzero(may_be_near(x[3][k:k + 16, None], y[3][None], differ, similarity) & (x[1][k:k + 16, None] != y[1][None]))
                if own:
                    r, c = r[once := x[0][k + r] < y[0][c]], c[once]
                at.append((k + r, c))
            r, c = map(np.concatenate, zip(*at))
            if len(r):
                keep = stay_near(x, y, r, c, similarity)
                u, v = x[0][r[keep]], y[0][c[keep]]
                out[0].append(np.minimum(u, v))
                out[1].append(np.maximum(u, v))

        def found():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *o])) for o in out], names=["a", "b"])

        def tile():
            nonlocal left
            left = [tuple(map(np.concatenate, zip(*left)))]
            return left[0]

        for b in batches:
            out = ([], [])
            if not b.num_rows:
                continue
            h, i, own = (b.column(c).to_numpy(zero_copy_only=False) for c in ("h", "i", "own"))
            sid, label, n, bits = b.column("sid").to_numpy(), b.column("label").to_numpy(), b.column("n").to_numpy().astype(np.int64), _bitmaps(b.column("bits"))
            wide = np.empty(len(h), object)
            wide[:] = b.column("wide").to_pylist()
            cuts = np.r_[0, np.flatnonzero((h[1:] != h[:-1]) | (i[1:] != i[:-1]) | (own[1:] != own[:-1])) + 1, len(h)].tolist()
            for lo, hi in zip(cuts, cuts[1:]):
                rows = sid[lo:hi], label[lo:hi], bits[lo:hi], n[lo:hi], wide[lo:hi]
                if own[lo]:
                    if at != (h[lo], i[lo]):
                        if left and not whole:
                            t = tile()
                            compare(t, t, True)
                        at, left, whole = (h[lo], i[lo]), [], False
                    left.append(rows)
                else:
                    t = tile()
                    if not whole:
                        whole = True
                        compare(t, t, True)
                    for k in range(0, hi - lo, 4 * TILE):
                        compare(t, tuple(x[k:k + 4 * TILE] for x in rows), False)
            yield found()
        out = ([], [])
        if left and not whole:
            t = tile()
            compare(t, t, True)
        yield found()

    if "wide" not in members.columns:
        members = members.withColumn("wide", F.lit(None).cast("binary"))
    same = members.groupBy("h").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("sid")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(1), "sid")).alias("x2"))
    first = same.groupBy("m", "x1", "x2").agg(F.min("h").alias("h")).select("h")
    some = members.join(first, "h")
    sizes = some.groupBy("h", "label").agg(F.count("*").alias("c"))
    big = F.col("c") >= max(1, TILE // 4)
    sizes = sizes.select("h", "label", F.when(big, F.col("label")).alias("pure"), F.when(big, F.ceil(F.col("c") / TILE)).alias("own_parts"))
    small = some.join(sizes.where("pure is null"), ["h", "label"], "left_semi").groupBy("h").agg(F.ceil(F.count("*") / TILE).alias("parts"))
    dealt = some.join(sizes, ["h", "label"]).join(small, "h", "left").withColumn("part", F.pmod(F.xxhash64("sid"), F.coalesce("own_parts", "parts"))).select("h", "sid", "label", "n", "bits", "wide", "pure", "part")
    order = Window.partitionBy("h").orderBy(F.col("pure").isNull(), "pure", "part")  # over tiles, not members; pure ones first
    tiles = dealt.select("h", "pure", "part").distinct().withColumn("t", F.row_number().over(order))
    named = tiles.select(F.col("h").alias("h2"), F.col("pure").alias("pure2"), F.col("part").alias("part2"), "t")
    numbered = dealt.join(named, (F.col("h") == F.col("h2")) & F.col("pure").eqNullSafe(F.col("pure2")) & (F.col("part") == F.col("part2"))).select("h", "sid", "label", "n", "bits", "wide", "pure", "t")
    other = tiles.select("h", F.col("t").alias("i"), F.col("pure").alias("other"))
    met = numbered.join(other, "h").where((F.col("i") == F.col("t")) | ((F.col("i") < F.col("t")) & (F.col("pure").isNull() | F.col("other").isNull() | (F.col("pure") != F.col("other")))))
    rows = met.select("h", "i", (F.col("i") == F.col("t")).alias("own"), "sid", "label", "n", "bits", "wide").repartition("h", "i").sortWithinPartitions("h", "i", F.col("own").desc())
    return rows.mapInArrow(run, "a long, b long").distinct()


def labelled(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, radius: int = 3) -> DataFrame:
    """doc_id, th (hash of the text) and label of every row; rows that links of at least ``similarity`` connect share a label.

    Null and empty texts are equal. Null or repeated doc_ids make no difference. ``radius`` (bits) says how many of the links the
    SimHash tiles bring before the complete search, never which links there are. Tables of the search are removed.
    """
    hot, weight = hot_shingles(docs, text, words)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            out = [[] for _ in range(7)]
            for x in b.column(1):
                s = shingle_set(x.as_py(), words)
                row = (xxhash.xxh3_64_intdigest(s.tobytes()), len(s), prefix(s, similarity, hot, weight).view(np.int64), simhash.fingerprint_of(x.as_py(), words), bitmap(s), wide_bitmap(s), tile_bitmap(s))
                for o, v in zip(out, row):
                    o.append(v)
            sid, fp = (np.array(out[c], np.uint64).view(np.int64) for c in (0, 3))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(sid), pa.array(out[1], pa.int32()), pa.array(out[2], pa.list_(pa.int64())), pa.array(fp), pa.array(out[4], pa.binary()), pa.array(out[5], pa.binary()), pa.array(out[6], pa.binary())], names=["doc_id", "th", "sid", "n", "first", "fp", "bits", "more", "wide"])

    def joined(label: DataFrame) -> DataFrame:
        """The links so far, as one to each node's label."""
        return label.select(F.col("node").alias("a"), F.col("label").alias("b"))

    with Scratch(docs.sparkSession) as scratch:
        wide = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), text_hash(text).alias("th"))
        full = scratch.keep(wide.mapInArrow(run, f"doc_id {kind}, th long, sid long, n int, first array<long>, fp long, bits binary, more binary, wide binary"))
        sets = scratch.keep(full.select("doc_id", "th", "sid"))
        nodes = scratch.keep(full.groupBy("sid").agg(F.min("th").alias("th"), F.first(F.struct("n", "fp", "bits", "more", "wide")).alias("x")).select("sid", "th", "x.*"))
        # prefixes: under each shingle the least node with every other
        star = scratch.keep(stars(full.select(F.explode("first").alias("h"), "sid")))
        scratch.drop(full)
        size = nodes.select("sid", "n", "bits")
        # fingerprints in tiles
        hubs = scratch.keep(nodes.groupBy("fp").agg(F.min("sid").alias("hub")))
        met = simhash.links(hubs.select("fp"), radius)
        hub = lambda c: hubs.select(F.col("fp").alias(c), F.col("hub").alias(f"s_{c}"))
        close = met.join(hub("a"), "a").join(hub("b"), "b").select(F.col("s_a").alias("a"), F.col("s_b").alias("b"))
        close = close.unionByName(nodes.join(hubs, "fp").where("sid <> hub").select(F.col("hub").alias("a"), F.col("sid").alias("b")))
        near = verified(scratch, possible(close.distinct(), size, similarity), wide, nodes, words, similarity)
        label = components(near)
        under = star.groupBy(F.col("hub").alias("a"), F.col("sid").alias("b")).agg(F.count("*").alias("shared"))
        under = scratch.keep(possible(apart(under, label), size, similarity))
        first = under.groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a")).select("a", "b")  # its likeliest hub
        more = verified(scratch, first, wide, nodes, words, similarity)
        label = components(joined(label).unionByName(more))
        rest = apart(under.select("a", "b").join(first, ["a", "b"], "left_anti"), label)
        again = verified(scratch, rest, wide, nodes, words, similarity)
        label = components(joined(label).unionByName(again))
        # members of a shingle that are still in different groups
        left = star.select("h", "sid").join(label.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
        open_ = left.groupBy("h").agg((F.min("label") != F.max("label")).alias("open")).where("open").select("h")
        pairs = tile_pairs(left.join(open_, "h").join(nodes.select("sid", "n", "bits", "wide"), "sid"), similarity)
        pairs = pairs.join(under.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
        last = verified(scratch, pairs, wide, nodes, words, similarity)
        label = components(joined(label).unionByName(last))
        out = sets.join(label.withColumnRenamed("node", "sid"), "sid", "left").select("doc_id", "th", F.coalesce("label", "sid").alias("label"))
        return scratch.keep(out, outlives=True)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row per group of near copies: that of the smallest doc_id. Columns may have any names."""
    return one_per_group(docs, labelled(docs, id_col, text, words, similarity), id_col, text)
