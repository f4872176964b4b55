"""Benchmark decontamination with spaced seeds.

Words are runs of letters, digits and underscores, lower-cased. A window of 13 words of a document is a leak if it
equals 13 words of a benchmark item but for at most two substituted words. Each of the fixed masks hashes six of nine or fewer
positions and ignores the others; any such window has a mask that meets none of its substitutions, so joining the
hashes of both sides finds every leak. The words around each hit are then compared one by one.

Items of fewer than 13 words are leaks where all their words stand in order; those of fewer than ``least`` words
are too short to tell and never are.

A bitmap of the benchmark's hashes, of fixed size, keeps hashes that the benchmark does not have out of the shuffle; it only saves work.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from estatelens.llm.common import saved

WINDOW, SUBSTITUTIONS = 13, 2
#: Positions that count. Of all 78 ways to substitute two of 13 words, none meets both masks at every place.
MASKS = [(0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8)]
BITS = 26
WORDS = re.compile(r"\w+").findall


class WordHashes:
    """64-bit hashes of a text's words; those of recent pieces between white space are kept, within a bound."""

    def __init__(self, kept: int = 300_000):
        self.kept, self.pieces = kept, {}

    def __call__(self, text: str | None) -> np.ndarray:
        pieces = (text or "").split()
        missing = set(pieces).difference(self.pieces)
        if missing:
            if len(self.pieces) + len(missing) > self.kept:
                self.pieces.clear()
                missing = set(pieces)
            for p in missing:
                self.pieces[p] = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "replace")) for w in WORDS(p.lower())], np.uint64).tobytes()
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, pieces)), np.uint64)


def masks_for(lengths: list[int]) -> list[tuple[int, ...]]:
    """The fixed masks, and a mask without gaps for each item length below the window."""
    return [*MASKS, *(tuple(range(n)) for n in sorted(set(lengths)) if n < WINDOW)]


def seed_hashes(words: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """Hash of the mask's words at each place where the mask fits."""
    n = len(words) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, len(mask) * 1_000_003 + mask[-1], np.uint64)
    for m in mask:
        h = (h ^ words[m:m + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h


def leaks(doc: np.ndarray, item: np.ndarray, shift: int) -> list[tuple[int, int, int]]:
    """(start, end, equal words) of the maximal stretches of doc that leaking windows cover, doc[shift + i] facing item[i]."""
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    width, allowed = (WINDOW, SUBSTITUTIONS) if len(item) >= WINDOW else (len(item), 0)
    if hi - lo < width:
        return []
    equal = doc[shift + lo:shift + hi] == item[lo:hi]
    sums = np.r_[0, np.cumsum(equal)]
    good = np.flatnonzero(sums[width:] - sums[:-width] >= width - allowed)
    out = []
    for g in np.split(good, np.flatnonzero(np.diff(good) > width) + 1) if len(good) else []:
        a, z = int(g[0]), int(g[-1]) + width
        out.append((shift + lo + a, shift + lo + z, int(sums[z] - sums[a])))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", least: int = 5) -> DataFrame:
    """doc_id, item_id, n_leaks, leaked_words, equal_words, first_word, text_key: one row per document and item that it leaks.

    ``leaked_words`` counts the document's words inside leaking windows, ``equal_words`` those of them that are equal.
    Null and empty texts leak nothing. text_key (a hash of the text) tells documents apart that share a doc_id; rows
    equal in both count once. Null ids pass by. Empty tables give an empty result, and extra columns are ignored.
    """
    spark = docs.sparkSession

    def item_rows(batches):
        hashes = WordHashes()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([hashes(x.as_py()).tobytes() for x in b.column(1)], pa.binary())], names=["item_id", "words"])

    kind = benchmark.schema[item_col].dataType.simpleString()
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("t")).mapInArrow(item_rows, f"item_id {kind}, words binary").distinct()
    items = saved(items.withColumn("n", (F.length("words") / 8).cast("int")).where(F.col("n") >= least).withColumn("item", F.xxhash64("item_id", "words")))
    masks = masks_for([r.n for r in items.where(F.col("n") < WINDOW).select("n").distinct().collect()])

    def item_seeds(batches):
        for b in batches:
            out = [[], [], [], []]
            for item, raw in zip(b.column(0).to_pylist(), b.column(1)):
                w = np.frombuffer(raw.as_py(), np.uint64)
                for k, mask in enumerate(masks):
                    if (len(w) >= WINDOW) == (k < len(MASKS)) and (k < len(MASKS) or len(mask) == len(w)):
                        h = seed_hashes(w, mask)
                        for c, x in zip(out, ([item] * len(h), [k] * len(h), h.view(np.int64).tolist(), range(len(h)))):
                            c.extend(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int32()))], names=["item", "mask", "h", "i"])

    seeds = saved(items.select("item", "words").mapInArrow(item_seeds, "item long, mask int, h long, i int"))
    place = F.shiftrightunsigned("h", 64 - BITS)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(31).cast("long")).cast("int"))
    bits = seeds.groupBy(F.shiftright(place, 5).cast("int").alias("w")).agg(F.bit_or(bit).alias("b"))
    bitmap = np.zeros(1 << (BITS - 5), np.uint32)  # of fixed size, whatever the benchmark's
    for r in bits.toLocalIterator():
        bitmap[r.w] = r.b
    shared = spark.sparkContext.broadcast(bitmap)

    def segments(batches):
        hashes, known = WordHashes(), shared.value
        uid = TaskContext.get().partitionId() << 36
        for b in batches:
            out = [[], [], [], [], [], []]
            for doc, t in zip(b.column(0).to_pylist(), b.column(1)):
                raw = t.as_py()
                w = hashes(raw)
                hit = []
                for k, mask in enumerate(masks):
                    h = seed_hashes(w, mask)
                    at = h >> np.uint64(64 - BITS)
                    p = np.flatnonzero((known[(at >> np.uint64(5)).astype(np.int64)] >> (at & np.uint64(31)).astype(np.uint32)) & 1)
                    hit += [(int(x), k, int(h[x])) for x in p]
                if not hit:
                    continue
                hit.sort()
                key = xxhash.xxh64_intdigest(raw.encode("utf-8", "replace")) - (1 << 63)
                groups, reach = [[hit[0]]], hit[0][0]
                for x in hit[1:]:
                    if x[0] - reach > 2 * WINDOW:
                        groups.append([])
                    groups[-1].append(x)
                    reach = x[0]
                for g in groups:
                    lo, hi = max(0, g[0][0] - WINDOW), g[-1][0] + 2 * WINDOW
                    uid += 1
                    for c, x in zip(out, (uid, doc, key, lo, w[lo:hi].tobytes(), [{"mask": k, "h": (h ^ (1 << 63)) - (1 << 63), "p": p - lo} for p, k, h in g])):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["uid", "doc_id", "text_key", "lo", "words", "hits"])

    doc_type = docs.schema[id_col].dataType.simpleString()
    types = (pa.int64(), to_arrow_type(docs.schema[id_col].dataType), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.struct([("mask", pa.int32()), ("h", pa.int64()), ("p", pa.int32())])))
    near = saved(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("t")).mapInArrow(segments, f"uid long, doc_id {doc_type}, text_key long, lo int, words binary, hits array<struct<mask:int,h:bigint,p:int>>"))
    met = near.select("uid", F.inline("hits")).join(seeds, ["mask", "h"]).select("uid", "item", (F.col("p") - F.col("i")).alias("shift")).distinct()
    pairs = met.join(near.drop("hits"), "uid").join(items.select("item", "item_id", F.col("words").alias("item_words")), "item")

    def verify(batches):
        for b in batches:
            out = [[], [], [], [], [], []]
            for doc, key, item, lo, words, item_words, shift in zip(*(c.to_pylist() for c in b.columns)):
                for a, z, n in leaks(np.frombuffer(words, np.uint64), np.frombuffer(item_words, np.uint64), shift):
                    for c, x in zip(out, (doc, key, item, lo + a, lo + z, n)):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (types[1], pa.int64(), b.schema.field("item_id").type, pa.int32(), pa.int32(), pa.int32()))], names=["doc_id", "text_key", "item_id", "a", "z", "equal"])

    found = pairs.select("doc_id", "text_key", "item_id", "lo", "words", "item_words", "shift").mapInArrow(verify, f"doc_id {doc_type}, text_key long, item_id {kind}, a int, z int, equal int").distinct()
    return found.groupBy("doc_id", "text_key", "item_id").agg(F.count("*").alias("n_leaks"), F.sum(F.col("z") - F.col("a")).alias("leaked_words"), F.sum("equal").cast("long").alias("equal_words"), F.min("a").alias("first_word"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without the documents that leak a benchmark item; all columns, whatever their names, and all other rows stay.

    Null and empty texts leak nothing and stay; repeated rows go or stay together; an empty benchmark keeps all.
    """
    bad = contaminated(docs, benchmark, id_col, text, **options).select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")).distinct()

    @F.pandas_udf("long")
    def key(s):
        return s.map(lambda t: xxhash.xxh64_intdigest(t.encode("utf-8", "replace")) - (1 << 63))

    marked = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("own"), key(F.coalesce(F.col(text), F.lit(""))).alias("text_key"))  # names of docs cannot clash
    return marked.join(bad, F.col("own").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key")), "left_anti").select("row.*")
