"""SimHash near-duplicates: exact comparison of all fingerprints, in tiles.

Fingerprints are compared whole, not through bands: a tile holds fingerprints whose four 16-bit quarters have the same
population counts. The counts of two fingerprints within ``radius`` bits differ by at most ``radius`` in sum, so a tile
only meets tiles whose counts are that near, by an equi-join on the counts; all other tile pairs are skipped. Inside
a pair of tiles numpy takes the exclusive-or of every pair and counts bits.

Equal fingerprints are one row before any comparison, so copies cost nothing. A dense pair of tiles (near copies of one
text) gives a spanning forest of its links instead of all of them, which keeps the components. A class with many
fingerprints is cut into several tiles of about ``tile`` rows.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.llm.common import components, saved

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SEED = 42


def fingerprint_of(text: str | None, words: int = 3) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a text; zero for a text without a word."""
    from itertools import repeat
    w = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not w:
        return 0
    shingles = [b" ".join(w)] if len(w) < words else map(b" ".join, zip(*(w[i:] for i in range(words))))
    n = max(1, len(w) - words + 1)
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(_SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, 65536):
        ones += np.unpackbits(h[lo:lo + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp, th): fp is the fingerprint's bits as a signed long, th a hash of the text. One pass over whole texts, no shuffle."""
    def run(batches):
        for b in batches:
            fp = np.array([fingerprint_of(x.as_py(), words) for x in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), b.column(2)], names=["doc_id", "fp", "th"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), text_hash(text).alias("th")).mapInArrow(run, f"doc_id {kind}, fp long, th long")


def text_hash(text: str) -> Column:
    """Tells apart texts that share a doc_id. A null text is empty."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def counts_key(fp: Column) -> Column:
    """The population counts of the four quarters, 5 bits each."""
    quarter = lambda i: F.bit_count(F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))).cast("int")
    key = quarter(0)
    for i in (1, 2, 3):
        key = key + quarter(i) * (1 << 5 * i)
    return key


def near_steps(radius: int) -> list[int]:
    """Differences of keys whose counts differ by at most radius in sum, each pair of opposite ones once."""
    steps = [s for s in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, s)) <= radius]
    return sorted(k for k in {sum(x * (1 << 5 * i) for i, x in enumerate(s)) for s in steps} if k >= 0)


def tile_links(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (into a, into b) within radius; where they are many, a spanning forest of them."""
    near = np.empty((len(a), len(b)), bool)
    for lo in range(0, len(a), 256):
        near[lo:lo + 256] = np.bitwise_count(a[lo:lo + 256, None] ^ b[None, :]) <= radius
    if same:
        near &= np.triu(np.ones(near.shape, bool), 1)
    if np.count_nonzero(near) <= len(a) + len(b):
        return np.nonzero(near)
    if same:
        near |= near.T
    out_a, out_b = [], []
    left_a, left_b = near.any(axis=1), np.ones(len(b), bool)
    while left_a.any():  # one tree per round, breadth first
        rows = np.array([int(left_a.argmax())])
        left_a[rows] = False
        if same:
            left_b[rows] = False
        while len(rows):
            new = near[rows] & left_b
            cols = np.flatnonzero(new.any(axis=0))
            if not len(cols):  # rows without a column that is new: the tree is whole
                break
            out_a.append(rows[new[:, cols].argmax(axis=0)])
            out_b.append(cols)
            left_b[cols] = False
            if same:
                rows = cols
                left_a[cols] = False
            else:
                back = near[:, cols] & left_a[:, None]
                rows = np.flatnonzero(back.any(axis=1))
                out_a.append(rows)
                out_b.append(cols[back[rows].argmax(axis=1)])
                left_a[rows] = False
    return np.concatenate(out_a), np.concatenate(out_b)


def links(distinct: DataFrame, radius: int = 2, tile: int = 2048) -> DataFrame:
    """(a, b) fingerprints, enough links within radius to connect all that are linked. distinct: one row per fp."""
    keyed = distinct.select("fp", counts_key(F.col("fp")).alias("key"))
    sizes = keyed.groupBy("key").agg(F.ceil(F.count("*") / tile).cast("int").alias("n_tiles"))
    # at most 17^4 classes of counts exist, so their table has a fixed bound
    tiles = saved(keyed.join(F.broadcast(sizes), "key").groupBy("key", F.pmod(F.xxhash64("fp"), "n_tiles").cast("int").alias("part")).agg(F.collect_list("fp").alias("fps")))
    left = tiles.select(F.col("key").alias("own"), F.col("part").alias("own_part"), F.col("fps").alias("a"), F.explode(F.array(*[F.col("key") + s for s in near_steps(radius)])).alias("key"))
    pairs = left.join(tiles.withColumnRenamed("fps", "b"), "key").where((F.col("own") != F.col("key")) | (F.col("own_part") <= F.col("part")))

    def run(batches):
        for batch in batches:
            keep = ([], [])
            same = np.asarray(batch.column("same"))
            cols = []
            for name in ("a", "b"):
                c = batch.column(name)
                cols.append((np.asarray(c.flatten()).view(np.uint64), np.r_[0, np.cumsum(np.asarray(c.value_lengths()))]))
            for i in range(batch.num_rows):
                a, b = (v[o[i]:o[i + 1]] for v, o in cols)
                x, y = tile_links(a, b, radius, bool(same[i]))
                keep[0].append(a[x])
                keep[1].append(b[y])
            if keep[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(k).view(np.int64)) for k in keep], names=["a", "b"])

    one = (F.col("own") == F.col("key")) & (F.col("own_part") == F.col("part"))
    return pairs.select("a", "b", one.cast("int").alias("same")).repartition(F.xxhash64("own", "own_part", "key", "part")).mapInArrow(run, "a long, b long")


def grouped(fps: DataFrame, radius: int, tile: int) -> DataFrame:
    """(fp, first, label) of each distinct fp: its smallest doc_id and the smallest fp of its component."""
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    label = components(links(distinct, radius, tile))
    return distinct.join(label.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 3, radius: int = 2, tile: int = 2048) -> DataFrame:
    """doc_id, fp, component_id of every row: the smallest doc_id that links of at most ``radius`` bits reach.

    Null and empty texts have fingerprint zero and are linked like any other. A component whose doc_ids are all null
    has a null component_id; other null doc_ids take their component's. Repeated rows are in one component.
    Extra columns are ignored, an empty table gives an empty result.
    """
    fps = saved(fingerprints(docs, id_col, text, words))
    joined = grouped(fps, radius, tile)
    lowest = joined.groupBy("label").agg(F.min("first").alias("component_id"))
    ids = joined.join(lowest, "label").select("fp", "component_id")
    return fps.join(ids, "fp").select("doc_id", "fp", "component_id")


def one_per_group(docs: DataFrame, rows: DataFrame, id_col: str, text: str) -> DataFrame:
    """docs with one row per label: that of the smallest doc_id, null ids last (of equal ids, the text least by hash). rows: (doc_id, th, label) of every row."""
    from pyspark.sql import Window
    stay = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("s")).select(F.col("s.doc_id").alias("id"), F.col("s.th").alias("stay"))
    packed = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("own"), text_hash(text).alias("th"))  # names of docs cannot clash
    kept = packed.join(stay, F.col("own").eqNullSafe(F.col("id")) & (F.col("th") == F.col("stay")))
    order = Window.partitionBy("own", "th").orderBy(F.lit(0))  # of rows that repeat id and text, one
    return kept.withColumn("nth", F.row_number().over(order)).where("nth = 1").select("row.*")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 3, radius: int = 2, tile: int = 2048) -> DataFrame:
    """docs with one row per component, also where doc_ids are null or repeated."""
    fps = saved(fingerprints(docs, id_col, text, words))
    return one_per_group(docs, fps.join(grouped(fps, radius, tile), "fp").select("doc_id", "th", "label"), id_col, text)
