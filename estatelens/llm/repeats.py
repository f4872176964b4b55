"""Removal of repeated byte strings across documents, by external suffix sorting of shards.

Two equal strings of ``length`` bytes have the same least hash among their k-byte pieces. Each document is cut into runs
of starts whose strings share that least hash (the anchor); equal strings therefore meet under one anchor, whatever
documents they are in. Of runs with the same anchor and the same bytes only the first is looked at further, the others
are repeats as they stand, so exact copies and hot passages are settled by an aggregate. Runs that share an anchor but
not their bytes, and runs long enough to repeat themselves, go to the suffix sorter, a shard of anchors per task, which finds equal strings within them. A shard may
be far larger than memory.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from estatelens.llm import suffixsort
from estatelens.llm.common import saved
from estatelens.session import shared_folder

PIECE = 20
NULL_ID = -(1 << 63)
#: UTF-8 has no byte above 0xF4: bytes are shifted by one, 0xFF ends a run and 0 the shard.
SHIFT = bytes([*range(1, 256), 255])


def piece_hashes(b: np.ndarray) -> np.ndarray:
    """Hash of the PIECE bytes at each place."""
    words = np.ndarray((len(b) - 7,), "<u8", buffer=b, strides=(1,))
    n = len(b) - PIECE + 1
    h = words[:n] * np.uint64(0x9E3779B97F4A7C15) + words[8:8 + n] * np.uint64(0xC2B2AE3D27D4EB4F)
    h += words[PIECE - 8:PIECE - 8 + n] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def sliding(h: np.ndarray, width: int, of) -> np.ndarray:
    """np.minimum or np.maximum over every window of ``width``, by windows that grow by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        h = of(h[:-step], h[step:])
        have += step
    return h


def runs_of(b: bytes, length: int) -> list[tuple[int, int, int, int, bool]]:
    """(anchor, hash of the run's bytes, first start, number of starts, may repeat itself) of each run of a document.

    A run in which a string occurs twice holds its anchor twice: within the pieces of one string, or else the run has more
    starts than a string has pieces.
    """
    if len(b) < length:
        return []
    h, width = piece_hashes(np.frombuffer(b, np.uint8)), length - PIECE + 1
    low = sliding(h, width, np.minimum)
    cuts = np.r_[0, np.flatnonzero(low[1:] != low[:-1]) + 1, len(low)]
    edge = np.zeros(width - 1, np.uint64)
    chosen = np.flatnonzero(sliding(np.concatenate([edge, low, edge]), width, np.maximum) == h)  # least of some string
    value = h[chosen]
    selves = np.diff(cuts) > width
    for k in np.flatnonzero((value[1:] == value[:-1]) & (np.diff(chosen) < width)).tolist():
        first, last = np.searchsorted(cuts, [max(0, chosen[k + 1] - width + 1), min(chosen[k], len(low) - 1)], side="right") - 1
        selves[first:last + 1] |= low[cuts[first:last + 1]] == value[k]
    view, digest, at = memoryview(b), xxhash.xxh3_64_intdigest, cuts.tolist()
    return [(a, digest(view[p:q + length - 1]), p, q - p, s) for a, p, q, s in zip(low.view(np.int64)[cuts[:-1]].tolist(), at, at[1:], selves.tolist())]


def text_key(text: bytes) -> int:
    """Tells apart texts that share a doc_id."""
    return zlib.crc32(text) - (1 << 31)


def _scratch(base: str) -> str:
    """A folder for one task attempt: below the shared folder where tasks see that as files, else with Spark's own spill files."""
    parsed = urlparse(base)
    top = parsed.path if parsed.scheme in ("", "file") else os.environ.get("SPARK_LOCAL_DIRS", ".").split(",")[0]
    path = os.path.join(top, f"sort-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path


class Shard:
    """Runs written to a text file, until they are sorted."""

    def __init__(self, base: str):
        self.folder, self.meta, self.at = _scratch(base), [], 0
        self.path = os.path.join(self.folder, "text")
        self.file = open(self.path, "wb")

    def add(self, b: pa.RecordBatch) -> None:
        raw = b.column("bytes").to_pylist()
        sizes = np.array([len(x) + 1 for x in raw], np.int64)
        self.file.write(b"".join(x.translate(SHIFT) + b"\xff" for x in raw))
        cols = [np.asarray(b.column(c)).astype(np.int64) for c in ("doc", "th", "p0", "n")]
        self.meta.append(np.stack([*cols, self.at + np.cumsum(sizes) - sizes]))
        self.at += int(sizes.sum())

    def repeats(self, length: int, budget: int) -> pa.RecordBatch:
        self.file.write(b"\0" * (1 + length + 8))
        self.file.close()
        doc, th, p0, n, place = np.concatenate(self.meta, axis=1)
        flag = suffixsort.repeats(np.memmap(self.path, np.uint8, "r"), self.folder, length, budget)
        # starts of all runs in one line, a zero after each run
        own = np.repeat(np.arange(len(n)), n + 1)
        offset = np.arange(len(own)) - np.repeat(np.cumsum(n + 1) - n - 1, n + 1)
        f = np.r_[np.int8(0), np.where(offset < n[own], flag[np.minimum(place[own] + offset, len(flag) - 1)], 0).astype(np.int8)]
        a, z = np.flatnonzero(np.diff(f) == 1), np.flatnonzero(np.diff(f) == -1)
        i = own[a]
        return pa.RecordBatch.from_arrays([pa.array(doc[i]), pa.array(th[i].astype(np.int32)), pa.array((p0[i] + offset[a]).astype(np.int32)), pa.array((p0[i] + offset[z] - 1 + length).astype(np.int32))], names=["_doc", "_th", "a", "z"])

    def close(self) -> None:
        self.file.close()
        shutil.rmtree(self.folder, ignore_errors=True)


def shard_repeats(batches: Iterator[pa.RecordBatch], base: str, length: int, budget: int, enough: int = 6 << 20) -> Iterator[pa.RecordBatch]:
    """Repeated stretches of runs that come in order of (part, doc, th, p0).

    Parts hold whole anchors and are sorted together until they make up ``enough`` bytes; a part of any size is one shard.
    """
    shard, last = None, None
    try:
        for b in batches:
            part = np.asarray(b.column("part"))
            cuts = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, len(part)]
            for lo, hi in zip(cuts.tolist(), cuts[1:].tolist()):
                if hi == lo:
                    continue
                if shard and shard.at >= enough and part[lo] != last:
                    yield shard.repeats(length, budget)
                    shard.close()
                    shard = None
                shard, last = shard or Shard(base), part[lo]
                shard.add(b.slice(lo, hi - lo))
        if shard:
            yield shard.repeats(length, budget)
    finally:
        if shard:
            shard.close()


def repeated_stretches(keyed: DataFrame, length: int, budget: int) -> DataFrame:
    """(_doc, _th, a, z): byte stretches that are repeats; they may overlap. keyed: rows with _doc, _th, _raw."""
    spark = keyed.sparkSession

    def cut(batches):
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for doc, th, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                found = runs_of(raw.as_py() or b"", length)
                if found:
                    cols[0] += [doc] * len(found)
                    cols[1] += [th] * len(found)
                    for c, x in zip(cols[2:], ([r[0] for r in found], [r[1] for r in found], [r[2] << 32 | r[3] << 1 | r[4] for r in found])):
                        c += x
                if len(cols[0]) > 200_000:
                    yield batch(cols)
                    cols = [[], [], [], [], []]
            yield batch(cols)

    def batch(cols):
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(np.array(cols[3], np.uint64).view(np.int64)), pa.array(cols[4], pa.int64())], names=["doc", "th", "anchor", "seg", "at"])

    runs = keyed.select("_doc", "_th", "_raw").mapInArrow(cut, "doc long, th int, anchor long, seg long, at long")
    by_anchor = Window.partitionBy("anchor")
    first = Window.partitionBy("anchor", "seg").orderBy("doc", "th", "at")
    runs = runs.withColumn("same", F.lag(F.struct("doc", "th", "at")).over(first).eqNullSafe(F.struct("doc", "th", "at")))  # rows that repeat id and text are one document
    found = runs.select("*", F.rank().over(first).alias("nth"), (F.min("seg").over(by_anchor) != F.max("seg").over(by_anchor)).alias("varied"))
    found = found.withColumn("sort", F.col("varied") | (F.col("at").bitwiseAND(F.lit(1).cast("long")) == 1)).where("NOT same AND (nth > 1 OR sort)")
    starts = F.shiftright(F.col("at").bitwiseAND(F.lit((1 << 32) - 1)), 1)
    found = saved(found.select("doc", "th", "anchor", F.shiftright("at", 32).cast("int").alias("p0"), starts.cast("int").alias("n"), "nth", "sort"))
    copies = found.where("nth > 1").select(F.col("doc").alias("_doc"), F.col("th").alias("_th"), F.col("p0").alias("a"), (F.col("p0") + F.col("n") + (length - 1)).cast("int").alias("z"))
    varied = found.where("nth = 1 AND sort").groupBy(F.col("doc").alias("_doc"), F.col("th").alias("_th")).agg(F.collect_list(F.struct("p0", "n", "anchor")).alias("_runs"))  # within one document

    def pieces(batches):
        for b in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for doc, th, raw, runs in zip(*(b.column(c).to_pylist() for c in ("_doc", "_th", "_raw", "_runs"))):
                for r in runs:
                    for c, x in zip(cols, (doc, th, r["p0"], r["n"], raw[r["p0"]:r["p0"] + r["n"] + length - 1], r["anchor"])):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64()))], names=["doc", "th", "p0", "n", "bytes", "anchor"])

    # all columns go in, so that this join and the caller's read one exchange of the documents
    shards = keyed.join(varied, ["_doc", "_th"]).dropDuplicates(["_doc", "_th"]).mapInArrow(pieces, "doc long, th int, p0 int, n int, bytes binary, anchor long").repartition("anchor")
    shards = shards.withColumn("part", F.pmod(F.xxhash64("anchor"), F.lit(4096)).cast("int")).drop("anchor").sortWithinPartitions("part", "doc", "th", "p0")
    base = shared_folder(spark)
    varied_out = shards.mapInArrow(lambda batches: shard_repeats(batches, base, length, budget), "_doc long, _th int, a int, z int")
    return copies.unionAll(varied_out)


def merged(stretches) -> list[tuple[int, int]]:
    """Maximal stretches of a list of (start, end)."""
    out: list[list[int]] = []
    for a, z in sorted(stretches):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def _with_stretches(docs: DataFrame, id_col: str, text: str, length: int, budget: int) -> DataFrame:
    """row (a struct of docs' other columns, whose names cannot clash), _raw (bytes of the text) and _cuts (repeated stretches, null for none)."""
    other = [F.col(f"`{c}`") for c in docs.columns if c != text] or [F.lit(0).alias("none")]
    th = (F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")) - (1 << 31)).cast("int")
    keyed = docs.select(F.struct(*other).alias("row"), F.col(text).cast("binary").alias("_raw"), F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("_doc"), th.alias("_th"))
    cuts = repeated_stretches(keyed, length, budget).groupBy("_doc", "_th").agg(F.collect_set(F.struct("a", "z")).alias("_cuts"))
    return keyed.join(cuts, ["_doc", "_th"], "left").drop("_doc", "_th")


def removal_digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = 100, budget: int = 1 << 22) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans of every row.

    A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a document of smaller doc_id, or earlier in the
    same document. Strings are judged on the input. Null text is empty; a null doc_id comes before all others. Documents
    that share a doc_id come in the order of their texts' crc32; rows that share id and text are one document and get the
    same answer. Short texts keep everything. An empty table gives an empty result; other columns are ignored.
    ``budget``: items that the sorter keeps in memory per queue.
    """
    def run(batches):
        for b in batches:
            rows = []
            for doc, raw, cuts in zip(*(b.column(c).to_pylist() for c in ("doc_id", "_raw", "_cuts"))):
                raw, spans = raw or b"", merged((c["a"], c["z"]) for c in cuts or ())
                sha, at = hashlib.sha256(), 0
                for a, z in spans:
                    sha.update(raw[at:a])
                    at = z
                sha.update(raw[at:])
                rows.append((doc, len(raw), sum(z - a for a, z in spans), len(spans), sha.hexdigest(), [{"start": a, "end": z} for a, z in spans]))
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
    wide = _with_stretches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")), "doc_id", "text", length, budget)
    return wide.select("row.doc_id", "_raw", "_cuts").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = 100, budget: int = 1 << 22) -> DataFrame:
    """docs with repeated stretches cut out of the text. A character that a stretch holds in part stays whole. Null texts stay null,
    all rows and columns stay, whatever the columns' names; an empty table stays empty."""
    @F.pandas_udf("string")
    def cut(raw, cuts):
        import pandas as pd
        out = []
        for r, c in zip(raw, cuts):
            kept, at = [], 0
            for a, z in merged((int(x["a"]), int(x["z"])) for x in (c if c is not None else ())):
                while a < z and a < len(r) and r[a] & 0xC0 == 0x80:
                    a += 1
                while z > a and z < len(r) and r[z] & 0xC0 == 0x80:
                    z -= 1
                kept.append(r[at:a])
                at = z
            kept.append(r[at:])
            out.append(b"".join(kept).decode("utf-8"))
        return pd.Series(out)

    wide = _with_stretches(docs, id_col, text, length, budget)
    whole = F.when(F.col("_cuts").isNull(), F.col("_raw").cast("string")).otherwise(cut(F.coalesce("_raw", F.lit(b"")), "_cuts"))
    return wide.withColumn("_whole", whole).select(*[F.col("_whole").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
