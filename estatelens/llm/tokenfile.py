"""Token ids as flat binary files: unsigned ids, 64-bit document offsets, memory-mapped reads.

Layout of a folder, one set of files per range of doc_id:

* ``NNNNN.bin``  ids of all documents one after another, unsigned 16-bit little-endian if the vocabulary allows, else 32-bit
* ``NNNNN.idx``  signed 64-bit little-endian: position of each document's first id in the whole corpus, then the end
* ``NNNNN.doc``  records of (doc_id int64, valid uint8)
* ``manifest.json``  dtype, and per part its number of documents, of ids, and its base

Documents are dealt into ranges of doc_id and each task writes its range. A part's base is the prefix sum of the ids
of the parts before it, one number per part, so nothing that grows with the documents passes the driver.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.llm.common import file_system, put_file
from estatelens.session import shared_folder

DOC = np.dtype([("doc_id", "<i8"), ("valid", "u1")])
# the normalizer and pieces for which runs of letters, digits and marks are known to be encoded alone
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SIMPLE = re.compile(r"[!-&(-;=-{}~\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+").fullmatch  # no apostrophe, < or |
RUNS = re.compile(r"[a-z\u00DF-\u00F6\u00F8-\u00FF]+|[0-9]|[^a-z0-9\u00DF-\u00F6\u00F8-\u00FF]+").findall


class CachedTokenizer:
    """A tokenizers-library file whose pre-tokenizer drops or never crosses a blank.

    Between blanks and newlines a text's pieces are encoded alone, each distinct one once. Their ids lie in one flat array,
    and the ids of a batch of texts are gathered from it at once. A new piece of plain letters, digits and marks is put
    together from its runs, which the pre-tokenizer would encode alone as well, so "Word," costs no call if "word" is known.
    What is kept is bounded by ``most`` bytes, beyond one batch. Only for tokenizers where white space ends a word
    (``drops_space``); any other file is used on whole texts.
    """

    BATCH_CHARS = 4_000_000

    def __init__(self, path: str, most: int = 320 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.vocab = self.tokenizer.get_vocab_size(with_added_tokens=True)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.drops_space = self._drops_space(spec)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.runs_alone = self.drops_space and spec.get("normalizer") == NORMALIZER and steps[0].get("pattern", {}).get("Regex") == PIECES
        self.most = most
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.ends, self.held = array("I"), array("q", [0]), 0

    def _put(self, pieces: list[str], ids: list[list[int]]) -> None:
        n = len(self.ends) - 1
        self.index.update(zip(pieces, range(n, n + len(pieces))))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.ends.frombytes((len(self.ids) + np.cumsum(sizes)).tobytes())
        self.ids.extend(chain.from_iterable(ids))
        self.held += 160 * len(pieces) + sum(map(len, pieces)) + 4 * int(sizes.sum())

    def _learn(self, pieces: list[str]) -> None:
        split = {p: RUNS(p.lower()) for p in pieces if SIMPLE(p)} if self.runs_alone else {}
        alone = set(chain.from_iterable(split.values()))
        alone.update(p for p in pieces if p not in split)
        todo = [p for p in alone if p not in self.index]
        self._put(todo, [e.ids for e in self.tokenizer.encode_batch_fast(todo, add_special_tokens=False)])
        index, ids, ends = self.index, self.ids, self.ends
        made = [p for p in split if p not in index]
        joined = []
        for p in made:
            out = []
            for i in map(index.__getitem__, split[p]):
                out += ids[ends[i]:ends[i + 1]]
            joined.append(out)
        self._put(made, joined)

    @staticmethod
    def _drops_space(spec: dict) -> bool:
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        first = steps[0] if steps else {}
        pattern = first.get("pattern", {}).get("Regex", "")
        plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] or "\n" in t["content"] for t in spec["added_tokens"])
        return first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed" and "(?" not in pattern and r"[^\s" in pattern and " " not in pattern and plain

    def encode(self, texts: list[str], dtype: np.dtype) -> Iterator[bytes]:
        """Ids of each text, as bytes."""
        if not self.drops_space:
            for e in self.tokenizer.encode_batch(texts, add_special_tokens=False):
                yield np.array(e.ids, dtype).tobytes()
            return
        lo = 0
        while lo < len(texts):
            hi, chars = lo, 0
            while hi < len(texts) and (hi == lo or chars < self.BATCH_CHARS):
                chars += len(texts[hi])
                hi += 1
            split = [(t.lower() if self.runs_alone and t.isascii() and "<|" not in t else t).replace("\n", " ").split(" ") for t in texts[lo:hi]]
            yield from self._gather(list(chain.from_iterable(split)), np.cumsum([0, *map(len, split)]), dtype)
            lo = hi

    def _gather(self, pieces: list[str], bounds: np.ndarray, dtype: np.dtype) -> list[bytes]:
        at = np.fromiter(map(self.index.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(at < 0)
        if len(new):
            self._learn(list({pieces[i] for i in new.tolist()}))
            at[new] = [self.index[pieces[i]] for i in new.tolist()]
        ends, ids = np.frombuffer(self.ends, np.int64), np.frombuffer(self.ids, np.uint32)
        size = ends[at + 1] - ends[at]
        stop = np.cumsum(size)
        flat = ids[np.repeat(ends[at + 1] - stop, size) + np.arange(int(stop[-1]) if len(stop) else 0)].astype(dtype)
        cuts = np.r_[0, stop][bounds].tolist()
        if self.held > self.most:
            self._forget()
        return [flat[a:z].tobytes() for a, z in zip(cuts, cuts[1:])]


_LOADED: dict[str, CachedTokenizer] = {}


def load(path: str) -> CachedTokenizer:
    if path not in _LOADED:
        _LOADED[path] = CachedTokenizer(path)
    return _LOADED[path]


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int | None = None, id_col: str = "doc_id", text: str = "text") -> dict:
    """Encode docs in ascending doc_id and write the files; returns the manifest.

    Null text counts as empty. A null doc_id comes first; repeated doc_ids are separate documents, in the order of
    their texts. An empty table writes a manifest without parts.
    """
    dtype = np.dtype("<u2" if max(load(tokenizer).vocab - 1, end_id or 0) < 1 << 16 else "<u4")
    end = np.array([] if end_id is None else [end_id], dtype).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, part = load(tokenizer), TaskContext.get().partitionId()
        sizes, ids = [], []

        def tokens():
            for b in batches:
                doc = np.zeros(b.num_rows, DOC)
                doc["doc_id"] = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
                doc["valid"] = b.column(0).is_valid().to_numpy(zero_copy_only=False)
                ids.append(doc)
                for raw in t.encode(b.column(1).to_pylist(), dtype):
                    sizes.append((len(raw) + len(end)) // dtype.itemsize)
                    yield raw + end

        stem = f"{folder}/{part:05d}"
        put_file(f"{stem}.bin", tokens())
        n = len(sizes)
        if n:
            put_file(f"{stem}.rel", [np.concatenate([[0], np.cumsum(sizes)]).astype("<i8").tobytes()])
            put_file(f"{stem}.doc", [np.concatenate(ids).tobytes()])
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([sum(sizes)], pa.int64())], names=["part", "n_docs", "n_ids"])

    spark = docs.sparkSession
    dealt = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    parts = sorted(dealt.mapInArrow(run, "part int, n_docs long, n_ids long").where("n_docs > 0").collect())  # one row per part
    base, listed = 0, []
    for p in parts:
        listed.append({"part": p.part, "n_docs": p.n_docs, "n_ids": p.n_ids, "base": base})
        base += p.n_ids

    def offsets(batches):
        for b in batches:
            for part, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                system, path = file_system(f"{folder}/{part:05d}.rel")
                with system.open_input_file(path) as f:
                    put_file(f"{folder}/{part:05d}.idx", [(np.frombuffer(f.read(), "<i8") + first).astype("<i8").tobytes()])
            yield b.select([0])

    if listed:
        rows = spark.createDataFrame([(p["part"], p["base"]) for p in listed], "part int, base long")
        rows.repartition(len(listed), "part").mapInArrow(offsets, "part int").count()
    manifest = {"dtype": dtype.str, "end_id": end_id, "n_ids": base, "parts": listed}
    put_file(f"{folder}/manifest.json", [json.dumps(manifest).encode()])
    return manifest


def read_tokens(spark: SparkSession, folder: str, make, schema: str) -> DataFrame:
    """Rows made from the files, one task per part: make(doc ids, valid, offsets, base, ids) yields record batches.

    On a file system that the task can map, ids are a memory map and only touched pages are read.
    """
    system, path = file_system(f"{folder}/manifest.json")
    with system.open_input_file(path) as f:
        manifest = json.loads(f.read())
    dtype = np.dtype(manifest["dtype"])

    def run(batches):
        for b in batches:
            for part, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                system, stem = file_system(f"{folder}/{part:05d}")

                def mapped(end, kind):
                    from pyarrow import fs
                    if isinstance(system, fs.LocalFileSystem):
                        return np.memmap(f"{stem}.{end}", kind, "r") if os.path.getsize(f"{stem}.{end}") else np.zeros(0, kind)
                    with system.open_input_file(f"{stem}.{end}") as f:
                        return np.frombuffer(f.read(), kind)

                doc = mapped("doc", DOC)
                yield from make(doc["doc_id"], doc["valid"], mapped("idx", "<i8"), base, mapped("bin", dtype))

    rows = spark.createDataFrame([(p["part"], p["base"]) for p in manifest["parts"]], "part int, base long")
    return rows.repartition(max(1, len(manifest["parts"])), "part").mapInArrow(run, schema)


def token_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as unsigned 32-bit integers, of every document in the files."""
    def make(doc, valid, idx, base, ids):
        for lo in range(0, len(doc), 4096):
            hi = min(lo + 4096, len(doc))
            crc = [zlib.crc32(ids[idx[i] - base:idx[i + 1] - base].astype("<u4").tobytes()) for i in range(lo, hi)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(doc[lo:hi]), pa.int64(), mask=np.array(valid[lo:hi]) == 0), pa.array(np.array(idx[lo:hi]), pa.int64()), pa.array(np.diff(idx[lo:hi + 1]), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_tokens(spark, folder, make, "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
