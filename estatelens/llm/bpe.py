"""Byte-level BPE encoding and decoding with the vocabulary of a tokenizer file.

A short word is merged in a contiguous rank array: its part boundaries and the rank of every adjacent pair stand in
two lists; the minimum rank is searched, its boundary deleted and the ranks of the two neighbours refreshed. Long words use a heap over the
same boundaries, so that a run of a million letters stays n log n. Texts are cut into chunks (white space, then none)
whose encoding does not depend on what surrounds them; a worker keeps the encodings of recent chunks and words in
memory of a fixed bound. The result never depends on what is kept.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The published pattern of byte-level BPE.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Unicode white space, which that pattern's \s means.
SPACE = r" \t\n\r\x0b\x0c\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SHORT = 64
NONE = 1 << 60


def byte_letters() -> list[str]:
    """The letter that stands for each byte in such vocabularies: printable bytes for themselves, others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class ByteBPE:
    def __init__(self, path: str, kept: int = 300_000):
        import re

        import regex
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter = {c: b for b, c in enumerate(byte_letters())}
        as_bytes = lambda s: bytes(letter[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.ids = {as_bytes(k): v for k, v in vocab.items() if all(c in letter for c in k)}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {(as_bytes(a), as_bytes(b)): i for i, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.table = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for k, v in self.ids.items():
            self.table[v] = k
        for k, v in self.special.items():
            self.table[v] = k.encode()
        self.wide = len(self.table) > 65536
        self.dtype = np.dtype("<u4" if self.wide else "<u2")
        self.decimal = [str(i) for i in range(len(self.table))]
        self.words = regex.compile(WORDS).findall
        self.chunks = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall
        self.split = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else None
        self.kept, self.by_chunk, self.by_word = kept, {}, {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word."""
        if word in self.ids and len(word) == 1:
            return [self.ids[word]]
        parts = self._merge_short(word) if len(word) <= SHORT else self._merge_long(word)
        return [self.ids[p] for p in parts]

    def _merge_short(self, word: bytes) -> list[bytes]:
        rank, n = self.rank.get, len(word)
        bounds = list(range(n + 1))
        ranks = [rank((word[i:i + 1], word[i + 1:i + 2]), NONE) for i in range(n - 1)]
        while ranks:
            low = min(ranks)
            if low == NONE:
                break
            i = ranks.index(low)
            del bounds[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank((word[bounds[i]:bounds[i + 1]], word[bounds[i + 1]:bounds[i + 2]]), NONE)
            if i:
                ranks[i - 1] = rank((word[bounds[i - 1]:bounds[i]], word[bounds[i]:bounds[i + 1]]), NONE)
        return [word[a:b] for a, b in zip(bounds, bounds[1:])]

    def _merge_long(self, word: bytes) -> list[bytes]:
        rank, n = self.rank.get, len(word)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts here; the part before it
        alive = bytearray(b"\1") * n
        heap = []

        def push(i: int) -> None:
            j = end[i]
            if j < n and (r := rank((word[i:j], word[j:end[j]]))) is not None:
                heap.append((r, i, j, end[j])) if fresh else heapq.heappush(heap, (r, i, j, end[j]))

        fresh = True
        for i in range(n - 1):
            push(i)
        heapq.heapify(heap)
        fresh = False
        while heap:
            _, i, j, k = heapq.heappop(heap)
            if not (alive[i] and end[i] == j and alive[j] and end[j] == k):
                continue
            alive[j], end[i] = 0, k
            if k < n:
                before[k] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        out, i = [], 0
        while i < n:
            out.append(word[i:end[i]])
            i = end[i]
        return out

    def _chunk(self, chunk: str) -> bytes:
        got = []
        for w in self.words(chunk):
            ids = self.by_word.get(w)
            if ids is None:
                ids = np.array(self.merge(w.encode("utf-8", "replace")), self.dtype).tobytes()
                if len(w) <= SHORT:
                    if len(self.by_word) >= self.kept:
                        self.by_word.clear()
                    self.by_word[w] = ids
            got.append(ids)
        return b"".join(got)

    def _plain(self, text: str) -> bytes:
        get, out = self.by_chunk.get, []
        for c in self.chunks(text):
            ids = get(c)
            if ids is None:
                ids = self._chunk(c)
                if len(c) <= SHORT:
                    if len(self.by_chunk) >= self.kept:
                        self.by_chunk.clear()
                    self.by_chunk[c] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text; none for null. A special token's own string in the text becomes its id."""
        if not text:
            return np.zeros(0, self.dtype)
        if self.split and any(t in text for t in self.special):
            raw = b"".join(np.array([self.special[p]], self.dtype).tobytes() if p in self.special else self._plain(p) for p in self.split(text) if p)
        else:
            raw = self._plain(text)
        return np.frombuffer(raw, self.dtype)

    def decode(self, ids) -> str:
        """Text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.table.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[str, ByteBPE] = {}


def load(path: str) -> ByteBPE:
    """The tokenizer of a file, once per worker."""
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


def encode_texts(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with an array column of token ids. Null and empty texts: an empty array. No shuffle; other columns pass by."""
    @F.pandas_udf("array<int>")
    def encoded(s):
        t = load(path)
        return s.map(lambda x: t.encode(x).astype(np.int32), na_action=None)

    return docs.withColumn(ids, encoded(F.coalesce(F.col(text), F.lit(""))))


def decode_ids(docs: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """docs with the text of an array of ids; null for null. Ids that the vocabulary lacks raise an error."""
    @F.pandas_udf("string")
    def decoded(s):
        t = load(path)
        return s.map(lambda x: None if x is None else t.decode([int(i) for i in x]), na_action=None)

    return docs.withColumn(text, decoded(F.col(ids)))


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, sha-256 of the decimal ids joined by commas and of the text decoded from those ids.

    Null text counts as empty: no token, digests of the empty string. Any doc_id passes by, null and repeated ones
    too; an empty table gives an empty result. One pass, no shuffle, so no key or text can be hot.
    """
    def run(batches):
        t = load(path)
        sha = hashlib.sha256
        for b in batches:
            n, d_ids, d_text = [], [], []
            for x in b.column(1):
                ids = t.encode(x.as_py()).tolist()
                n.append(len(ids))
                d_ids.append(sha(",".join(map(t.decimal.__getitem__, ids)).encode()).hexdigest())
                d_text.append(sha(t.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(d_ids, pa.string()), pa.array(d_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
