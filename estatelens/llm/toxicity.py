"""Toxic spans and document scores with a linear-chain conditional random field of two states.

Tokens are runs without white space. Labels come per document, so tokens are labelled first: in a toxic document, a
token is toxic if one of its features (a word, or its first 3 to 6 letters) stands in toxic documents far more often than
in clean ones; all other tokens, and all tokens of clean documents, are not. Near copies of one text count once there.
The field is trained on those tokens by gradient ascent on the conditional likelihood (forward-backward). A document's
score is a logistic function of its largest marginal and of the sum of its marginals, fitted on the same rows.

The fit uses a bounded sample (``per_class`` labelled documents of each class in the order of a hash of the id, of at
most ``fit_chars`` characters each). Scoring covers every whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import count
from sys import intern

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LETTERS = re.compile(r"[^\W\d_]+").findall
LANE = 256


def features(token: str) -> set[str]:
    out = set()
    for w in LETTERS(token.lower()):
        out.add(w)
        out.update("^" + w[:n] for n in (3, 4, 5, 6) if len(w) >= n)
    return out


def offsets(text: str):
    """(start, end) of each token of text.split()."""
    at = 0
    for w in text.split():
        at = text.index(w, at)
        yield at, at + len(w)
        at += len(w)


def lanes(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token streams cut into pieces of at most LANE tokens: (document, start, length) of each piece, in order."""
    per = -(-lengths // LANE)
    doc = np.repeat(np.arange(len(lengths)), per)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    starts = np.repeat(np.cumsum(lengths) - lengths, per) + nth * LANE
    return doc, starts, np.minimum(LANE, np.repeat(lengths, per) - nth * LANE)


def forward_backward(odds: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(forward, backward, marginal of state 1) of each token; rows of forward and backward are scaled to sum 1.

    odds: of state 1 against 0 by each token alone. All pieces of all documents step together; a piece's 2 x 2
    transfer matrix carries the message over it, so long documents take no more steps than short ones.
    """
    doc, start, size = lanes(lengths)
    order = np.argsort(-size, kind="stable")
    s_start, s_size = start[order], size[order]
    active = np.searchsorted(-s_size, -np.arange(LANE), side="left")  # pieces longer than t
    n, longest = len(order), int(s_size[0]) if len(order) else 0
    first = np.r_[True, doc[1:] != doc[:-1]] if n else np.zeros(0, bool)

    def step(a0, a1, e):
        b0, b1 = a0 * trans[0, 0] + a1 * trans[1, 0], (a0 * trans[0, 1] + a1 * trans[1, 1]) * e
        z = b0 + b1
        return b0 / z, b1 / z, z

    inits_f, inits_b = np.full((n, 2), 0.5), np.full((n, 2), 0.5)
    several = np.flatnonzero(~first)
    if len(several):
        p = np.zeros((n, 2, 2))
        p[:, 0, 0] = p[:, 1, 1] = 1
        for t in range(longest):
            k = active[t]
            e = odds[s_start[:k] + t]
            q = p[:k]
            c0, c1 = q[:, :, 0] * trans[0, 0] + q[:, :, 1] * trans[1, 0], (q[:, :, 0] * trans[0, 1] + q[:, :, 1] * trans[1, 1]) * e[:, None]
            z = (c0 + c1).sum(axis=1)[:, None]
            q[:, :, 0], q[:, :, 1] = c0 / z, c1 / z
        whole = np.empty_like(p)
        whole[order] = p
        for i in several:
            x = inits_f[i - 1] @ whole[i - 1]
            inits_f[i] = x / x.sum()
        for i in several[::-1]:
            x = whole[i] @ inits_b[i]
            inits_b[i - 1] = x / x.sum()
    fwd, bwd = np.empty((len(odds), 2)), np.empty((len(odds), 2))
    a0, a1 = inits_f[order, 0], inits_f[order, 1]
    for t in range(longest):
        k, at = active[t], s_start[:active[t]] + t
        a0, a1, _ = step(a0[:k], a1[:k], odds[at])
        fwd[at, 0], fwd[at, 1] = a0, a1
    b0, b1 = inits_b[order, 0].copy(), inits_b[order, 1].copy()
    for t in range(longest - 1, -1, -1):
        k, at = active[t], s_start[:active[t]] + t
        bwd[at, 0], bwd[at, 1] = b0[:k], b1[:k]
        e = odds[at]
        c0, c1 = trans[0, 0] * b0[:k] + trans[0, 1] * e * b1[:k], trans[1, 0] * b0[:k] + trans[1, 1] * e * b1[:k]
        z = c0 + c1
        b0[:k], b1[:k] = c0 / z, c1 / z
    m = fwd * bwd
    return fwd, bwd, m[:, 1] / (m[:, 0] + m[:, 1])


class SpanField:
    """Feature weights, transition scores and the document calibration. ``weights`` is empty if nothing was learned."""

    def __init__(self, texts: list[str], labels: list[int], base_rate: float, settled: float = 1e-3, ridge: float = 1e-2, lift: float = 0.9, least: int = 5):
        self.weights: dict[str, float] = {}
        self.bias, self.trans, self.calibration = -4.0, np.ones((2, 2)), np.array([-6.0, 0.0, 0.0])
        if len(set(labels)) < 2:
            return
        docs = [t.split() for t in texts]
        vocab: dict[str, int] = {}
        ids = [np.array([vocab.setdefault(w, len(vocab)) for w in d], np.int64) for d in docs]
        of_word = [{intern(f) for f in features(w)} for w in vocab]
        seen, counts = set(), {0: Counter(), 1: Counter()}
        total = Counter()
        for d, i, y in zip(docs, ids, labels):
            copy = min((xxhash.xxh64_intdigest(" ".join(d[k:k + 5])) for k in range(max(1, len(d) - 4))), default=0)
            if (copy, y) in seen:
                continue
            seen.add((copy, y))
            total[y] += 1
            counts[y].update(set().union(*(of_word[k] for k in set(i.tolist()))) if len(i) else ())
        # of a feature that is as frequent in both classes the share is 1/2; few documents count for less
        sure = lambda f: max(0.0, counts[1][f] - 1.5 * counts[1][f] ** 0.5) / max(1, total[1])
        share = lambda f: sure(f) / (sure(f) + (counts[0][f] + 2) / max(1, total[0]))
        toxic = {f for f, c in counts[1].items() if c >= max(least, 0.01 * total[1]) and share(f) >= lift}
        names = [f for f in {**counts[1], **counts[0]} if counts[1][f] + counts[0][f] >= least]
        index = {f: k for k, f in enumerate(names)}
        is_toxic = np.array([bool(f & toxic) for f in of_word])
        used = [k for k, (i, y) in enumerate(zip(ids, labels)) if len(i) and (not y or is_toxic[i].any())]
        if not toxic or not used:
            return
        stream, lengths = np.concatenate([ids[k] for k in used]), np.array([len(ids[k]) for k in used])
        gold = is_toxic[stream] & np.repeat(np.array([labels[k] for k in used], bool), lengths)
        rows = np.concatenate([np.full(len(f), k) for k, f in enumerate(of_word)] or [[]]).astype(np.int64)
        cols = np.array([index.get(x, -1) for f in of_word for x in f], np.int64)
        rows, cols = rows[cols >= 0], cols[cols >= 0]
        w, bias, lt = np.zeros(len(names)), -4.0, np.zeros((2, 2))
        firsts = np.cumsum(lengths) - lengths
        inner = np.ones(len(stream), bool)
        inner[firsts] = False
        inner = np.flatnonzero(inner)
        gold_pairs = np.array([[np.sum((gold[inner - 1] == a) & (gold[inner] == b)) for b in (0, 1)] for a in (0, 1)], float)
        m1, m2, beta = 0.0, 0.0, (0.9, 0.99)
        before, still = np.zeros(len(stream)), 0
        for r in count(1):  # until the toxic marginals have settled: three rounds that move less than a share of their sum; steps shrink, so they do
            odds = np.exp(np.clip(np.bincount(rows, w[cols], len(vocab)) + bias, -30, 30))[stream]
            trans = np.exp(lt)
            fwd, bwd, mark = forward_backward(odds, lengths, trans)
            still = still + 1 if np.abs(mark - before).sum() <= settled * max(1.0, mark.sum()) else 0
            if still == 3:
                break
            before = mark
            miss = gold - mark
            pairs = np.zeros((2, 2))
            for lo in range(0, len(inner), 1 << 17):
                at = inner[lo:lo + (1 << 17)]
                joint = fwd[at - 1][:, :, None] * trans * (np.stack([np.ones(len(at)), odds[at]], 1) * bwd[at])[:, None, :]
                pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            g = np.concatenate([np.bincount(cols, np.bincount(stream, miss, len(vocab))[rows], len(names)) - ridge * w, [miss.sum()], (gold_pairs - pairs).ravel() - lt.ravel()])
            m1, m2 = beta[0] * m1 + (1 - beta[0]) * g, beta[1] * m2 + (1 - beta[1]) * g * g
            move = 0.3 / (1 + r / 40) * (m1 / (1 - beta[0] ** r)) / (np.sqrt(m2 / (1 - beta[1] ** r)) + 1e-8)
            self.rounds = r
            w, bias, lt = w + move[:len(names)], bias + move[len(names)], lt + move[-4:].reshape(2, 2)
        self.weights, self.bias, self.trans = {f: float(x) for f, x in zip(names, w) if abs(x) > 1e-3}, float(bias), np.exp(lt)
        x = np.array([self._summary(m) for m in self.marginals(docs)])
        x = np.hstack([np.ones((len(x), 1)), x])
        y = np.array(labels, float)
        each = np.where(y == 1, base_rate / max(y.mean(), 1e-9), (1 - base_rate) / max(1 - y.mean(), 1e-9))  # the classes as often as among all labels
        c = np.zeros(3)
        for _ in range(30):  # ridge logistic regression by Newton steps
            p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
            h = (x * (each * p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 0.1, 0.1])
            c = c + np.linalg.solve(h, x.T @ (each * (y - p)) - np.array([1e-3, 0.1, 0.1]) * c)
        self.calibration = c

    def emission(self, token: str) -> float:
        return float(np.exp(np.clip(sum(self.weights.get(f, 0.0) for f in features(token)) + self.bias, -30, 30)))

    @staticmethod
    def _summary(m: np.ndarray) -> tuple[float, float]:
        top = float(m.max()) if len(m) else 0.0
        heavy = float(m[m >= 0.5].sum()) if len(m) else 0.0
        return top, float(np.log1p(heavy))

    def marginals(self, docs: list[list[str]], kept: int = 300_000) -> list[np.ndarray]:
        """Marginal of the toxic state for each token of each document. Emissions of recent tokens are kept, within a bound."""
        cache = self.__dict__.setdefault("_kept", {})
        out: list[np.ndarray] = []
        for lo in range(0, len(docs), 512):
            part = docs[lo:lo + 512]
            odds = []
            for d in part:
                missing = set(d).difference(cache)
                if missing:
                    if len(cache) + len(missing) > kept:
                        cache.clear()
                        missing = set(d)
                    cache.update((w, self.emission(w)) for w in missing)
                odds.append(np.fromiter(map(cache.__getitem__, d), np.float64, len(d)))
            lengths = np.array([len(d) for d in part])
            _, _, m = forward_backward(np.concatenate(odds), lengths, self.trans)
            out += np.split(m, np.cumsum(lengths)[:-1])
        return out

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_kept"}

    def score(self, m: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.array([1.0, *self._summary(m)]) @ self.calibration, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = 1200, fit_chars: int = 4000) -> SpanField:
    """A field from documents and their labels (id, 0/1). Several labels of one id: the largest. Null labels are not used."""
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    n, bad = known.agg(F.count("*"), F.sum("y")).first()
    one = lambda y: known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class)
    # at most 2 * per_class ids: a bounded broadcast
    sample = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where(F.length("text") <= fit_chars).join(F.broadcast(one(0).unionAll(one(1))), "id")
    rows = sorted({(r.id, r.text, r.y) for r in sample.select("id", "text", "y").collect()})
    return SpanField([r[1] for r in rows], [r[2] for r in rows], (bad or 0) / n if n else 0.0)


def score_documents(docs: DataFrame, model: SpanField, id_col: str = "doc_id", text: str = "text", least: float = 0.3, carry: bool = False) -> DataFrame:
    """doc_id, score, predicted and the offending spans (start, end in characters, marginal) of every row.

    With ``carry`` all of docs' columns stay, named as they are, and the three are added as _score, _predicted, _spans.
    One pass, no shuffle. Null and empty texts have no token: the score of a text with marginal 0. Repeated rows are
    scored alike. Whole texts are read, however long.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # feature weights: bounded by the fit's sample

    def scored(texts: list[str]):
        m = shared.value
        words = [t.split() for t in texts]
        for t, d, p in zip(texts, words, m.marginals(words)):
            spans, hot = [], np.flatnonzero(p >= 0.5)
            if len(hot):
                wanted = set(hot.tolist())
                spans = [{"start": a, "end": b, "marginal": float(p[k])} for k, (a, b) in enumerate(offsets(t)) if k in wanted]
            yield m.score(p), spans

    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                b = batch.slice(lo, 512)
                got = list(scored(b.column(b.schema.get_field_index("_text")).fill_null("").to_pylist()))
                keep = [b.column(i) for i, name in enumerate(b.schema.names) if name != "_text"]
                names = [name for name in b.schema.names if name != "_text"]
                yield pa.RecordBatch.from_arrays([*keep, pa.array([g[0] for g in got], pa.float64()), pa.array([int(g[0] >= least) for g in got], pa.int32()), pa.array([g[1] for g in got], span)], names=[*names, "_score", "_predicted", "_spans"])

    # the columns that are added to docs' own
    added = "_score double, _predicted int, _spans array<struct<start:int,end:int,marginal:double>>"
    if carry:
        source = docs.withColumn("_text", F.col(text))
        return source.mapInArrow(run, T.StructType([*docs.schema.fields, *T.StructType.fromDDL(added).fields]))
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("_text")).mapInArrow(run, f"doc_id {kind}, {added}")
    return out.select("doc_id", F.col("_score").alias("score"), F.col("_predicted").alias("predicted"), F.col("_spans").alias("spans"))


def without_toxic(docs: DataFrame, model: SpanField, id_col: str = "doc_id", text: str = "text", least: float = 0.3) -> DataFrame:
    """docs without the documents whose score is at least ``least``; all columns, whatever their names, and all other rows stay.

    Null and empty texts are scored like a text without a toxic token. Repeated rows go or stay together.
    """
    packed = docs.select(F.struct("*").alias("row"))
    return score_documents(packed, model, text=f"row.`{text}`", least=least, carry=True).where("_predicted = 0").select("row.*")
