"""Language identification with string kernels.

The kernel of two texts is the cosine of their sets of byte n-grams, all orders 1 to 3 blended, presence only, over
the n-grams that occur in at least one landmark. A bounded sample of labelled texts gives the landmarks (Nyström) and
the rows on which one-versus-rest kernel ridge regression is solved; every text is then scored, whole, by batched
matrix products against the landmarks.

The sample's bounds are the parameters ``per_lang`` and ``landmarks`` (rows per language, taken in the order of a hash
of the id) and ``fit_chars`` (longer texts are not used for fitting). Scoring has no bound on length or number.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_LATIN = re.compile("[a-zA-Z]").search


def has_letter(text: str | None) -> bool:
    return bool(text) and bool(_LATIN(text) or any(map(str.isalpha, text)))


def ngram_codes(text: str) -> list[np.ndarray]:
    """Codes of the byte 1-, 2- and 3-grams of the lower-cased text; a code below 2^8, 2^16, 2^24."""
    b = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    two = (b[:-1] << 8) | b[1:]
    return [b, two, (two[:-1] << 8) | b[2:]]


class KernelModel:
    """Landmarks, their n-gram vocabulary and the ridge solution. ``langs`` is empty if there was nothing to learn from."""

    def __init__(self, texts: list[str], labels: list[str], landmarks: int, ridge: float):
        self.langs = sorted(set(labels))
        if not self.langs:
            return
        seen: dict[str, int] = {}
        marks = []
        for t, lang in zip(texts, labels):
            if seen.get(lang, 0) < landmarks:
                seen[lang] = seen.get(lang, 0) + 1
                marks.append(t)
        per_mark = [[np.unique(c) for c in ngram_codes(t)] for t in marks]
        self.codes = [np.unique(np.concatenate([m[n] for m in per_mark])) for n in range(3)]
        self._tables()
        self.marks = self._normal(self.presence(marks))
        k_mm = self.marks.astype(np.float64) @ self.marks.T
        w, v = np.linalg.eigh(k_mm)
        ok = w > 1e-6 * w.max()
        whiten = v[:, ok] / np.sqrt(w[ok])  # Nyström map: k(x, marks) @ whiten
        phi = self.kernel(texts).astype(np.float64) @ whiten
        phi = np.hstack([phi, np.ones((len(phi), 1))])
        y = np.array([[1.0 if lang == c else -1.0 for c in self.langs] for lang in labels])
        solved = np.linalg.solve(phi.T @ phi + ridge * np.eye(phi.shape[1]), phi.T @ y)
        self.weights, self.bias = (whiten @ solved[:-1]).astype(np.float32), solved[-1].astype(np.float32)

    def _tables(self) -> None:
        self.tables, base = [], 1
        for n, c in enumerate(self.codes):
            t = np.zeros(1 << 8 * (n + 1), np.uint16 if sum(map(len, self.codes)) < 65535 else np.uint32)
            t[c] = np.arange(base, base + len(c))
            base += len(c)
            self.tables.append(t)
        self.width = base

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "tables"}

    def __setstate__(self, state):
        self.__dict__ = state
        if self.langs:
            self._tables()

    def presence(self, texts: list[str]) -> np.ndarray:
        p = np.zeros((len(texts), self.width), np.float32)
        for row, text in zip(p, texts):
            for table, codes in zip(self.tables, ngram_codes(text)):
                row[table[codes]] = 1
        p[:, 0] = 0
        return p

    @staticmethod
    def _normal(p: np.ndarray) -> np.ndarray:
        return p / np.sqrt(np.maximum(p.sum(axis=1, keepdims=True), 1))

    def kernel(self, texts: list[str]) -> np.ndarray:
        return np.vstack([self._normal(self.presence(texts[i:i + 256])) @ self.marks.T for i in range(0, len(texts), 256)])

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(index into langs, score): the score is the logistic of the margin over the second language, in 0.5 to 1."""
        f = self.kernel(texts) @ self.weights + self.bias
        best = f.argmax(axis=1)
        rest = f.copy()
        rest[np.arange(len(f)), best] = -np.inf
        margin = f.max(axis=1) - rest.max(axis=1) if f.shape[1] > 1 else np.full(len(f), 2.0)
        return best, 1 / (1 + np.exp(-3.0 * np.minimum(margin, 10)))


def fit(labelled: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = 500, landmarks: int = 48, fit_chars: int = 20_000, ridge: float = 0.1) -> KernelModel:
    """A model from labelled rows. Rows without text, letters or label are not used."""
    usable = labelled.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}") & (F.length(text) <= fit_chars))
    order = Window.partitionBy("lang").orderBy("h", "id")
    ids = usable.select(F.col(id_col).alias("id"), F.col(lang).alias("lang"), F.xxhash64(id_col).alias("h")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_lang)
    # at most per_lang ids per language: a bounded broadcast
    rows = usable.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).join(F.broadcast(ids.select("id", "lang").distinct()), ["id", "lang"]).select("id", "text", "lang").collect()
    rows.sort(key=lambda r: (r.lang, str(r.id), r.text))
    return KernelModel([r.text for r in rows], [r.lang for r in rows], landmarks, ridge)


def identify(docs: DataFrame, model: KernelModel, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text's language as lang_pred, and score, for every row; one pass, no shuffle.

    Null text and text without a letter: ``und`` with score 0, as is every text if the model has learned nothing.
    Repeated rows are judged alike; whole texts count, of any length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # landmarks and weights: bounded by the fit's parameters

    def run(batches):
        m = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                b = batch.slice(lo, 256)
                texts = b.column(1).to_pylist()
                lang, score = ["und"] * len(texts), [0.0] * len(texts)
                rows = [i for i, t in enumerate(texts) if m.langs and has_letter(t)]
                if rows:
                    best, s = m.predict([texts[i] for i in rows])
                    for i, k, v in zip(rows, best, s):
                        lang[i], score[i] = m.langs[k], float(v)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
