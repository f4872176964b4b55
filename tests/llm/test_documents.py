import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from estatelens.llm import decontaminate, langid, repeats, simhash, suffixsort, toxicity
from tests.llm.conftest import frame


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def near_texts(texts):
    rng = random.Random(3)
    base = words(rng, 300).split()
    out = [*texts, " ".join(base), "  ".join(base).upper(), " ".join(base)]
    for k in range(25):  # a family of near copies, linked in chains
        base[rng.randrange(300)] = f"new{k}"
        out.append(" ".join(base))
    return out


def test_simhash_matches_brute_force(spark, near_texts):
    docs = frame(spark, near_texts).withColumn("fp", F.lit("clash")).withColumn("key", F.lit(1))
    docs = docs.unionAll(spark.createDataFrame([(None, "no id at all here", None, None, None, "x", 1), (2, "repeated id", None, None, None, "x", 1)], docs.schema))
    rows = simhash.near_duplicates(docs, tile=4).collect()
    fp = np.array([r.fp for r in rows], np.int64).view(np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 2
    label = np.arange(len(rows))
    while (low := np.where(near, label[None, :], len(rows)).min(axis=1)).tolist() != label.tolist():
        label = low
    for i, r in enumerate(rows):
        ids = [x.doc_id for x, k in zip(rows, label) if k == label[i] and x.doc_id is not None]
        assert r.component_id == (min(ids) if ids else None)
    assert {r.fp for r in rows if r.doc_id in (0, 1)} == {0}
    kept = [r.doc_id for r in simhash.deduplicated(docs).collect()]
    assert sorted(map(str, kept)) == sorted({str(r.component_id) for r in rows})
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_fingerprint_bits():
    import xxhash
    t = "The cat SAT on\x0bthe mat É"
    w = "the cat sat on the mat É".split()
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(len(w) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint_of(t) == want
    assert simhash.fingerprint_of("one TWO") == xxhash.xxh64_intdigest(b"one two", 42)


def test_dense_tiles_give_a_forest():
    rng = np.random.default_rng(0)
    a = np.uint64(123456789) ^ (np.uint64(1) << rng.integers(0, 8, 200).astype(np.uint64))
    for b, same in ((a, True), (a[:77] ^ np.uint64(1), False)):
        x, y = simhash.tile_links(a, b, 2, same)
        assert len(x) <= len(a) + len(b)
        parent = {}

        def find(v):
            while parent.setdefault(v, v) != v:
                v = parent[v]
            return v
        for i, j in zip(x, y):
            parent[find((0, i))] = find((0 if same else 1, j))
        near = np.bitwise_count(a[:, None] ^ b[None, :]) <= 2
        for i, j in zip(*np.nonzero(near)):
            assert (same and i == j) or find((0, i)) == find((0 if same else 1, j))


@pytest.mark.parametrize("seed", range(6))
def test_suffix_order_and_prefixes(tmp_path, monkeypatch, seed):
    rng = np.random.default_rng(seed)
    for trial in range(25):
        monkeypatch.setattr(suffixsort, "CHUNK", int(rng.choice([1, 3, 64])))
        data = bytes(rng.integers(1, 1 + rng.integers(1, 5), rng.integers(1, 120)).astype(np.uint8))
        data, cap, budget = data + data[:len(data) // 2] + data, int(rng.integers(2, 20)), int(rng.choice([2, 8, 1000]))
        full, folder = data + b"\0" * (cap + 9), tmp_path / str(trial)
        folder.mkdir()
        items = np.concatenate(list(suffixsort.sorted_suffixes(np.frombuffer(full, np.uint8), str(folder), cap, budget)))
        pos = (items >> 8).tolist()
        assert sorted(pos) == list(range(len(data)))
        keys = [full[p:p + cap] for p in pos]
        assert keys == sorted(keys, reverse=True)
        assert [next((k for k in range(cap) if a[k] != b[k]), cap) for a, b in zip(keys, keys[1:])] == (items[1:] & 255).tolist()


def brute_repeats(rows, length):
    seen, out = {}, {}
    for i, t in rows:
        b, start = (t or "").encode(), 0
        cut = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if b[p:p + length] in seen:
                cut[max(start, p):p + length] = b"\1" * (p + length - max(start, p))
            seen.setdefault(b[p:p + length], 1)
        kept = bytes(x for x, c in zip(b, cut) if not c)
        out[i] = (len(b), sum(cut), sum(1 for j in range(len(b)) if cut[j] and (not j or not cut[j - 1])), hashlib.sha256(kept).hexdigest(), kept)
    return out


@pytest.mark.parametrize("length", [100, 37])
def test_repeats_match_brute_force(spark, near_texts, length):
    rng = random.Random(5)
    passage = words(rng, 60)
    cases = [*near_texts, *(words(rng, 20) + " " + passage[k:] + words(rng, 5) for k in range(0, 90, 7)), "SE!! CIÓNCIEZ!! " * 12, words(rng, 9) + " ab" * 130 + words(rng, 9), "é" * 300, "x" * 700]
    docs = frame(spark, cases).withColumn("doc", F.lit("clash")).withColumn("a", F.lit(0)).repartition(7)
    want = brute_repeats(enumerate(cases), length)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.removal_digests(docs, length=length, budget=64).collect()}
    assert got == {i: v[:4] for i, v in want.items()}
    for r in repeats.without_repeats(docs, length=length).collect():
        kept = want[r.doc_id][4].decode("utf-8", "ignore")
        assert (r.text is None) == (cases[r.doc_id] is None) and len(kept) <= len(r.text or "") <= len(kept) + 4 * want[r.doc_id][2]
    assert repeats.removal_digests(frame(spark, [])).count() == 0


def test_repeats_order_of_ids(spark):
    t = "ab cd " * 3 + words(random.Random(1), 60)
    docs = spark.createDataFrame([(None, t), (7, t), (7, t), (7, t + "!"), (3, "short")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in repeats.removal_digests(docs).collect())
    n = len(t)
    assert ("None", n, 0) in got and got.count(("7", n, n)) == 2 and ("3", 5, 0) in got


def test_masks_find_every_window():
    from itertools import combinations
    for gone in combinations(range(13), 2):
        assert any(not set(gone) & {p + m for m in mask} for mask in decontaminate.MASKS for p in range(13 - mask[-1]))


def test_decontamination_matches_brute_force(spark, texts):
    rng = random.Random(11)
    items = [words(rng, n) for n in (14, 30, 59, 13, 8, 5, 3)] + [None, ""]
    cases = list(texts)
    for item in items[:7]:
        for swaps in (0, 1, 2, 3, 5):
            w = item.split()
            for k in rng.sample(range(len(w)), min(swaps, len(w))):
                w[k] = "zz"
            cases.append(words(rng, rng.randint(0, 40)) + " " + ", ".join(w).upper() + " " + words(rng, 30))
    docs = frame(spark, cases).withColumn("item_id", F.lit("clash")).withColumn("words", F.lit(0))
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    want = set()
    for i, t in enumerate(cases):
        w = re.findall(r"\w+", (t or "").lower())
        for j, item in enumerate(items):
            x = re.findall(r"\w+", (item or "").lower())
            n, allowed = (13, 2) if len(x) >= 13 else (len(x), 0)
            if len(x) >= 5 and any(sum(a == b for a, b in zip(w[p:p + n], x[q:q + n])) >= n - allowed for p in range(len(w) - n + 1) for q in range(len(x) - n + 1)):
                want.add((i, j))
    assert got == want and want
    left = {r.doc_id for r in decontaminate.decontaminated(docs, bench).collect()}
    assert left == set(range(len(cases))) - {i for i, _ in want}
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0 == decontaminate.contaminated(docs.limit(0), bench).count()


def test_language_held_out(spark, texts):
    from estatelens.llm import plans
    sf = "/root/testdata/sf0.01"
    got = plans.op2_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").where("held_out").collect()
    judged = [r for r in got if r.lang_pred != "und"]
    assert len(judged) > 100 and sum(r.lang_pred == r.lang for r in judged) >= 0.97 * len(judged)
    model = langid.fit(spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 300"))
    rows = {r.doc_id: r for r in langid.identify(frame(spark, texts).withColumn("score", F.lit("clash")), model).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        assert (rows[i].lang_pred == "und") == (not any(c.isalpha() for c in t or "")) and 0 <= rows[i].score <= 1
    nothing = langid.fit(frame(spark, []))
    assert {r.lang_pred for r in langid.identify(frame(spark, texts), nothing).collect()} == {"und"}


def test_forward_backward_is_exact(monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(toxicity, "LANE", 7)
    lengths, trans = np.array([0, 1, 30, 7, 0, 8]), np.array([[1.5, 0.4], [0.3, 2.0]])
    odds = np.exp(rng.normal(size=lengths.sum()))
    _, _, m = toxicity.forward_backward(odds, lengths, trans)
    for d in range(len(lengths)):
        e = odds[lengths[:d].sum():lengths[:d + 1].sum()]
        a, b = [], []
        x = np.array([0.5, 0.5])
        for v in e:
            x = (x @ trans) * [1, v]
            x /= x.sum()
            a.append(x)
        y = np.array([0.5, 0.5])
        for v in e[::-1]:
            b.append(y)
            y = trans @ (y * [1, v])
            y /= y.sum()
        for k, (p, q) in enumerate(zip(a, b[::-1])):
            assert m[lengths[:d].sum() + k] == pytest.approx(p[1] * q[1] / (p @ q))


def test_toxic_spans(spark, texts):
    rng = random.Random(4)
    rows = [(i, words(rng, 60) + (" grumbulous wretchkin " if i % 4 == 0 else " ") + words(rng, 30)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 300)] + [(0, None), (None, 1), (5, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    for r in toxicity.score_documents(docs, model).collect():
        assert r.predicted == int(r.doc_id % 4 == 0) and 0 <= r.score <= 1
        assert [rows[r.doc_id][1][s.start:s.end] for s in r.spans] == (["grumbulous", "wretchkin"] if r.doc_id % 4 == 0 else [])
    odd = toxicity.score_documents(frame(spark, texts), model).collect()
    assert len(odd) == len(texts) and all(0 <= r.score < 0.3 for r in odd)
    empty = toxicity.fit(docs, labels.limit(0))
    assert {r.predicted for r in toxicity.score_documents(docs, empty).collect()} == {0}
    assert toxicity.score_documents(docs.limit(0), model).count() == 0
