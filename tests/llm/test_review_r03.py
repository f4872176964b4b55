"""Faults found by the review of round 3 in the training-data operators."""

import numpy as np

from estatelens.llm import nearcopies as N
from estatelens.llm.simhash import text_hash
from estatelens.session import Scratch


def test_folded_bitmaps_never_differ_by_more_than_the_sets():
    rng = np.random.default_rng(1)
    for n, m in ((500, 600), (2000, 2100), (2000, 2500), (30, 4000)):
        common = rng.integers(0, 2**63, min(n, m) // 2, np.uint64)
        a, b = (np.unique(np.r_[common, rng.integers(0, 2**63, k - len(common), np.uint64)]) for k in (n, m))
        x, y = (N.wide_bitmap(s) or N.bitmap(s) for s in (a, b))
        assert N.differing(x, y) <= len(np.setxor1d(a, b)) and N.differing(x, x) == 0
        assert N.differing(x, N.bitmap(a)) == 0  # the wider one folds into the narrow one


def test_texts_of_unlike_long_documents_stay_where_they_are(spark):
    words = lambda k, lo, hi: " ".join(f"w{k}x{i}" for i in range(lo, hi))
    half = words("h", 0, 2000)
    texts = [half + " " + words("a", 0, 2000), half + " " + words("b", 0, 2000), half + " " + words("a", 0, 1900), words("s", 0, 30), words("s", 0, 29)]
    sets = [N.shingle_set(t) for t in texts]
    wide = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("th", text_hash("text"))
    th = {r.text: r.th for r in wide.collect()}
    nodes = spark.createDataFrame([(i, th[t], len(s), N.bitmap(s), N.wide_bitmap(s)) for i, (t, s) in enumerate(zip(texts, sets))], "sid long, th long, n int, bits binary, more binary")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 2), (3, 4), (0, 3)], "a long, b long")
    assert {(0, 1), (0, 2), (1, 2), (3, 4)} == {tuple(r) for r in N.possible(pairs, nodes, 0.8).collect()}  # narrow bitmaps are full
    kept = []
    with Scratch(spark) as scratch:
        plain = scratch.keep
        scratch.keep = lambda df: kept.append(plain(df)) or kept[-1]
        counts = []
        scratch.drop = lambda *tables: counts.extend(t.count() for t in tables)
        got = N.verified(scratch, pairs.where("a = 3 or b <> 3"), wide, nodes, 5, 0.8)
        assert {tuple(r) for r in got.collect()} == {(0, 2), (3, 4)} and counts == [2, 4]  # pairs, and texts that were read out for them
        del scratch.drop
