"""Faults found by the review of round 3, fourth part: the pipeline's near-copy stage."""

import numpy as np

from estatelens.llm import common
from estatelens.llm import nearcopies as N


def test_tile_refutes_long_texts_that_fill_narrow_bitmaps(spark):
    rng = np.random.default_rng(3)
    draw = lambda k: rng.integers(0, 2**63, k, np.uint64)
    half = draw(2000)
    sets = [np.unique(np.r_[half, draw(2000)]) for _ in range(6)]  # a third in common, the narrow bitmaps are full
    sets += [np.unique(np.r_[sets[0], draw(100)]), np.unique(draw(40))]
    sets.append(sets[-1][:-1])
    wide = [N.tile_bitmap(s) for s in sets]
    assert [len(w) * 8 if w else None for w in wide[-3:]] == [4096, None, None]
    rows = [(7, i, i, len(s), N.bitmap(s), w) for i, (s, w) in enumerate(zip(sets, wide))]
    members = spark.createDataFrame(rows, "h long, sid long, label long, n int, bits binary, wide binary")
    assert {tuple(r) for r in N.tile_pairs(members, 0.8).collect()} == {(0, 6), (7, 8)}
    assert len(N.tile_pairs(members.drop("wide"), 0.8).collect()) > 2


def test_tile_bitmaps_never_differ_by_more_than_the_sets():
    rng = np.random.default_rng(4)
    assert N.tile_bitmap(np.zeros(0, np.uint64)) is None
    x, y = (np.empty(3, object) for _ in range(2))
    sets = [np.unique(rng.integers(0, 2**63, k, np.uint64)) for k in (2040, 2500, 70000)]
    x[:] = [N.tile_bitmap(s) for s in sets]
    y[:] = [N.tile_bitmap(s[:-k]) for s, k in zip(sets, (1, 450, 7000))]
    n = np.array([len(s) for s in sets])
    assert len(x[2]) * 8 == N.TILE_BITS
    at = np.arange(3)
    assert N.stay_near((n, x), (n - [1, 450, 7000], y), at, at, 0.8).all()


def test_stars_take_no_round(spark, monkeypatch):
    cuts, plain = [], common.cut_lineage
    monkeypatch.setattr(common, "cut_lineage", lambda df: cuts.append(1) or plain(df))
    edges = lambda rows: spark.createDataFrame(rows, "a long, b long")
    got = common.components(edges([(1, 2), (3, 1), (4, 4), (7, 9), (2, 1)]))
    assert {tuple(r) for r in got.collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (9, 7)} and len(cuts) == 1
    got = common.components(edges([(i, i + 1) for i in range(40)] + [(50, 52), (51, 52)]))
    assert {tuple(r) for r in got.collect()} == {(i, 0) for i in range(41)} | {(i, 50) for i in (50, 51, 52)}
    assert common.components(edges([])).collect() == []
