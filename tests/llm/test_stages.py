"""Every stage of the corpus pipeline on odd tables: clashing names, nulls, empties, ties, repeated rows, long texts, no rows."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from estatelens.llm import nearcopies

SF = "/root/testdata/sf0.001"
SPEC = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["_th", "_n", "_id", "_stay", "_raw", "_doc", "_cuts", "_runs", "_t", "_text", "_score", "_predicted", "_spans", "row", "own", "th", "stay", "nth", "text_key", "a.b", "_whole", "label", "h", "sid"]


def odd_rows():
    rnd = random.Random(9)
    text = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    long_, one = text(30_000), text(60)
    rows = [(None, None), (None, ""), (None, one), (1, None), (1, ""), (2, one), (2, one), (3, one + " end"), (4, long_), (5, " "), (5, text(40)), (5, text(40)), (6, "a"), (-7, text(50)), (8, "é" * 500)]
    return [(i, t, None if i == 1 else "en", "s", len(t or "")) for i, t in rows]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stage_on_odd_rows(spark, name, stage):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, SPEC)
    for c in CLASHES:
        docs = docs.withColumn(c, F.lit("kept"))
    got = stage(spark, docs, SF)
    assert got.columns == docs.columns
    kept = [r.asDict() for r in got.collect()]
    assert all(r[c] == "kept" for r in kept for c in CLASHES)
    ids = {(r["doc_id"], r["lang"]) for r in kept}
    if name == "simhash":
        assert len(kept) == 8  # five texts without a word are one group, four copies of one text another, six stand alone
        assert any(r["doc_id"] == 2 for r in kept) and not any(r["doc_id"] == 3 for r in kept)
    elif name in ("toxicity", "decontaminate"):
        assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept) == sorted((str(r[0]), str(r[1])) for r in rows)
    else:
        assert len(kept) == len(rows) and ids == {(r[0], r[2]) for r in rows}
        assert all(r["n_chars"] == len(r["text"] or "") for r in kept if r["text"] is not None)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_no_rows(spark, name, stage):
    docs = spark.createDataFrame([], SPEC)
    got = stage(spark, docs, SF)
    assert got.count() == 0 and (name == "bpe" or got.columns == docs.columns)


@pytest.mark.parametrize("tile,members", [(512, 1000), (4, 3)])
def test_hot_shingles_of_unlike_texts(spark, monkeypatch, tile, members):
    """Many texts share passages and stay below the similarity; families of copies stand among them; tiles and parts are small."""
    monkeypatch.setattr(nearcopies, "TILE", tile)
    monkeypatch.setattr(nearcopies, "MEMBERS", members)
    rnd = random.Random(tile)
    word = lambda n: [f"w{rnd.randrange(10**7)}" for _ in range(n)]
    licence, banner = word(25), word(12)
    texts = [" ".join(word(rnd.choice([6, 12, 30])) + licence + (banner if i % 2 else [])) for i in range(60)]
    for _ in range(4):
        base = word(40) + licence
        for k in range(8):
            copy = list(base)
            for at in rnd.sample(range(len(copy)), k % 4):
                copy[at] = word(1)[0]
            texts.append(" ".join(copy))
    sets = [set(nearcopies.shingle_set(t).tolist()) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {}
    for r in nearcopies.labelled(df).collect():
        got.setdefault(r.label, set()).add(r.doc_id)
    assert sorted(map(sorted, got.values())) == sorted(sorted(i for i, x in enumerate(label) if x == k) for k in set(label))
    assert 60 < len(got) < len(texts)
