import numpy as np
import pytest
from pyspark.sql import functions as F


@pytest.mark.parametrize("shape", [(3, 7), (7, 3), (2, 2), (40, 9), (200, 77)])
def test_full_block_of_two_tiles(shape):
    from estatelens.llm.simhash import tile_links
    a, b = np.full(shape[0], 5, np.uint64), np.full(shape[1], 5, np.uint64)
    x, y = tile_links(a, b, 2, False)
    seen, grew = {("a", 0)}, True
    while grew:
        new = {e for i, j in zip(x.tolist(), y.tolist()) for e in (("a", i), ("b", j)) if {("a", i), ("b", j)} & seen}
        grew, seen = bool(new - seen), seen | new
    assert len(seen) == sum(shape) and len(x) <= sum(shape)


def test_one_row_per_group_of_null_and_repeated_ids(spark):
    from estatelens.llm.simhash import deduplicated
    rng = np.random.default_rng(1)
    text = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 80)) for _ in range(6)]
    rows = [(None, text[0]), (None, text[1]), (None, text[1]), (None, text[2]), (1, text[2]), (2, text[3]), (2, text[4]), (2, text[4]), (4, text[5]), (3, text[5]), (None, None), (5, "")]
    kept = deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(None, text[0]), (None, text[1]), (1, text[2]), (2, text[3]), (2, text[4]), (3, text[5]), (5, "")], key=str)


def _brute_groups(texts, words=5, similarity=0.8):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9 and label[i] != label[j]:
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    return label


def test_pipeline_drops_near_copies_as_brute_force(spark):
    import corpus_pipeline
    rng = np.random.default_rng(3)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    licence = word(30)
    texts = [None, "", "one", "One", "a b c", "a b c d e"]
    for n in (20, 60, 150, 400):
        for family in range(3):
            base = word(n) + licence
            texts.append(" ".join(base))
            for share in (0.0, 0.01, 0.02, 0.03, 0.04, 0.05):  # similarity from 1 down to some 0.6, and chains of copies of copies
                copy = list(base)
                for at in rng.integers(0, n, round(share * n)):
                    copy[at] = word(1)[0]
                texts.append(" ".join(copy))
                base = copy if family else base
    texts += [" ".join(word(8) + licence) for _ in range(6)] + [" ".join(licence)]
    label = _brute_groups(texts)
    assert 20 < len(set(label)) < len(texts) - 20
    rows = [(i, t, None, "s", 0) for i, t in enumerate(texts)]
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label))


def test_repeated_row_that_comes_first_keeps_its_text(spark):
    from estatelens.llm.repeats import removal_digests
    rng = np.random.default_rng(5)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    passage = word(20)
    varied, other, selves = f"{word(30)} {passage} {word(30)}", f"{word(30)} {passage} {word(30)}", "x" * 700
    once = [(1, varied), (2, other), (3, selves), (None, word(40) + " y" * 300)]
    answer = lambda rows: {tuple(r) for r in removal_digests(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_bytes", "n_removed", "kept_sha256").collect()}
    alone = answer(once)
    assert {r[0]: r[2] for r in alone}[1] == 0 and {r[0]: r[2] for r in alone}[3] == 699 and {r[0]: r[2] for r in alone}[2] > 0
    assert answer(once + once[:1] + 2 * once[2:]) == alone


def test_heads_of_any_length_and_broken_chains(spark, tmp_path):
    from estatelens.llm import warc
    rows = [(i, "http://a/" + "u" * (300_000 if i % 3 == 0 else 10), f"<p>{i}</p>" * 50) for i in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    folder = str(tmp_path / "w")
    archives = warc.write_archives(pages, folder)
    for block in (1 << 14, 1 << 20):
        got = warc.read_records(archives, folder, block).select("page_id", "url", F.decode("payload", "utf-8")).collect()
        assert sorted(map(tuple, got)) == rows
    with pytest.raises(ValueError, match="records in the chain"):
        warc.boundaries(archives.withColumn("records", F.col("records") + 1), folder)
    name, size = archives.where("bytes > 0").select("file", "bytes").first()
    with open(f"{folder}/{name}", "ab") as f:
        f.write(b"x" * 50)
    with pytest.raises(ValueError, match="does not end"):
        warc.boundaries(archives.withColumn("bytes", F.when(F.col("bytes") > 0, F.col("bytes") + 50).otherwise(0)), folder)
