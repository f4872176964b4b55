import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from estatelens.llm import bpe, tokenfile
from estatelens.llm.plans import tokenizer_path
from tests.llm.conftest import frame

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")


def test_bpe_is_the_librarys(spark, texts):
    lib = Tokenizer.from_file(BYTE)
    for r in bpe.round_trip_digests(frame(spark, texts).withColumn("ids", F.lit(1)), BYTE).collect():
        ids = lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_long_and_short_agree():
    t = bpe.ByteBPE(BYTE)
    rng = np.random.default_rng(1)
    for _ in range(300):
        w = bytes(rng.choice(np.frombuffer(b"abethr  nio\xc3\xa9", np.uint8), rng.integers(2, 60)))
        assert t._merge_short(w) == t._merge_long(w)


def test_bpe_arrays_and_empty(spark, texts):
    rows = bpe.decode_ids(bpe.encode_texts(frame(spark, texts), BYTE), BYTE, text="back").collect()
    assert all(r.back == (r.text or "") for r in rows)
    assert bpe.round_trip_digests(frame(spark, []), BYTE).count() == 0


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_token_files(spark, texts, tmp_path, path):
    docs = frame(spark, texts).unionAll(spark.createDataFrame([(None, "no id", None, None, None), (3, "repeated id", None, None, None)], frame(spark, []).schema)).repartition(5)
    tokenfile.write_tokens(docs, path, str(tmp_path / "t"), end_id=1)
    got = sorted(tokenfile.token_digests(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    lib, start = Tokenizer.from_file(path), 0
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    assert len(rows) == len(got)
    for r, g in zip(rows, got):
        ids = lib.encode(r.text or "", add_special_tokens=False).ids + [1]
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_files_empty(spark, tmp_path):
    tokenfile.write_tokens(frame(spark, []), WORD, str(tmp_path / "t"), end_id=1)
    assert tokenfile.token_digests(spark, str(tmp_path / "t")).count() == 0
