import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from estatelens.llm import plans, urlfilter, vectors, warc


def test_warc_round_trip(spark, tmp_path):
    fake = warc.record("response", 99, "http://in.side", "0" * 64, 5, b"hello").decode()  # a whole record inside a payload
    bodies = [None, "", "x" * 99, "x" * 99, "y" * 100, "y" * 100, "y" * 100, "é" * 60, fake, fake * 3, "WARC/1.1\r\n" * 20, "z" * 70_000, "tail WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 9]
    rows = [(10 - i, f"http://a.b/{i}\r\nX-Evil: 1", b, 0) for i, b in enumerate(bodies)] + [(None, None, "y" * 100, 0), (3, "u", "y" * 100, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    for parts, block in ((1, 300), (4, 64), (2, 1 << 20)):
        folder = str(tmp_path / f"{parts}-{block}")
        archives = warc.write_archives(pages.repartition(parts), folder)
        got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_records(archives, folder, block).collect()), key=str)
        first = {}
        for i, _, b, _ in rows:
            if i is not None:
                first[b or ""] = min(first.get(b or "", i), i)
        want = []
        for i, _, b, _ in rows:
            raw = (b or "").encode()
            again = len(raw) >= 100 and i != first.get(b or "", i)
            want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[b] if again else None))
        assert got == sorted(want, key=str)
    empty = warc.write_archives(pages.limit(0), str(tmp_path / "e"))
    assert warc.read_records(empty, str(tmp_path / "e")).count() == 0


def test_urls_match_sql(spark, tmp_path):
    urls = [None, "", "no scheme", "http://", "HTTPS://WWW.Example.ORG/en/1?x", "http://a.example.org/es/", "http://org", "http://org/", "http://xorg/", "ftp://u@h.com:80/de/x#y", "http://a.com?q=/fr/", "http://b.com/fr/1", "http://b.com/fr/1", "x://É.co.uk/é/../p?://", "http://c.b.co.uk/", "a://b://c/d", "http://c.com/zz", "http://ü.com/de/\nq"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(None, "http://b.com/de/", "clash")] + [(100 + i, f"http://bad.net/{i}", "x") for i in range(9)], "page_id long, url string, host string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(map(str, (tuple(r) for r in plans.op10_url_reputation(spark, str(tmp_path)).collect())))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(map(str, con.sql(plans.op10_sql()).fetchall()))
    assert urlfilter.judge_urls(pages.limit(0)).count() == 0


def test_reputation_blocks_bad_hosts(spark):
    rows = [(i, f"http://bad.site.com/de/{i}") for i in range(60)] + [(100 + i, f"http://good.other.com/fr/{i}") for i in range(60)] + [(300, "http://bad.site.com/x"), (301, "http://good.other.com/x")]
    got = {r.page_id: r.verdict for r in urlfilter.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[300] == "block" and got[301] == "allow"


@pytest.mark.parametrize("scale", [1.0, "varied"])
def test_nearest_recall(spark, scale):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(40, 24))
    x = centers[rng.integers(0, 40, 3000)] + 0.4 * rng.normal(size=(3000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if scale == "varied":
        x *= rng.uniform(0.8, 1.2, (3000, 1))
    x[2000:] = x[2000]  # a third are equal
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(9000, None, 0), (9020, [0.0] * 24, 0), (9040, [float("nan")] * 24, 0), (9060, [1.0, None] * 12, 0), (9080, [1.0], 0), (None, [1.0] * 24, 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, list int")
    got = {}
    for r in vectors.nearest(table, k=20, query=lambda v: v % 20 == 0, list_rows=64).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    hits = 0
    for q in range(0, 3000, 20):
        rows = sorted(got[q])
        assert [r[0] for r in rows] == list(range(1, 21)) and q not in {r[1] for r in rows}
        assert all(abs(v - s[q, i]) < 1e-9 for _, i, v in rows)
        best = sorted(range(3000), key=lambda i: (-round(s[q, i], 9), i))[:20]
        hits += len({r[1] for r in rows} & set(best))
    assert set(got) == set(range(0, 3000, 20)) and hits >= 0.9 * 20 * len(got)
    assert vectors.nearest(table.limit(0)).count() == 0
    assert vectors.nearest(table.where("vec_id < 3"), k=20).count() == 6


def test_queries_whose_lists_are_thin_are_completed(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 8)) * rng.uniform(0.2, 3, (700, 1))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in vectors.nearest(table, k=20, query=lambda v: v % 20 == 0, list_rows=8, width=2, replicas=1).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    assert set(got) == set(range(0, 700, 20)) and all(sorted(r for r, _ in v) == list(range(1, 21)) for v in got.values())
    hits = sum(len({i for _, i in got[q]} & set(np.argsort(-s[q])[:20].tolist())) for q in got)
    assert hits == 20 * len(got)  # all of them were compared with every vector
