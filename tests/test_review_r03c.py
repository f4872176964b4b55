"""Faults found by the review of round 3, third part: work that outgrows its input."""

import random

from estatelens.operators import journal as J

from .test_streams import EVENTS, S, landed, random_events, walk


def test_sparse_blocks_of_a_journal_are_one(spark, monkeypatch):
    rounds, plain = [], J._compose
    monkeypatch.setattr(J, "_compose", lambda maps: rounds.append(1) or plain(maps))
    rnd = random.Random(5)
    logs = {c: [(seq * 1000, event, v) for seq, event, v in random_events(rnd, n, 0.3)] for c, n in (("a", 64), ("b", 40), ("c", 3))}
    df = spark.createDataFrame([(c, *e) for c, v in logs.items() for e in v], EVENTS)
    got = J.judge_events(df, spark.createDataFrame([], S.JOURNAL_STATE), 512)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(c, *r) for c in logs for r in walk(logs[c])[0]], key=repr)
    assert len(rounds) == 1  # four blocks of some 16 events, where each event was a block


def test_sources_share_a_group(spark, tmp_path):
    """Twelve sources in two shares, one of them null, over two batches; the state of a source without rows stays as it was."""
    names = [None, *(f"s{i}" for i in range(11))]
    rows = lambda lo, of: [(s, lo + k, "FAILED" if k == 1 else "SUCCEEDED", f"h{k // 3}") for s in of for k in (2, 0, 1)]
    batches = [rows(10, names), rows(20, names[:4]), rows(5, names[2:6])]
    stream = landed(spark, f"{tmp_path}/in", "source_id string, seq long, outcome_state string, result_sha256 string", batches)
    S.use_rocksdb(spark)
    got = S.run_to_table(S.run_drift_stream(stream, shares=2), f"{tmp_path}/out", f"{tmp_path}/cp")
    want = []
    for s in names:
        want += [(s, 10, "RUN", "BASELINE", None), (s, 11, "RUN", "NOT_COMPARABLE", None), (s, 12, "RUN", "UNCHANGED", 10)]
    for s in names[:4]:
        want += [(s, 20, "RUN", "UNCHANGED", 12), (s, 21, "RUN", "NOT_COMPARABLE", None), (s, 22, "RUN", "UNCHANGED", 20)]
    want += [(s, k, "SEQUENCE_REGRESSION", None, None) for s in names[2:6] for k in (5, 6, 7)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
