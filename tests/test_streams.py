"""Streams over keyed state tables: several micro-batches, hot keys, late numbers, expiry and replays."""

import datetime as dt
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from estatelens.contracts import JOURNAL_START, JOURNAL_TRANSITIONS
from estatelens.operators.journal import judge_events, states_after
from estatelens.streaming import logs as S
from estatelens.streaming.state import KeyedState

RUNS = "source_id string, seq long, outcome_state string, result_sha256 string"
EVENTS = "context_digest string, seq long, event_type string, expected_version long"


def landed(spark, path, spec, batches):
    for b in batches:
        spark.createDataFrame(b, spec).coalesce(1).write.mode("append").json(path)
        time.sleep(0.1)
    return spark.readStream.schema(spec).option("maxFilesPerTrigger", 1).json(path)


def walk(events, start=None):
    """Events of one context one by one."""
    legal = {(a, e): b for a, e, b in JOURNAL_TRANSITIONS}
    state, version = start or (JOURNAL_START, 0)
    out = []
    for seq, event, expected in sorted(events):
        to = legal.get((state, event))
        if expected is not None and expected != version:
            out.append((seq, event, "STALE_VERSION", None))
        elif to is None:
            out.append((seq, event, "ILLEGAL_TRANSITION", None))
        else:
            state, version = to, version + 1
            out.append((seq, event, "ACCEPTED", to))
    return out, (state, version)


def random_events(rnd, n, named):
    ring = ["initialized", "dispatch_response_lost", "reconcile_exact_before", "fresh_retry_authorized", "reconcile_diverged", "nonsense"]
    return [(seq, rnd.choices(ring, (4, 9, 9, 9, 0.2, 1))[0], rnd.randrange(0, 25) if rnd.random() < named else None) for seq in sorted(rnd.sample(range(4 * n), n))]


@pytest.mark.parametrize("block", [1, 4, 7, 1024])
def test_journal_scan_equals_a_walk(spark, block):
    rnd = random.Random(block)
    logs = {f"c{i}": random_events(rnd, n, named) for i, (n, named) in enumerate([(120, 0.4), (90, 1.0), (60, 0.0), (1, 0.5), (33, 0.2)])}
    known = {"c2": ("outcome_unknown", 7), "c4": ("not_dispatched", 1)}
    df = spark.createDataFrame([(c, *e) for c, v in logs.items() for e in v], EVENTS)
    before = spark.createDataFrame([(c, *s) for c, s in known.items()], S.JOURNAL_STATE)
    got = judge_events(df, before, block)
    want, last = set(), {}
    for c, v in logs.items():
        rows, last[c] = walk(v, known.get(c))
        want |= {(c, *r) for r in rows}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert {r.context_digest: (r.state, r.version) for r in states_after(got, before).collect()} == last


def test_journal_of_an_empty_batch(spark):
    assert judge_events(spark.createDataFrame([], EVENTS), spark.createDataFrame([], S.JOURNAL_STATE)).count() == 0


def test_journal_stream_carries_state(spark, tmp_path):
    rnd = random.Random(3)
    logs = {c: random_events(rnd, 40, 0.4) for c in ("a", "b")}
    batches = [[(c, *e) for c in logs for e in logs[c][lo:lo + 10]] for lo in range(0, 40, 10)]
    S.follow_journal(landed(spark, f"{tmp_path}/in", EVENTS, batches), f"{tmp_path}/out", f"{tmp_path}/state", f"{tmp_path}/cp", block=8, fold=2).awaitTermination()
    got = {tuple(r) for r in spark.read.schema(S.JOURNAL_OUT).parquet(f"{tmp_path}/out").select("context_digest", "seq", "event_type", "verdict", "to_state").collect()}
    assert got == {(c, *r) for c in logs for r in walk(logs[c])[0]}


def test_late_lower_number_is_a_regression_in_both_forms(spark, tmp_path):
    batches = [[("a", 5, "SUCCEEDED", "x"), ("b", 1, "FAILED", "q")], [("a", 4, "SUCCEEDED", "y"), ("a", 6, "SUCCEEDED", "x"), ("b", 1, "SUCCEEDED", "q")], [("a", 7, "SUCCEEDED", "z")]]
    want = {("a", 5, "RUN", "BASELINE", None), ("b", 1, "RUN", "NOT_COMPARABLE", None), ("a", 4, "SEQUENCE_REGRESSION", None, None), ("a", 6, "RUN", "UNCHANGED", 5),
            ("b", 1, "SEQUENCE_REGRESSION", None, None), ("a", 7, "RUN", "CHANGED", 6)}
    S.follow_runs(landed(spark, f"{tmp_path}/in", RUNS, batches), f"{tmp_path}/out", f"{tmp_path}/state", f"{tmp_path}/cp", fold=2).awaitTermination()
    cols = ["source_id", "seq", "event", "drift_state", "compared_to_seq"]
    assert {tuple(r) for r in spark.read.schema(S.DRIFT_OUT).parquet(f"{tmp_path}/out").select(cols).collect()} == want
    S.use_rocksdb(spark)
    st = spark.readStream.schema(RUNS).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    assert {tuple(r) for r in S.run_to_table(S.run_drift_stream(st), f"{tmp_path}/out2", f"{tmp_path}/cp2").select(cols).collect()} == want


def test_runs_with_nulls_and_equal_rows(spark):
    r = spark.createDataFrame([("a", None, "SUCCEEDED", "x"), ("a", 1, "SUCCEEDED", None), ("a", 1, "SUCCEEDED", None), ("a", 2, None, "x"), ("a", 3, "SUCCEEDED", "x")], RUNS)
    got = sorted((str(x.seq), x.event, x.drift_state) for x in S.drift_batch(r, spark.createDataFrame([], S.DRIFT_STATE)).collect())
    assert got == [("1", "RUN", "BASELINE"), ("1", "SEQUENCE_REGRESSION", None), ("2", "RUN", "NOT_COMPARABLE"), ("3", "RUN", "CHANGED"), ("None", "SEQUENCE_REGRESSION", None)]


def test_intake_state_shrinks_after_expiry(spark, tmp_path):
    t = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    spec = "idempotency_key string, request_id long, request_digest string, ts timestamp"
    first = [(f"k{i}", i, "d", t(0)) for i in range(50)] + [("k1", 90, "other", t(1))]
    batches = [first, [("k0", 100, "d", t(2)), ("new", 101, "d", t(50))], [("k0", 102, "e", t(51)), ("new", 103, "e", t(51))], [("late", 104, "d", t(52))]]
    S.follow_intake(landed(spark, f"{tmp_path}/in", spec, batches), f"{tmp_path}/out", f"{tmp_path}/state", f"{tmp_path}/cp", keep_seconds=36_000, fold=2).awaitTermination()
    got = {r.request_id: r.verdict for r in spark.read.schema(S.INTAKE_OUT).parquet(f"{tmp_path}/out").collect()}
    assert got[1] == "APPLIED" and got[90] == "CONFLICT" and got[100] == "ALREADY_APPLIED" and got[103] == "CONFLICT"
    assert got[102] == "APPLIED"  # the first request of k0 has expired
    size = lambda n: spark.read.parquet(f"{tmp_path}/state/base={n}").count()
    assert size(1) == 51 and size(3) == 3
    assert not os.path.exists(f"{tmp_path}/state/batch=0") and os.path.exists(f"{tmp_path}/state/batch=2")


def test_a_batch_run_again_finds_the_same_state(spark, tmp_path):
    k = KeyedState(f"{tmp_path}/s", "k string, v long", ["k"], fold=2)
    one = lambda *rows: spark.createDataFrame(rows, "k string, v long")
    for n in range(5):
        seen = sorted(map(tuple, k.before(spark, n).collect()))
        k.write(one(("x", n), (f"y{n}", n)), n)
        assert sorted(map(tuple, k.before(spark, n).collect())) == seen
        k.write(one(("x", n), (f"y{n}", n)), n)
    assert sorted(map(tuple, k.before(spark, 5).collect())) == [("x", 4), ("y0", 0), ("y1", 1), ("y2", 2), ("y3", 3), ("y4", 4)]
    assert sorted(map(tuple, k.touched(one(("x", 0), ("z", 1)), 5).collect())) == [("x", 4)]
    assert k.before(spark, 5, F.col("v") > 3).count() == 2
