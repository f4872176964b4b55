"""Nested disclosure, six surfaces, evidence ledgers, inclusion sketches, probe reuse, overviews at ingest, canonical nested text."""

import json
import random

import pytest
from pyspark.sql import functions as F

from estatelens.functions import hashing as H
from estatelens.functions.scans import blocked_sums
from estatelens.operators import catalog as C
from estatelens.operators import drift as D
from estatelens.operators import logs as L
from estatelens.operators import relationships as J
from estatelens.operators.disclosure import disclosure_walk
from estatelens.plans import workflows as W


def test_disclosure_at_any_depth(spark):
    deep = "x"
    for i in range(60):
        deep = {"k": deep} if i % 2 else [deep]
    docs = [(1, json.dumps({"a": [{"b": {"password": "p"}}, ["ok", {"rows": []}]], "note": ""})), (2, json.dumps([[{"apiKey": 1}]])), (3, "{broken"), (4, None), (5, json.dumps({"list": list(range(501))})),
            (6, json.dumps({"t": "x" * 100_001, "u": "a\u0001b"})), (7, json.dumps({"deep": deep, "Client-Secret": None})), (8, '"select a from b"'), (8, '"select a from b"'), (9, "7"), (10, json.dumps({"é": {"dsn": {}}}))]
    df = spark.createDataFrame(docs, "id int, body string").withColumn("path", F.lit("clash")).withColumn("key", F.lit("clash"))
    got = sorted(map(tuple, disclosure_walk(df, ["id"], "body").collect()))
    assert got == sorted([(1, "$.a[0].b.password", "SECRET_KEY"), (1, "$.a[0].b.password", "UNSAFE_EVIDENCE_KEY"), (1, "$.a[1][1].rows", "SOURCE_ROW_KEY"), (1, "$.note", "TEXT_DENIED"), (2, "$[0][0].apiKey", "SECRET_KEY"),
                          (2, "$[0][0].apiKey", "UNSAFE_EVIDENCE_KEY"), (3, "$", "NOT_JSON"), (5, "$.list", "ARRAY_OVERSIZED"), (6, "$.t", "TEXT_DENIED"), (6, "$.u", "TEXT_DENIED"), (7, "$.Client-Secret", "SECRET_KEY"),
                          (8, "$", "RAW_SQL"), (8, "$", "RAW_SQL"), (10, "$.é.dsn", "UNSAFE_EVIDENCE_KEY")])
    assert disclosure_walk(df.limit(0), ["id"], "body").count() == 0


TARGET = "kind string, schema_name string, relation_name string, column_name string, dst_schema_name string, dst_relation_name string, dst_column_name string"


def test_a_table_is_visible_through_any_of_its_columns(spark):
    entry = lambda col, q: ("COLUMN", "s", "t", col, None, None, None, q)
    base = spark.createDataFrame([entry("a", "q1"), entry("b", "q2")], TARGET + ", query_id string")
    now = spark.createDataFrame([entry("b", "q2")], TARGET + ", query_id string")
    targets = spark.createDataFrame([("profiles", "table", "TABLE", "s", "t", None, None, None, None), ("roles", "seen", "COLUMN", "s", "t", "b", None, None, None), ("roles", "gone", "COLUMN", "s", "t", "z", None, None, None)], "surface string, id string, " + TARGET)
    item = lambda *rows: spark.createDataFrame(list(rows), "id string, sha256 string")
    cov = lambda *rows: spark.createDataFrame(list(rows), "id string, sha256 string, query_id string")
    def run(state1, state2):
        q = spark.createDataFrame([("q1", state1, "VISIBLE_COMPLETE" if state1 == "SUCCEEDED" else "INVISIBLE", "WHY_ONE"), ("q2", state2, "VISIBLE_COMPLETE" if state2 == "SUCCEEDED" else "INVISIBLE", "WHY_TWO")], "query_id string, state string, visibility string, reason_code string")
        before = {"coverage": cov(("c1", "x", "q1")), "profiles": item(("table", "x"), ("kept", "x")), "roles": item(("seen", "x"), ("gone", "x"), ("new", "old"))}
        after = {"coverage": cov(), "profiles": item(("kept", "x")), "roles": item(("new", "new"), ("added", "x"))}
        return {(r.surface, r.id): (r.classification, r.semantics, r.reason_code) for r in D.surface_diff(before, after, targets, base, now, q).collect()}
    ok = run("SUCCEEDED", "SUCCEEDED")
    assert ok[("profiles", "table")] == ("UNKNOWN", "EVIDENCE_NOT_REOBSERVED", "CURRENT_EVIDENCE_INCOMPLETE") and ok[("coverage", "c1")] == ("REMOVED", "OBSERVED_REMOVAL", None)
    assert ok[("roles", "gone")] == ("UNKNOWN", "VISIBILITY_UNKNOWN", "CURRENT_VISIBILITY_UNKNOWN") and ok[("roles", "new")][0] == "CHANGED" and ok[("roles", "added")][0] == "ADDED" and len(ok) == 6
    lost = run("DENIED", "UNSUPPORTED")
    assert lost[("profiles", "table")] == ("DENIED", "VISIBILITY_LOSS", "WHY_ONE") and lost[("roles", "seen")] == ("UNSUPPORTED", "VISIBILITY_LOSS", "WHY_TWO") and lost[("coverage", "c1")][0] == "DENIED"


def test_evidence_ledger_equals_a_fold(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 5)
    rnd = random.Random(1)
    events = []
    for h in ("a", "b", "c"):
        for seq in range(1, 31):
            state = rnd.choices(["SUCCEEDED", "PARTIAL", "UNKNOWN", "DENIED"], (20, 5, 2, 0.3))[0]
            sig = rnd.choice(["SUPPORTS", "COUNTERS", "NO_GAIN"]) if state in ("SUCCEEDED", "PARTIAL") else "UNKNOWN"
            events.append((h, seq, state, sig, 0, rnd.choice([None, [], ["r1"], ["r1", "r2", None], [f"r{rnd.randrange(9)}"]]), rnd.choice([None, f"c{rnd.randrange(6)}"]), rnd.randrange(9), 9))
    df = spark.createDataFrame(events, "hypothesis_id string, seq long, result_state string, signal string, information_gain_bps int, evidence_refs array<string>, source_receipt string, lower_bps int, upper_bps int")
    got = {(r.hypothesis_id, r.seq): r for r in L.evidence_ledger(df, 3, 3).collect()}
    want = 0
    for h in ("a", "b", "c"):
        sup, con, rec, x = set(), set(), set(), 0
        for e in [e for e in events if e[0] == h]:
            lit = e[2] in ("SUCCEEDED", "PARTIAL")
            if lit and e[3] in ("SUPPORTS", "COUNTERS"):
                (sup if e[3] == "SUPPORTS" else con).update(r for r in e[5] or [] if r)
            rec.update([e[6]] if e[6] else [])
            x += lit and e[3] == "COUNTERS"
            r = got[h, e[1]]
            want += 1
            assert (r.supporting_refs, r.counter_refs, r.receipts, r.contradictions, r.lower_bps) == (len(sup), len(con), len(rec), x, e[7])
            if r.status == "STOPPED":
                break
    assert want == len(got)


def test_blocked_sums(spark):
    df = spark.createDataFrame([("k", i, i) for i in range(40)] + [("m", 3, 7)], "k string, seq long, x long")
    got = {(r.k, r.seq): r.s for r in blocked_sums(df, ["k"], "seq", F.floor(F.col("seq") / 7), {"x": "s"}).collect()}
    assert all(got["k", i] == i * (i + 1) // 2 for i in range(40)) and got["m", 3] == 7


@pytest.mark.parametrize("k", [1, 3, 1000])
def test_sketches_lose_no_inclusion(spark, k):
    rnd = random.Random(k)
    sets = {f"c{i}": set(rnd.sample(range(40), rnd.randrange(1, 30))) for i in range(12)}
    sets |= {f"s{i}": set(rnd.sample(sorted(sets[f"c{i}"]), max(1, len(sets[f"c{i}"]) // 2))) for i in range(6)}
    values = spark.createDataFrame([(c, str(v), 1) for c, s in sets.items() for v in s], "column_id string, value_key string, n long")
    names = [*sets, "empty"]
    sets["empty"] = set()
    pairs = spark.createDataFrame([(a, b) for a in names for b in names if a != b], "source_id string, target_id string")
    got = J.inclusions(values, pairs, k).collect()
    assert {(r.source_id, r.target_id): r.included for r in got} == {(a, b): sets[a] <= sets[b] for a in names for b in names if a != b}
    assert any(r.refuted_by == "VALUE_MISSING" for r in got)
    if k == 1000:
        assert all(r.included for r in got if r.refuted_by is None)


def test_probes_are_reused_or_suppressed(spark):
    q = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("b", 4), ("c", 5), ("d", 6)], "probe_key string, ordinal long")
    r = spark.createDataFrame([("a", "FAILED", "1"), ("a", "SUCCEEDED", "2"), ("c", "FAILED", "3")], "probe_key string, result_state string, receipt_sha256 string")
    got = {x.ordinal: (x.disposition, x.receipt_sha256) for x in L.probe_dispositions(q, r, spark.createDataFrame([("c",)], "probe_key string")).collect()}
    assert got == {1: ("REUSED_SUCCESS", "2"), 2: ("REUSED_SUCCESS", "2"), 3: ("AUTHORIZED", None), 4: ("SUPPRESSED_DUPLICATE", None), 5: ("SUPPRESSED_DUPLICATE", "3"), 6: ("AUTHORIZED", None)}


def test_answers_hold_all_rows_unless_asked(spark):
    over = spark.range(50).select(F.format_string("s%02d", "id").alias("schema_name"))
    assert C.answer("object_inventory_validity", {"overview": over}).count() == 50
    assert C.answer("object_inventory_validity", {"overview": over}, limit=3).count() == 3
    with pytest.raises(ValueError):
        C.answer("object_inventory_validity", {"overview": over}, limit=0)


def test_summary_of_what_a_scope_could_not_see(spark):
    rel = spark.createDataFrame([("x", "s"), ("y", "s")], "snapshot_id string, schema_name string")
    st = spark.createDataFrame([("x", "s", "INVALID"), ("x", "s", None)], "snapshot_id string, schema_name string, status string")
    ex = spark.createDataFrame([("x", "SUCCEEDED"), ("x", "DENIED"), ("x", "PARTIAL"), ("y", "SUCCEEDED")], "snapshot_id string, state string")
    got = {r.snapshot_id: tuple(r)[1:] for r in C.schema_summary({"relations": rel, "stored-objects": st}, ex, W.SNAPSHOT).collect()}
    assert got == {"x": ("s", 1, 0, 2, 1, 0, 2, False), "y": ("s", 1, 0, 0, 0, 0, 0, True)}


def test_equal_nested_values_hash_alike(spark):
    spec = "id int, m map<string,string>, s struct<a:string,l:array<string>>, d array<double>"
    rows = [(1, {"a": "x\r\ny", "b": "e\u0301"}, ("q\r", ["e\u0301"]), [0.0]), (2, {"b": "\u00e9", "a": "x\ny"}, ("q\n", ["\u00e9"]), [-0.0]), (3, {"a": "x\ny"}, ("q\n", ["\u00e9"]), [0.0]), (4, None, None, None)]
    got = {r.id: r.object_sha256 for r in H.with_hash(spark.createDataFrame(rows, spec), ["m", "s", "d"]).collect()}
    assert got[1] == got[2] and len(set(got.values())) == 3
    assert H.SCHEME == "v2"
