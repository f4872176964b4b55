"""Landing, JSON extracts, collectors over several sources, sinks, registry and streams."""

import json

import pytest
from pyspark.sql import functions as F

from estatelens.operators import logs as batch
from estatelens.sources import extracts as X
from estatelens.sources import inventory as I
from estatelens.sources import sinks as K
from estatelens.sources.collectors import collect, conform
from estatelens.sources.collectors.mssql import name_part
from estatelens.streaming import logs as S


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


ORA = X.Source("db1", "oracle", "jdbc:oracle:thin:@//h/x", "u", "NO_SUCH_ENV", schemas=("HR",))


def test_scope_is_pushed_into_the_read():
    assert X.raw_query(ORA, "all_tables").endswith("FROM all_tables WHERE owner IN ('HR')")
    assert "WHERE" not in X.raw_query(ORA, "session_privs")
    with pytest.raises(ValueError):
        X.raw_query(X.Source("d", "oracle", "", "u", "E", schemas=("HR' OR 1=1",)), "all_tables")
    pg = X.jdbc_options(X.Source("d", "postgresql", "jdbc:postgresql://h/d", "u", "E"), "pg_class", None)
    assert "READ ONLY" in pg["sessionInitStatement"] and pg["queryTimeout"] == "7" and "password" not in pg
    assert X.jdbc_options(X.Source("d", "mssql", "jdbc:sqlserver://h", "u", "E"), "sys.tables", "p")["applicationIntent"] == "ReadOnly"


@pytest.mark.parametrize("engine,msg,want", [
    ("oracle", "ORA-01013: user requested cancel", "TIMEOUT"), ("oracle", "ORA-01031: insufficient privileges", "DENIED"), ("oracle", "ORA-00904: invalid identifier", "ERROR"),
    ("postgresql", "ERROR: canceling statement (SQLSTATE 57014)", "TIMEOUT"), ("postgresql", "permission denied for table x (SQLSTATE 42501)", "DENIED"), ("mssql", "The query has timed out.", "TIMEOUT"),
    ("mssql", "The SELECT permission was denied, Error 229", "DENIED")])
def test_failures_become_states(engine, msg, want):
    state, reason = X.classify_failure(engine, msg)
    assert state == want and reason == reason.upper()


def test_one_failed_read_does_not_end_the_run(spark, tmp_path):
    tables = {
        "all_objects": spark.createDataFrame([("HR", "T", "TABLE", 1, "VALID", None, None, "N")],
                                             "OWNER string, OBJECT_NAME string, OBJECT_TYPE string, OBJECT_ID long, STATUS string, CREATED timestamp, LAST_DDL_TIME timestamp, TEMPORARY string"),
        "all_synonyms": spark.createDataFrame([], "owner string, synonym_name string, table_owner string, table_name string, db_link string")}

    def reader(_, options):
        for name, df in tables.items():
            if f"FROM {name} " in options["query"] + " ":
                return df
        raise RuntimeError("ORA-01031: insufficient privileges")

    landed = X.land(spark, ORA, str(tmp_path), ["all_objects", "all_synonyms", "all_errors"], reader=reader)
    assert landed["all_objects"] == ("SUCCEEDED", None) and landed["all_errors"] == ("DENIED", "ORA_01031")
    got, status = X.read_extract(spark, ORA, "oracle.structure.relations", str(tmp_path), landed)
    assert [r.relation_name for r in got.collect()] == ["T"] and status.first().row_count == 1
    none, status = X.read_extract(spark, ORA, "oracle.stored.errors", str(tmp_path), landed)
    assert none is None and (status.first().state, status.first().reason_code) == ("DENIED", "ORA_01031")
    empty, status = X.read_extract(spark, ORA, "oracle.structure.synonyms", str(tmp_path), landed)
    assert empty.count() == 0 and status.first().state == "SUCCEEDED"


def test_a_real_jdbc_failure_is_a_state(spark, tmp_path):
    src = X.Source("d", "postgresql", "jdbc:postgresql://127.0.0.1:1/none", "u", "NO_SUCH_ENV")
    assert X.land(spark, src, str(tmp_path), ["pg_roles"])["pg_roles"][0] in ("ERROR", "DENIED", "TIMEOUT")


def test_landed_json(spark, tmp_path):
    doc = {"engine": "mssql", "runtimeValidated": False, "results": {
        "mssql.structure.schemas": {"state": "SUCCEEDED", "rows": [{"schema_name": "dbo", "schema_id": 1, "owner_name": "dbo"}, {"schema_name": "x", "schema_id": 5, "owner_name": None}]},
        "mssql.structure.indexes": {"state": "DENIED", "reasonCode": "NO_RIGHT", "rows": []}}}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    e = X.read_extract_json(spark, str(tmp_path))
    assert {r.query_id: (r.state, r.reason_code, r.row_count) for r in e.collect()} == {"mssql.structure.schemas": ("SUCCEEDED", None, 2), "mssql.structure.indexes": ("DENIED", "NO_RIGHT", 0)}
    assert rows(X.extract_rows(e, "schemas", "mssql.structure.schemas").drop("path")) == [("dbo", 1, "dbo"), ("x", 5, None)]


def test_collector_keeps_sources_apart(spark):
    raw = {"sys.schemas": spark.createDataFrame([("a", 1, "dbo", 1), ("b", 1, "sales", 1), ("a", 4, "sys", 1)], "source_id string, schema_id long, name string, principal_id long"),
           "sys.database_principals": spark.createDataFrame([("a", 1, "own_a"), ("b", 1, "own_b")], "source_id string, principal_id long, name string")}
    got = collect("mssql.structure.schemas", raw, ["source_id"])
    assert rows(got) == [("a", "dbo", 1, "own_a"), ("b", "sales", 1, "own_b")]
    assert conform(got, "schemas", ["source_id"]).columns == ["source_id", "schema_name", "schema_id", "owner_name"]


def test_name_parts(spark):
    df = spark.createDataFrame([("[a.b].[c]",), ("s.d.c.o",), ("a.b.c.d.e",), ("o",)], "n string")
    assert [tuple(r) for r in df.select(*[name_part("n", i) for i in (1, 2, 3, 4)]).collect()] == [("c", "a.b", None, None), ("o", "c", "d", "s"), (None, None, None, None), ("o", None, None, None)]


def test_inventory_and_methods(spark):
    df = spark.createDataFrame([(1, "a")], "id int, s string")
    assert rows(I.inventory(spark, {"t": df}).select("table_name", "column_name", "family")) == [("t", "id", "NUMERIC"), ("t", "s", "TEXT")]
    assert I.run_method("COLUMN_PROFILE", df, column="id", family="NUMERIC").first().distinct_count == 1
    assert I.run_method("RELATIONSHIP_OVERLAP", df, df, source_column="id", target_column="id").first().matched_distinct_count == 1
    with pytest.raises(KeyError):
        I.run_method("FREE_SQL", df)
    with pytest.raises(ValueError):
        I.run_method("COLUMN_PROFILE", df, column="id", family="NUMERIC", sql="x")


def test_ingest_replaces_only_its_snapshots_and_publishes_last(spark, tmp_path):
    root = str(tmp_path / "store")
    spec = "snapshot_id string, relation_name string"
    snap = lambda s, i: spark.createDataFrame([(s, i, "2024-01-01")], "source_id string, snapshot_id string, analyzed_at string")
    one = {"catalog_relations": spark.createDataFrame([("s1", "a"), ("s1", "b")], spec)}
    other = {"catalog_relations": spark.createDataFrame([("z1", "q")], spec)}
    K.ingest(one, snap("src", "s1"), root)
    K.ingest(other, snap("zrc", "z1"), root)
    K.ingest(one, snap("src", "s1"), root)
    assert rows(K.active_table(spark, root, "catalog_relations").select("snapshot_id", "relation_name")) == [("s1", "a"), ("s1", "b"), ("z1", "q")]
    two = {"catalog_relations": spark.createDataFrame([("s2", "c")], spec)}
    two["catalog_relations"].write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").parquet(root + "/catalog_relations")  # a run that died before publishing
    assert rows(K.active_table(spark, root, "catalog_relations").select("relation_name")) == [("a",), ("b",), ("q",)]
    K.ingest(two, snap("src", "s2"), root)
    assert rows(K.active_table(spark, root, "catalog_relations").select("relation_name")) == [("c",), ("q",)]
    assert K.readback(spark, two, root).first().matches
    changed = {"catalog_relations": spark.createDataFrame([("s2", "d")], spec)}
    assert not K.readback(spark, changed, root).first().matches


def test_structure_map_and_report(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "k string, n long")
    K.write_structure_map(df, df, df, str(tmp_path / "map"))
    assert spark.read.json(str(tmp_path / "map/inventory")).count() == 1
    K.write_report(df, df, str(tmp_path / "rep"))
    assert spark.read.json(str(tmp_path / "rep/report")).first().candidate_rows == 1
    K.write_projection(spark.createDataFrame([("s", "relations")], "snapshot_id string, category string"),
                       spark.createDataFrame([("s", "t", "TABLE", "c", "int", 1, True)], "schema_name string, relation_name string, relation_kind string, column_name string, data_type string, ordinal_position int, is_nullable boolean"),
                       "r", str(tmp_path / "proj"))
    assert spark.read.parquet(str(tmp_path / "proj/bi_analysis_summary")).first().relation_count == 1


# --- streams over several micro-batches -------------------------------------------------------------------------
LOG = [("a", 1, "SUCCEEDED", "x"), ("a", 2, "FAILED", "x"), ("b", 1, "FAILED", "q"), ("a", 3, "SUCCEEDED", "x"), ("a", 4, "SUCCEEDED", "y"), ("b", 2, "SUCCEEDED", "q"), ("a", 5, "PARTIAL", "z"), ("b", 3, "SUCCEEDED", "q")]
SPEC = "source_id string, seq long, outcome_state string, result_sha256 string"


def landed_stream(spark, path, spec, records, per_batch=2):
    for i in range(0, len(records), per_batch):
        spark.createDataFrame(records[i:i + per_batch], spec).coalesce(1).write.mode("append").json(path)
        import time
        time.sleep(1.1)  # file age orders the micro-batches
    return spark.readStream.schema(spec).option("maxFilesPerTrigger", 1).json(path)


def test_stream_drift_equals_batch_twin(spark, tmp_path):
    S.use_rocksdb(spark)
    st = landed_stream(spark, str(tmp_path / "in"), SPEC, LOG)
    got = S.run_to_table(S.run_drift_stream(st), str(tmp_path / "out"), str(tmp_path / "cp")).select("source_id", "seq", "drift_state", "compared_to_seq")
    want = batch.run_drift(spark.createDataFrame(LOG, SPEC), ["source_id"]).select("source_id", "seq", "drift_state", "compared_to_seq")
    assert rows(got) == rows(want)
    S.follow_runs(st, str(tmp_path / "f_out"), str(tmp_path / "f_state"), str(tmp_path / "f_cp")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "f_out")).select("source_id", "seq", "drift_state", "compared_to_seq")) == rows(want)


def test_stream_reports_sequence_regressions(spark, tmp_path):
    S.use_rocksdb(spark)
    st = landed_stream(spark, str(tmp_path / "in"), SPEC, [("a", 5, "SUCCEEDED", "x"), ("a", 4, "SUCCEEDED", "y")], 1)
    got = S.run_to_table(S.run_drift_stream(st), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert rows(got.select("seq", "event", "drift_state")) == [(4, "SEQUENCE_REGRESSION", None), (5, "RUN", "BASELINE")]


def test_stream_stale_alert(spark, tmp_path):
    import time
    S.use_rocksdb(spark)
    path = str(tmp_path / "in")
    spark.createDataFrame([("a", 1, "SUCCEEDED", "x")], SPEC).coalesce(1).write.json(path)
    st = spark.readStream.schema(SPEC).json(path)
    q = S.run_drift_stream(st, max_age_ms=500).writeStream.format("memory").queryName("stale_alerts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(60):
            time.sleep(1)
            if spark.sql("select count(*) c from stale_alerts where event = 'STALE_ALERT'").first().c:
                break
        assert spark.sql("select * from stale_alerts where event = 'STALE_ALERT'").first().source_id == "a"
    finally:
        q.stop()


def test_stream_journal_versions(spark, tmp_path):
    S.use_rocksdb(spark)
    spec = "context_digest string, seq long, event_type string, expected_version long"
    ev = [("c", 1, "initialized", None), ("c", 2, "dispatch_response_lost", 0), ("c", 3, "dispatch_response_lost", 1), ("c", 4, "initialized", None), ("c", 5, "reconcile_diverged", 2), ("c", 6, "manual_review_opened", None)]
    got = S.run_to_table(S.journal_stream(landed_stream(spark, str(tmp_path / "in"), spec, ev)), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert [(r.seq, r.verdict, r.to_state) for r in got.orderBy("seq").collect()] == [
        (1, "ACCEPTED", "not_dispatched"), (2, "STALE_VERSION", None), (3, "ACCEPTED", "outcome_unknown"), (4, "ILLEGAL_TRANSITION", None), (5, "ACCEPTED", "diverged"), (6, "ACCEPTED", "manual_review")]


def test_stream_intake_equals_batch_twin(spark, tmp_path):
    S.use_rocksdb(spark)
    spec = "idempotency_key string, request_id long, request_digest string, ts timestamp"
    import datetime as dt
    t = lambda i: dt.datetime(2024, 1, 1, 0, i)
    ev = [("k", 1, "d1", t(1)), ("k", 2, "d1", t(2)), ("k", 3, "d2", t(3)), ("m", 4, "d9", t(4))]
    got = S.run_to_table(S.intake_stream(landed_stream(spark, str(tmp_path / "in"), spec, ev)), str(tmp_path / "out"), str(tmp_path / "cp"))
    want = S.intake_batch(spark.createDataFrame(ev, spec))
    assert rows(got) == rows(want) == [("k", 1, "APPLIED"), ("k", 2, "ALREADY_APPLIED"), ("k", 3, "CONFLICT"), ("m", 4, "APPLIED")]


def test_fact_load(spark):
    f = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("a", 3.0)], "truth_key string, metric_value double")
    d = spark.createDataFrame([("a", "p1")], "truth_key string, product string")
    got = K.load_fact(f, d)
    assert got.count() == 3 and got.filter(F.col("product").isNull()).count() == 1
    assert tuple(K.fact_check(got).first()) == (3, 2)
