"""Entry points end to end on small business tables with planted facts."""

from pyspark.sql import functions as F

from estatelens.plans import workflows as W
from estatelens.sources import extracts as X
from estatelens.sources import sinks as K
from tests.test_sources import ORA


def shop(spark):
    customer = spark.createDataFrame([(1, "C-1", "a@x", "north"), (2, "C-2", None, "south"), (3, "C-2", "c@x", "east")], "id long, customer_number string, email string, region string")
    orders = spark.createDataFrame([(i, 1 + i % 3, 100.0 + i if i < 19 else -5.0, 3 + i % 2) for i in range(20)] + [(20, 99, 9000.0, 4)], "id long, customer_id long, amount double, delivery_delay int")
    return {"customers": customer, "sales_orders": orders}


def test_discovery_finds_planted_facts(spark):
    t = shop(spark)
    got = W.discover(spark, t, "customer order amount quality", {"customers": "id", "sales_orders": "id"}, [("sales_orders", "customer_id", "customers", "id")])
    assert {(r.from_table, r.from_column, r.to_table, r.kind) for r in got["links"].collect()} == {("sales_orders", "customer_id", "customers", "declared_foreign_key")}
    assert {(r.anomaly_type, r.table_name, r.column_name) for r in got["anomalies"].collect()} == {
        ("missing_values", "customers", "email"), ("duplicate_values", "customers", "customer_number"), ("negative_values", "sales_orders", "amount"),
        ("extreme_values", "sales_orders", "amount"), ("orphan_relationship", None, None), ("extreme_values", "sales_orders", "customer_id")}
    assert got["causes"].count() == 6 and not got["link_tests"].first().passed
    assert {r.expression for r in got["semantic_model"].filter("element = 'kpi'").collect()} == {"SUM(amount)", "AVG(delivery_delay)"}
    assert {r.table_name: r.score for r in got["priorities"].collect()} == {"customers": 4, "sales_orders": 5}


def test_undeclared_link_is_inferred(spark):
    t = shop(spark)
    got = W.discover(spark, t, "any", {"customers": "id"})
    assert [(r.from_column, r.to_table) for r in got["links"].collect()] == [("customer_id", "customers")]


def test_profile_and_relate(spark):
    accounts = spark.createDataFrame([(i, f"r{i}") for i in range(10)], "account_id long, region_code string")
    staging = spark.createDataFrame([(i, i % 10) for i in range(30)], "event_id long, account_id long")
    con = spark.createDataFrame([("main", "accounts", "pk", "PRIMARY_KEY", "account_id", None, None, None)],
                                "schema_name string, relation_name string, constraint_name string, constraint_kind string, column_name string, referenced_schema_name string, referenced_relation_name string, referenced_column_name string")
    got = W.profile_and_relate({"accounts": accounts, "staging_events": staging}, con, [("accounts", "account_id"), ("staging_events", "account_id"), ("staging_events", "event_id")])
    o = got["overlaps"].collect()
    assert [(r.source_id, r.target_id, r.overlap_bps, r.confidence, r.status) for r in o] == [("staging_events.account_id", "accounts.account_id", 10000, "HIGH", "PROPOSAL_ONLY")]
    assert got["summary"].first().plan_steps == 4 and got["steps"].count() == 4
    c = W.cluster_snapshot(spark.createDataFrame([("accounts",), ("staging_events",), ("alone",)], "node string"), got["overlaps"])
    assert {(r.component, r.member_count, r.lower_bps, r.upper_bps) for r in c["clusters"].collect()} == {("accounts", 2, 4500, 7500), ("alone", 1, 3000, 6000)}


def test_analyze_survives_denied_collectors(spark, tmp_path):
    objects = spark.createDataFrame([("HR", "T", "TABLE", 1, "VALID", None, None, "N"), ("HR", "V", "VIEW", 2, "VALID", None, None, "N")],
                                    "owner string, object_name string, object_type string, object_id long, status string, created timestamp, last_ddl_time timestamp, temporary string")
    synonyms = spark.createDataFrame([("HR", "S", "HR", "T", None)], "owner string, synonym_name string, table_owner string, table_name string, db_link string")

    def reader(_, options):
        for name, df in (("all_objects", objects), ("all_synonyms", synonyms)):
            if f"FROM {name} " in options["query"] + " ":
                return df
        raise RuntimeError("ORA-01031: insufficient privileges")

    led = W.analyze(spark, ORA, str(tmp_path / "land"), str(tmp_path / "store"), "snap1", "2024-01-01", reader).first()
    assert led.total_queries == 23 and led.complete_queries == 3 and led.denied_count == 20 and not led.all_complete
    rel = K.active_table(spark, str(tmp_path / "store"), "oracle_structure_relations")
    assert {r.relation_name for r in rel.collect()} == {"T", "V"}
    cov = K.active_table(spark, str(tmp_path / "store"), "catalog_extracts").filter(F.col("query_id") == "oracle.stored.errors").first()
    assert (cov.state, cov.visibility, cov.empty_interpretation) == ("DENIED", "INVISIBLE", "NOT_CLAIMED")
    assert isinstance(ORA, X.Source)
