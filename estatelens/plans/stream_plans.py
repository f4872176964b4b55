"""Streams over the events table; each oracle is the batch meaning of the log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import shared_folder
from ..streaming import logs as S
from .base import Registry, load

R = Registry()


BATCHES = 4
# which micro-batch brings an event: quarters of the log by number, and every 11th event a quarter late
_BATCH = f"LEAST(CAST(FLOOR(event_id * {BATCHES} / (hi + 1)) AS BIGINT) + CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END, {BATCHES - 1})"
_ARRIVALS = f"(SELECT *, {_BATCH} AS b FROM events, (SELECT max(event_id) AS hi FROM events))"


def _stream(spark, sf):
    """The events table as a stream of several micro-batches: one file each, landed one after the other."""
    e = load(spark, sf, "events")
    base = shared_folder(spark)
    parts = e.join(e.agg(F.max("event_id").alias("hi"))).withColumn("_b", F.expr(_BATCH)).drop("hi")
    for b in range(BATCHES):
        parts.where(F.col("_b") == b).drop("_b").coalesce(1).write.mode("append").parquet(base + "/in")
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(base + "/in")


def _whole(spark, sf):
    """The events table as one micro-batch."""
    return spark.readStream.schema(load(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def _run(spark, stream):
    base = shared_folder(spark)
    return S.run_to_table(stream, base + "/out", base + "/checkpoint")


def _follow(spark, follow, stream, schema, *cols, **options):
    base = shared_folder(spark)
    follow(stream, base + "/out", base + "/state", base + "/checkpoint", **options).awaitTermination()
    return spark.read.schema(schema).parquet(base + "/out").select(*cols)


_OUT = "CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'view' THEN 'PARTIAL' ELSE 'SUCCEEDED' END"
_RES = "CAST(CAST(FLOOR(value / 20) AS BIGINT) AS STRING)"
_DRIFT = f"""WITH a AS (SELECT CAST(user_id AS VARCHAR) AS source_id, event_id AS seq, b, {_OUT} AS o, {_RES} AS h FROM {_ARRIVALS}),
  top AS (SELECT source_id, b, max(seq) AS m FROM a GROUP BY ALL), before AS (SELECT x.source_id, x.b, max(y.m) AS m FROM top x JOIN top y ON x.source_id = y.source_id AND y.b < x.b GROUP BY ALL),
  r AS (SELECT a.*, coalesce(seq <= m, false) AS late FROM a LEFT JOIN before USING (source_id, b)),
  g AS (SELECT *, last_value(CASE WHEN o = 'SUCCEEDED' AND NOT late THEN seq END IGNORE NULLS) OVER w AS gs, last_value(CASE WHEN o = 'SUCCEEDED' AND NOT late THEN h END IGNORE NULLS) OVER w AS gh FROM r
    WINDOW w AS (PARTITION BY source_id ORDER BY b, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT source_id, seq, CASE WHEN late THEN 'SEQUENCE_REGRESSION' ELSE 'RUN' END AS event, CASE WHEN late THEN NULL WHEN o <> 'SUCCEEDED' THEN 'NOT_COMPARABLE' WHEN gs IS NULL THEN 'BASELINE'
    WHEN gh = h THEN 'UNCHANGED' ELSE 'CHANGED' END AS drift_state, CASE WHEN o = 'SUCCEEDED' AND NOT late THEN gs END AS compared_to_seq FROM g"""


def _receipts(df):
    return df.select(F.col("user_id").cast("string").alias("source_id"), F.col("event_id").alias("seq"), F.expr(_OUT).alias("outcome_state"), F.expr(_RES).alias("result_sha256"))


@R.add("stream_run_drift", _DRIFT)
def stream_run_drift(spark, sf):
    """Row-level processors over the same micro-batches."""
    S.use_rocksdb(spark)
    return _run(spark, S.run_drift_stream(_receipts(_stream(spark, sf))))


@R.add("stream_follow_runs", _DRIFT)
def stream_follow_runs(spark, sf):
    return _follow(spark, S.follow_runs, _receipts(_stream(spark, sf)), S.DRIFT_OUT, "source_id", "seq", "event", "drift_state", "compared_to_seq")


@R.add("stream_follow_runs_hot", _DRIFT.replace("CAST(user_id AS VARCHAR) AS source_id", "CASE WHEN user_id % 3 > 0 THEN 'hot' ELSE CAST(user_id AS VARCHAR) END AS source_id"))
def stream_follow_runs_hot(spark, sf):
    """Two thirds of all receipts in one source, and the state folded at every second batch."""
    r = _receipts(_stream(spark, sf)).withColumn("source_id", F.expr("CASE WHEN CAST(source_id AS BIGINT) % 3 > 0 THEN 'hot' ELSE source_id END"))
    return _follow(spark, S.follow_runs, r, S.DRIFT_OUT, "source_id", "seq", "event", "drift_state", "compared_to_seq", fold=2)


_INTAKE = """SELECT idempotency_key, event_id AS request_id, CASE WHEN event_id = f THEN 'APPLIED' WHEN d = fd THEN 'ALREADY_APPLIED' ELSE 'CONFLICT' END AS verdict FROM (
  SELECT props AS idempotency_key, event_id, event_type AS d, first_value(event_id) OVER w AS f, first_value(event_type) OVER w AS fd FROM events WINDOW w AS (PARTITION BY props ORDER BY ts, event_id))"""


def _requests(df):
    return df.select(F.col("props").alias("idempotency_key"), F.col("event_id").alias("request_id"), F.col("event_type").alias("request_digest"), F.col("ts").cast("timestamp").alias("ts"))


_KEEP = 10 * 86_400
_FIRSTS = f"""a AS (SELECT props AS k, event_id AS id, event_type AS d, ts, b FROM {_ARRIVALS}), clock AS (SELECT b, max(max(ts)) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS now FROM a GROUP BY b),
  f AS (SELECT k, b, min(ts) AS ts, arg_min(id, (ts, id)) AS id, arg_min(d, (ts, id)) AS d FROM a GROUP BY k, b),
  s(k, b, ts, id, d) AS (SELECT DISTINCT k, CAST(-1 AS BIGINT), CAST(NULL AS TIMESTAMP), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR) FROM a
   UNION ALL SELECT s.k, s.b + 1, CASE WHEN live THEN s.ts ELSE f.ts END, CASE WHEN live THEN s.id ELSE f.id END, CASE WHEN live THEN s.d ELSE f.d END
   FROM (SELECT s.*, coalesce(s.ts >= now - INTERVAL {_KEEP} SECONDS, s.ts IS NOT NULL) AS live FROM s JOIN clock ON clock.b = s.b + 1) s LEFT JOIN f ON f.k = s.k AND f.b = s.b + 1)"""


@R.add("stream_intake", f"""WITH RECURSIVE {_FIRSTS} SELECT a.k AS idempotency_key, a.id AS request_id, CASE WHEN a.id = s.id THEN 'APPLIED' WHEN a.d = s.d THEN 'ALREADY_APPLIED' ELSE 'CONFLICT' END AS verdict
  FROM a JOIN s ON s.k = a.k AND s.b = a.b""")
def stream_intake(spark, sf):
    """First requests count for ten days; the state folds at every second batch."""
    return _follow(spark, S.follow_intake, _requests(_stream(spark, sf)), S.INTAKE_OUT, "idempotency_key", "request_id", "verdict", keep_seconds=_KEEP, fold=2)


@R.add("intake_verdicts", _INTAKE)
def intake_verdicts(spark, sf):
    return S.intake_batch(_requests(load(spark, sf, "events")))


@R.add("stream_applied_once", "SELECT DISTINCT props AS idempotency_key FROM events")
def stream_applied_once(spark, sf):
    return _run(spark, S.applied_once(_requests(_whole(spark, sf)), "60 days").select("idempotency_key"))


_JE = "CASE event_type WHEN 'view' THEN 'initialized' WHEN 'click' THEN 'dispatch_response_lost' WHEN 'signup' THEN 'reconcile_exact_before' WHEN 'purchase' THEN 'fresh_retry_authorized' ELSE 'reconcile_diverged' END"
_JV = "CASE WHEN value > 50 THEN CAST(-1 AS BIGINT) WHEN value < 1 THEN CAST(0 AS BIGINT) END"


@R.add("stream_journal", f"""WITH RECURSIVE t(f, e, g) AS (VALUES ('__start__', 'initialized', 'not_dispatched'), ('not_dispatched', 'dispatch_response_lost', 'outcome_unknown'), ('outcome_unknown', 'reconcile_exact_before', 'unchanged_safe_to_retry'),
   ('outcome_unknown', 'reconcile_diverged', 'diverged'), ('unchanged_safe_to_retry', 'fresh_retry_authorized', 'not_dispatched')),
  j AS (SELECT CAST(user_id AS VARCHAR) AS c, event_id AS seq, {_JE} AS e, {_JV} AS v, row_number() OVER (PARTITION BY user_id ORDER BY b, event_id) AS k FROM {_ARRIVALS}),
  w AS (SELECT DISTINCT c, CAST(0 AS BIGINT) AS seq, '' AS e, '' AS verdict, '__start__' AS state, CAST(0 AS BIGINT) AS version, CAST(0 AS BIGINT) AS k FROM j
   UNION ALL SELECT j.c, j.seq, j.e, CASE WHEN j.v IS NOT NULL AND j.v <> w.version THEN 'STALE_VERSION' WHEN t.g IS NULL THEN 'ILLEGAL_TRANSITION' ELSE 'ACCEPTED' END,
     CASE WHEN (j.v IS NULL OR j.v = w.version) AND t.g IS NOT NULL THEN t.g ELSE w.state END, w.version + CASE WHEN (j.v IS NULL OR j.v = w.version) AND t.g IS NOT NULL THEN 1 ELSE 0 END, j.k
   FROM w JOIN j ON j.c = w.c AND j.k = w.k + 1 LEFT JOIN t ON t.f = w.state AND t.e = j.e)
  SELECT c AS context_digest, seq, e AS event_type, verdict, CASE WHEN verdict = 'ACCEPTED' THEN state END AS to_state FROM w WHERE k > 0""")
def stream_journal(spark, sf):
    """Blocks of 512 event numbers, so that contexts have several blocks in a batch."""
    e = _stream(spark, sf).select(F.col("user_id").cast("string").alias("context_digest"), F.col("event_id").alias("seq"), F.expr(_JE).alias("event_type"), F.expr(_JV).alias("expected_version"))
    return _follow(spark, S.follow_journal, e, S.JOURNAL_OUT, "context_digest", "seq", "event_type", "verdict", "to_state", block=512, fold=2)


@R.add("stale_sources", "SELECT CAST(user_id AS VARCHAR) AS source_id, max(ts) AS last_recorded_at, CAST(floor(epoch(TIMESTAMP '2024-01-31') ) AS BIGINT) - CAST(floor(epoch(max(ts))) AS BIGINT) AS age_seconds FROM events GROUP BY 1 HAVING CAST(floor(epoch(TIMESTAMP '2024-01-31')) AS BIGINT) - CAST(floor(epoch(max(ts))) AS BIGINT) > 40000")
def stale_sources(spark, sf):
    e = load(spark, sf, "events").select(F.col("user_id").cast("string").alias("source_id"), F.col("ts").alias("recorded_at"))
    return S.stale_sources(e, "2024-01-31 00:00:00", 40_000)
