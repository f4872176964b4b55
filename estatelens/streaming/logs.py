"""Append-only logs as streams (T1-T5). Each has a batch twin that gives the same rows on a closed log.

T1 to T4 run DataFrame operators on each micro-batch and keep one small row per key in a state table (``state``): a log that
holds a third of all rows is scanned in blocks by many tasks, and only keys that a batch touches are written. T5's alert
needs a clock of its own and so a timer per source (``processors``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scans import blocked_last
from ..operators.journal import EVENTS_PER_BLOCK, judge_events, states_after
from ..operators.journal import OUT as JOURNAL_OUT
from ..operators.logs import seq_block
from .processors import intake_stream, journal_stream, run_drift_stream  # noqa: F401
from .state import KeyedState, follow

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DRIFT_OUT = "source_id string, seq long, event string, drift_state string, compared_to_seq long, outcome_state string, result_sha256 string"
DRIFT_STATE = "source_id string, last_seq long, good_seq long, good_sha string"
INTAKE_OUT = "idempotency_key string, request_id long, verdict string, request_digest string, ts timestamp"
INTAKE_STATE = "idempotency_key string, first_id long, first_digest string, first_ts timestamp"
JOURNAL_STATE = "context_digest string, state string, version long"


def use_rocksdb(spark: SparkSession) -> None:
    """Stateful processors need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


# --- T1: drift of each receipt against the last known good --------------------------------------------------------


def drift_batch(receipts: DataFrame, known: DataFrame) -> DataFrame:
    """T1 for one micro-batch: DRIFT_OUT rows.

    known: DRIFT_STATE of the sources that are under way. A receipt numbered at or below the highest number of an earlier
    batch, and all but one of equal numbers within a batch, is a SEQUENCE_REGRESSION and compared to nothing; the others
    are RUN events. Ties go by outcome, then hash. Null numbers are regressions.
    """
    twice = Window.partitionBy("source_id", "seq").orderBy("outcome_state", "result_sha256")
    r = receipts.select("source_id", "seq", "outcome_state", "result_sha256").join(known, "source_id", "left").withColumn("_nth", F.row_number().over(twice))
    on = F.col("seq").isNotNull() & (F.col("_nth") == 1) & (F.col("last_seq").isNull() | (F.col("seq") > F.col("last_seq")))
    r = r.withColumn("event", F.when(on, "RUN").otherwise("SEQUENCE_REGRESSION"))
    ok = F.col("outcome_state") == "SUCCEEDED"
    run = F.col("event") == "RUN"
    good = F.when(ok, F.struct(F.col("seq").alias("g_seq"), F.col("result_sha256").alias("g_hash")))
    runs = blocked_last(r.where(run), ["source_id"], "seq", seq_block(), good, "_carried")
    last = F.coalesce("_carried", F.when(F.col("good_seq").isNotNull(), F.struct(F.col("good_seq").alias("g_seq"), F.col("good_sha").alias("g_hash"))))
    runs = runs.withColumn("_good", last)
    drift = F.when(~F.coalesce(ok, F.lit(False)), "NOT_COMPARABLE").when(F.col("_good").isNull(), "BASELINE").when(F.col("_good.g_hash") == F.col("result_sha256"), "UNCHANGED").otherwise("CHANGED")
    names = [f.split()[0] for f in DRIFT_OUT.split(", ")]
    runs = runs.withColumn("drift_state", drift).withColumn("compared_to_seq", F.when(ok, F.col("_good.g_seq"))).select(*names)
    late = r.where(~run).select("source_id", "seq", "event", F.lit(None).cast("string").alias("drift_state"), F.lit(None).cast("long").alias("compared_to_seq"), "outcome_state", "result_sha256")
    return runs.unionByName(late)


def drift_state(judged: DataFrame, known: DataFrame) -> DataFrame:
    """DRIFT_STATE of the sources that judged rows touch."""
    run, good = F.col("event") == "RUN", (F.col("event") == "RUN") & (F.col("outcome_state") == "SUCCEEDED")
    new = judged.groupBy("source_id").agg(F.max(F.when(run, F.col("seq"))).alias("_last"), F.max(F.when(good, F.col("seq"))).alias("_seq"), F.max_by("result_sha256", F.when(good, F.col("seq"))).alias("_sha"))
    return new.join(known, "source_id", "left").select(
        "source_id", F.coalesce("_last", "last_seq").alias("last_seq"), F.coalesce("_seq", "good_seq").alias("good_seq"), F.when(F.col("_seq").isNotNull(), F.col("_sha")).otherwise(F.col("good_sha")).alias("good_sha"))


def follow_runs(receipts: DataFrame, out_path: str, state_path: str, checkpoint: str, fold: int = 16):
    """T1 as a stream: (source_id string, seq long, outcome_state, result_sha256) to DRIFT_OUT rows below out_path."""
    state = KeyedState(state_path, DRIFT_STATE, ["source_id"], fold)

    def one(batch: DataFrame, n: int):
        spark = batch.sparkSession
        drift_batch(batch, state.touched(batch, n)).write.mode("overwrite").parquet(f"{out_path}/batch={n}")
        judged = spark.read.schema(DRIFT_OUT).parquet(f"{out_path}/batch={n}")
        state.write(drift_state(judged, state.touched(judged, n)), n)

    return follow(receipts, one, checkpoint)


# --- T2: idempotent intake ----------------------------------------------------------------------------------------


def intake_judged(requests: DataFrame, known: DataFrame) -> DataFrame:
    """T2 for one micro-batch: INTAKE_OUT rows. known: INTAKE_STATE of the keys whose first request still counts.

    The first request of a key, by time and then id, is APPLIED; the same digest again is ALREADY_APPLIED, another a
    CONFLICT. The first one comes from a combinable aggregate, so a hot key sends one row per task. Of rows equal
    in time, id and digest one is the first.
    """
    at = F.struct("ts", "request_id", "request_digest")
    first = requests.groupBy("idempotency_key").agg(F.min(at).alias("_f"))
    copies = Window.partitionBy("idempotency_key", "ts", "request_id", "request_digest").orderBy(F.lit(0))
    j = requests.withColumn("_nth", F.row_number().over(copies)).join(first.join(known, "idempotency_key", "left"), "idempotency_key")
    fresh = F.col("first_ts").isNull() & at.eqNullSafe(F.col("_f")) & (F.col("_nth") == 1)
    digest = F.when(F.col("first_ts").isNull(), F.col("_f.request_digest")).otherwise(F.col("first_digest"))
    verdict = F.when(fresh, "APPLIED").when(F.col("request_digest").eqNullSafe(digest), "ALREADY_APPLIED").otherwise("CONFLICT")
    return j.select("idempotency_key", "request_id", verdict.alias("verdict"), "request_digest", "ts")


def follow_intake(requests: DataFrame, out_path: str, state_path: str, checkpoint: str, keep_seconds: int | None = None, fold: int = 16):
    """T2 as a stream: (idempotency_key string, request_id long, request_digest string, ts timestamp) to INTAKE_OUT rows.

    With ``keep_seconds`` a first request stops counting once it is older than that before the newest time of all
    earlier batches; the key's next request is then applied anew, and the state table lets the key go when it folds.
    """
    state = KeyedState(state_path, INTAKE_STATE, ["idempotency_key"], fold)
    clock = KeyedState(state_path + "_clock", "k long, newest timestamp", ["k"], fold)

    def one(batch: DataFrame, n: int):
        spark = batch.sparkSession
        now = clock.before(spark, n).select(F.max("newest")).first()[0]
        live = None if keep_seconds is None or now is None else F.col("first_ts") >= F.lit(now) - F.expr(f"INTERVAL {int(keep_seconds)} SECONDS")
        intake_judged(batch, state.touched(batch, n, live)).write.mode("overwrite").parquet(f"{out_path}/batch={n}")
        judged = spark.read.schema(INTAKE_OUT).parquet(f"{out_path}/batch={n}")
        new = judged.where("verdict = 'APPLIED'").select("idempotency_key", F.col("request_id").alias("first_id"), F.col("request_digest").alias("first_digest"), F.col("ts").alias("first_ts"))
        state.write(new, n, live)
        clock.write(judged.agg(F.max("ts").alias("newest")).select(F.lit(0).cast("long").alias("k"), F.greatest("newest", F.lit(now).cast("timestamp")).alias("newest")), n)

    return follow(requests, one, checkpoint)


# --- T3 and T4: outcome journal -----------------------------------------------------------------------------------


def follow_journal(events: DataFrame, out_path: str, state_path: str, checkpoint: str, block: int = EVENTS_PER_BLOCK, fold: int = 16):
    """T3/T4 as a stream: (context_digest string, seq long, event_type, expected_version long or null) to verdicts.

    Events of a batch are judged in order of seq from the state that earlier batches left, see ``judge_events``.
    """
    state = KeyedState(state_path, JOURNAL_STATE, ["context_digest"], fold)

    def one(batch: DataFrame, n: int):
        spark = batch.sparkSession
        judge_events(batch, state.touched(batch, n), block).write.mode("overwrite").parquet(f"{out_path}/batch={n}")
        judged = spark.read.schema(JOURNAL_OUT).parquet(f"{out_path}/batch={n}")
        state.write(states_after(judged, state.touched(judged, n)), n)

    return follow(events, one, checkpoint)


def applied_once(requests: DataFrame, delay: str = "1 hour") -> DataFrame:
    """T2, applied rows only: one per key within the watermark, with bounded state and no Python."""
    return requests.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["idempotency_key"])


def intake_batch(requests: DataFrame) -> DataFrame:
    """Twin of T2: the first request per key by a combinable aggregate, then one join."""
    at = F.struct("ts", "request_id")
    first = requests.groupBy("idempotency_key").agg(F.min(at).alias("f"), F.min_by("request_digest", at).alias("d"))
    j = requests.join(first, "idempotency_key")
    v = F.when(F.col("request_id") == F.col("f.request_id"), "APPLIED").when(F.col("request_digest") == F.col("d"), "ALREADY_APPLIED").otherwise("CONFLICT")
    return j.select("idempotency_key", "request_id", v.alias("verdict"))


def stale_sources(receipts: DataFrame, now, max_age_seconds: int) -> DataFrame:
    """Twin of T5: sources whose newest receipt is older than the maximum age."""
    g = receipts.groupBy("source_id").agg(F.max("recorded_at").alias("last_recorded_at"))
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("last_recorded_at").cast("timestamp"))
    return g.withColumn("age_seconds", age).filter(F.col("age_seconds") > max_age_seconds)


def run_to_table(stream: DataFrame, out_path: str, checkpoint: str) -> DataFrame:
    """Drive a stream over what has landed so far into Parquet, and read it back."""
    schema = stream.schema
    q = stream.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(schema).parquet(out_path)
