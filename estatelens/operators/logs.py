"""Append-only logs in batch: chains, last-known-good, retention, folds, journals, retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import JOURNAL_START, JOURNAL_TRANSITIONS
from ..functions.scalars import c, flags, int_div
from ..functions.scans import blocked_last, blocked_sums, with_previous

BLOCK = 65_536  # entries of one log scanned together


def seq_block(seq="seq") -> Column:
    return int_div(c(seq), F.lit(BLOCK))


def genesis(keys: list[str]) -> Column:
    return F.sha2(F.concat_ws("|", F.lit("genesis"), *[F.col(k).cast("string") for k in keys]), 256)


def verify_chain(log: DataFrame, keys: list[str], seq: str = "seq", entry: str = "entry_hash", previous: str = "previous_hash",
                 first_is_genesis: bool = True) -> DataFrame:
    """W2. Entries whose previous hash is not the hash of entry seq-1, and entries with no entry seq-1.

    The neighbour is found by equi-join on (log, seq), so one long log is spread over the cluster.
    """
    j = with_previous(log, keys, seq, [entry])
    want = F.when(F.col(seq) == 1, genesis(keys) if first_is_genesis else F.lit(None).cast("string")).otherwise(F.col("prev_" + entry))
    v = (F.when((F.col(seq) > 1) & F.col("prev_" + entry).isNull(), "SEQUENCE_GAP")
         .when(~F.col(previous).eqNullSafe(want), "CHAIN_BROKEN"))
    return j.withColumn("violation", v).filter("violation is not null").select(*keys, seq, "violation")


def duplicate_sequences(log: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    return log.groupBy(*keys, seq).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def run_drift(log: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """W3. Drift of each run against the last known good before it.

    log: keys, seq, outcome_state, result_sha256. Logs are scanned in blocks of sequence numbers.
    """
    ok = F.col("outcome_state") == "SUCCEEDED"
    good = F.when(ok, F.struct(F.col(seq).alias("g_seq"), F.col("result_sha256").alias("g_hash")))
    j = blocked_last(log, keys, seq, seq_block(seq), good, "_good")
    state = (F.when(~ok, "NOT_COMPARABLE").when(F.col("_good").isNull(), "BASELINE")
             .when(F.col("_good.g_hash") == F.col("result_sha256"), "UNCHANGED").otherwise("CHANGED"))
    return j.withColumn("drift_state", state).withColumn(
        "compared_to_seq", F.when(ok, F.col("_good.g_seq"))).withColumn("previous_result_sha256", F.when(ok, F.col("_good.g_hash"))).drop("_good")


def retained(log: DataFrame, keys: list[str], n: int = 20, seq: str = "seq") -> DataFrame:
    """W4. Newest ``n`` entries per log; a last known good older than those takes the place of the oldest.

    Both rank filters are pruned map-side by Spark before the shuffle, so a long log ships n rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(seq).desc())
    newest = log.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    good = log.filter("outcome_state = 'SUCCEEDED'").withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    old = good.join(newest.select(*keys, seq), [*keys, seq], "left_anti").withColumn("_rn", F.lit(0))
    displaced = old.select(*keys, F.lit(True).alias("_old"))
    return newest.join(displaced, keys, "left").filter(~((F.col("_rn") == n) & F.col("_old").isNotNull())).drop("_old").unionByName(old).drop("_rn")


def history_summary(log: DataFrame, keys: list[str], n: int = 20, seq: str = "seq") -> DataFrame:
    """A31. Per source: totals, retained, pruned, latest outcome and drift, last known good, resumable count.

    log carries drift_state (W3) and resumable. Everything is a combinable aggregate.
    """
    good = F.when(F.col("outcome_state") == "SUCCEEDED", F.col(seq))
    g = log.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_entries"), F.max_by("outcome_state", seq).alias("latest_outcome_state"), F.max_by("drift_state", seq).alias("latest_drift_state"),
        F.max(good).alias("last_known_good_seq"), F.count_if("resumable").alias("resumable_count"))
    return g.withColumn("retained_entries", F.least(F.col("total_entries"), F.lit(n).cast("long"))).withColumn(
        "pruned_entries", F.col("total_entries") - F.col("retained_entries"))


def outcome_violations(events: DataFrame) -> DataFrame:
    """W5 input rules: what a result state allows its signal and gain to be."""
    s, g, k = F.col("result_state"), F.col("signal"), F.col("information_gain_bps")
    dark = s.isin("UNKNOWN", "TIMEOUT", "CANCELLED", "DENIED", "UNSUPPORTED")
    return events.withColumn("violation", F.explode(flags(
        (dark & ((g != "UNKNOWN") | (k != 0)), "SIGNAL_WITHOUT_RESULT"), (s.isin("SUCCEEDED", "PARTIAL") & (g == "UNKNOWN"), "RESULT_WITHOUT_SIGNAL"),
        ((g == "NO_GAIN") & (k != 0), "GAIN_ON_NO_GAIN"), ((k < 0) | (k > 10000), "GAIN_OUT_OF_RANGE"))))


def hypothesis_ledger(events: DataFrame, max_no_gain: int = 2, max_counter: int = 2, key: str = "hypothesis_id", seq: str = "seq") -> DataFrame:
    """W5. Status of each hypothesis after each outcome, with its run of equal signals.

    A run starts where the signal differs from that of entry seq-1; the running start is a blocked scan, so the
    length is seq minus start plus one. UNKNOWN waits for reconciliation, other dark states stop at once.
    """
    p = with_previous(events, [key], seq, ["signal"])
    starts = F.when(~F.col("signal").eqNullSafe(F.col("prev_signal")), F.col(seq))
    j = blocked_last(p, [key], seq, seq_block(seq), starts, "_start", inclusive=True)
    run = F.col(seq) - F.col("_start") + 1
    s, g = F.col("result_state"), F.col("signal")
    dark = s.isin("TIMEOUT", "CANCELLED", "DENIED", "UNSUPPORTED")
    no_gain = F.when(g == "NO_GAIN", run).otherwise(F.lit(0))
    counter = F.when(g == "COUNTERS", run).otherwise(F.lit(0))
    status = (
        F.when(s == "UNKNOWN", "AWAITING_RECONCILIATION").when(dark, "STOPPED").when(g == "SUPPORTS", "SUPPORTED_CANDIDATE")
        .when((g == "COUNTERS") & (counter >= max_counter), "STOPPED").when(g == "COUNTERS", "COUNTEREVIDENCE_CANDIDATE")
        .when((g == "NO_GAIN") & (no_gain >= max_no_gain), "STOPPED").otherwise("OPEN"))
    reason = (
        F.when(s == "UNKNOWN", "UNKNOWN_OUTCOME").when(dark, s).when((g == "COUNTERS") & (counter >= max_counter), "REPEATED_COUNTEREVIDENCE")
        .when((g == "NO_GAIN") & (no_gain >= max_no_gain), "NO_GAIN_LIMIT"))
    dead = s.isin("UNKNOWN", "TIMEOUT", "CANCELLED", "DENIED", "UNSUPPORTED")
    return j.withColumns({
        "consecutive_no_gain": F.when(dead, 0).otherwise(no_gain).cast("long"), "consecutive_counterevidence": F.when(dead, 0).otherwise(counter).cast("long"),
        "status": status, "terminal_reason": reason}).drop("_start", "prev_signal")


def hypothesis_references(events: DataFrame, key: str = "hypothesis_id", seq: str = "seq") -> DataFrame:
    """W5. What a hypothesis rests on: (key, role, ref, first_seq, times), one row per distinct reference.

    events: key, seq, result_state, signal, evidence_refs array<string>, source_receipt. Roles: SUPPORTS and COUNTERS for evidence
    of such signals, RECEIPT for every event's receipt, CONTRADICTION for the receipts of counterevidence. Dark results
    (unknown, timeout, ...) bring a receipt and no evidence. References are rows, so a hypothesis may have any number.
    """
    lit = F.col("result_state").isin("SUCCEEDED", "PARTIAL")
    counters = lit & (F.col("signal") == "COUNTERS")
    pair = lambda role, ref: F.struct(F.lit(role).alias("role"), ref.alias("ref"))
    receipt = F.col("source_receipt")
    refs = F.coalesce(F.when(lit & F.col("signal").isin("SUPPORTS", "COUNTERS"), F.transform(F.col("evidence_refs"), lambda r: F.struct(F.col("signal").alias("role"), r.alias("ref")))), F.array().cast("array<struct<role:string,ref:string>>"))
    rows = F.concat(refs, F.array_compact(F.array(F.when(receipt.isNotNull(), pair("RECEIPT", receipt)), F.when(counters & receipt.isNotNull(), pair("CONTRADICTION", receipt)))))
    each = events.select(key, seq, F.explode(rows).alias("r")).select(key, seq, "r.role", "r.ref").where("ref is not null")
    return each.groupBy(key, "role", "ref").agg(F.min(seq).alias("first_seq"), F.count(F.lit(1)).alias("times"))


def evidence_ledger(events: DataFrame, max_no_gain: int = 2, max_counter: int = 2, key: str = "hypothesis_id", seq: str = "seq") -> DataFrame:
    """W5. ``hypothesis_ledger`` with what each hypothesis rests on after each outcome, up to its first stop.

    Adds supporting_refs, counter_refs and receipts (distinct references so far), contradictions (counterevidence events so
    far) and keeps lower_bps and upper_bps, the bounds that the outcome sets. Nothing follows a stop: later rows are left out.
    A distinct reference counts where it is first seen, so running counts are sums of first sights, scanned in blocks.
    """
    ledger = hypothesis_ledger(events, max_no_gain, max_counter, key, seq)
    stop = ledger.where("status = 'STOPPED'").groupBy(key).agg(F.min(seq).alias("_stop"))
    kept = ledger.join(stop, key, "left").where(F.col("_stop").isNull() | (F.col(seq) <= F.col("_stop"))).drop("_stop")
    first = hypothesis_references(kept, key, seq).groupBy(key, F.col("first_seq").alias(seq)).agg(
        F.count_if(F.col("role") == "SUPPORTS").alias("_s"), F.count_if(F.col("role") == "COUNTERS").alias("_c"), F.count_if(F.col("role") == "RECEIPT").alias("_r"))
    against = F.col("result_state").isin("SUCCEEDED", "PARTIAL") & (F.col("signal") == "COUNTERS")
    j = kept.join(first, [key, seq], "left").withColumns({x: F.coalesce(x, F.lit(0)) for x in ("_s", "_c", "_r")}).withColumn("_x", F.coalesce(against, F.lit(False)).cast("long"))
    out = blocked_sums(j, [key], seq, seq_block(seq), {"_s": "supporting_refs", "_c": "counter_refs", "_r": "receipts", "_x": "contradictions"})
    return out.drop("_s", "_c", "_r", "_x")


def probe_dispositions(requests: DataFrame, receipts: DataFrame, authorized: DataFrame) -> DataFrame:
    """What becomes of each probe request: REUSED_SUCCESS where an identical probe has succeeded, SUPPRESSED_DUPLICATE where it
    was authorized before or stands earlier among the requests, else AUTHORIZED.

    requests: probe_key, ordinal. receipts: probe_key, result_state, receipt_sha256. authorized: probe_key. The receipt of
    a key is its succeeded one, else any; all sides are one row per key before they meet, so a hot key is no hot join.
    """
    good = F.col("result_state") == "SUCCEEDED"
    r = receipts.groupBy("probe_key").agg(F.min(F.struct(F.when(good, 0).otherwise(1).alias("k"), "receipt_sha256")).alias("m"))
    seen = authorized.select("probe_key").distinct().withColumn("_seen", F.lit(True))
    first = requests.groupBy("probe_key").agg(F.min("ordinal").alias("_first"))
    keyed = first.join(r, "probe_key", "left").join(seen, "probe_key", "left")
    j = requests.select("probe_key", "ordinal").join(keyed, "probe_key")
    what = F.when(F.col("m.k") == 0, "REUSED_SUCCESS").when(F.col("_seen") | (F.col("ordinal") > F.col("_first")), "SUPPRESSED_DUPLICATE").otherwise("AUTHORIZED")
    return j.select("probe_key", "ordinal", what.alias("disposition"), F.when(what != "AUTHORIZED", F.col("m.receipt_sha256")).alias("receipt_sha256"))


def hypothesis_final(ledger: DataFrame, key: str = "hypothesis_id", seq: str = "seq") -> DataFrame:
    """W5. Row of the first stop if a hypothesis stopped, else of its last outcome: nothing follows a stop."""
    row = F.struct("status", "terminal_reason", "consecutive_no_gain", "consecutive_counterevidence", seq)
    g = ledger.groupBy(key).agg(
        F.min_by(row, F.when(F.col("status") == "STOPPED", F.col(seq))).alias("stop"), F.max_by(row, seq).alias("last"))
    return g.select(key, F.coalesce("stop", "last").alias("r")).select(key, "r.*")


def transitions(spark) -> DataFrame:
    """The legal journal transitions as a table (12 fixed rows)."""
    return spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("from_state"), F.lit(e).alias("event_type"), F.lit(b).alias("legal_state")) for a, e, b in JOURNAL_TRANSITIONS])))


def validate_journal(log: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """W12. Entries whose (previous state, event) does not legally give their state."""
    j = with_previous(log, keys, seq, ["to_state"])
    j = j.withColumn("from_state", F.when(F.col(seq) == 1, F.lit(JOURNAL_START)).otherwise(F.col("prev_to_state"))).drop("prev_to_state")
    j = j.join(F.broadcast(transitions(log.sparkSession)), ["from_state", "event_type"], "left")
    v = (F.when(F.col("from_state").isNull(), "SEQUENCE_GAP").when(F.col("legal_state").isNull(), "ILLEGAL_TRANSITION")
         .when(F.col("legal_state") != F.col("to_state"), "TRANSITION_MISMATCH"))
    return j.withColumn("violation", v).filter("violation is not null").select(*keys, seq, "from_state", "event_type", "to_state", "violation")


def retry_outcome(attempts: DataFrame, key: str = "run_id", retryable=("TIMEOUT", "ERROR")) -> DataFrame:
    """W13. Final outcome of a run: its first attempt that may not be retried, else its last; and whether the
    attempts are numbered 1..n with nothing after the stop. Only combinable aggregates."""
    stop = F.when(~F.col("state").isin(*retryable), F.col("attempt"))
    g = attempts.groupBy(key).agg(
        F.count(F.lit(1)).alias("attempts"), F.min("attempt").alias("_lo"), F.max("attempt").alias("_hi"), F.countDistinct("attempt").alias("_d"),
        F.min(stop).alias("_stop"), F.min_by("state", stop).alias("_s"), F.max_by("state", "attempt").alias("_l"))
    return g.select(
        key, F.coalesce("_stop", "_hi").cast("long").alias("attempts_used"), F.coalesce("_s", "_l").alias("final_state"),
        ((F.col("_lo") == 1) & (F.col("_hi") == F.col("attempts")) & (F.col("_d") == F.col("attempts"))).alias("numbered"),
        F.coalesce(F.col("_hi") == F.col("_stop"), F.lit(True)).alias("stopped_in_time"))


def ordinal_contiguity(parts: DataFrame, keys: list[str], ordinal: str = "ordinal") -> DataFrame:
    """W1. Objects whose parts are not numbered 1..n exactly once. Counts per (object, ordinal) come first."""
    per = parts.groupBy(*keys, ordinal).agg(F.count(F.lit(1)).alias("_n"))
    g = per.groupBy(*keys).agg(F.sum("_n").alias("part_count"), F.count(F.lit(1)).alias("_d"), F.min(ordinal).alias("_lo"), F.max(ordinal).alias("_hi"))
    v = F.when(F.col("_d") < F.col("part_count"), "DUPLICATE_ORDINAL").when((F.col("_lo") != 1) | (F.col("_hi") != F.col("_d")), "ORDINAL_GAP")
    return g.withColumn("violation", v).filter("violation is not null").select(*keys, "part_count", "violation")
