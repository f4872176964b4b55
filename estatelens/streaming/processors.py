"""Row-level processors of the log streams (T1-T3, T5), for low latency where keys are small.

Each keeps one small value per key and walks the rows of a key in a micro-batch in order, so a key's rows of one batch
meet in one task; the source's trigger limits bound them. T1 without a timer is grouped by shares of the keys, as a group
of its own costs far more than the few rows of a source. Logs with hot keys go through ``logs.follow_runs``, ``follow_intake``
and ``follow_journal``, which give the same rows and spread a key over many tasks.
"""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..contracts import JOURNAL_START, JOURNAL_TRANSITIONS

DRIFT_OUT = "source_id string, seq long, event string, drift_state string, compared_to_seq long"
INTAKE_OUT = "idempotency_key string, request_id long, verdict string"
JOURNAL_OUT = "context_digest string, seq long, event_type string, verdict string, to_state string"



def _rows(batches: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable")


def _drift(source, rows, seq, sha, last) -> tuple[list[tuple], tuple]:
    """T1 verdicts of a source's rows (seq, outcome_state, result_sha256) in order, and the (seq, sha, last_seq) that they leave."""
    out = []
    for number, outcome, result in rows:
        if last is not None and number <= last:
            out.append((source, number, "SEQUENCE_REGRESSION", None, None))
            continue
        last = int(number)
        if outcome != "SUCCEEDED":
            out.append((source, last, "RUN", "NOT_COMPARABLE", None))
            continue
        state = "BASELINE" if sha is None else "UNCHANGED" if sha == result else "CHANGED"
        out.append((source, last, "RUN", state, seq))
        seq, sha = last, result
    return out, (seq, sha, last)


RECEIPT = ["seq", "outcome_state", "result_sha256"]
GOOD = T.StructType([T.StructField("seq", T.LongType()), T.StructField("sha", T.StringType()), T.StructField("last_seq", T.LongType())])


class RunDriftProcessor(StatefulProcessor):
    """T1 and T5. Drift of each receipt against the last known good; sequence regressions go to a side event; with
    a maximum age a timer raises STALE_ALERT when a source falls silent."""

    def __init__(self, max_age_ms: int | None = None):
        self.max_age_ms = max_age_ms

    def init(self, handle):
        self.handle = handle
        self.good = handle.getValueState("good", GOOD)

    def handleInputRows(self, key, rows, timerValues):
        known = self.good.get() if self.good.exists() else (None, None, None)
        df = _rows(rows, ["seq"])
        out, known = _drift(key[0], zip(*(df[c].tolist() for c in RECEIPT)), *known)
        self.good.update(known)
        if self.max_age_ms is not None:
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.max_age_ms)
        yield _frame(out, DRIFT_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        last = self.good.get()[2] if self.good.exists() else None
        yield _frame([(key[0], last, "STALE_ALERT", None, None)], DRIFT_COLUMNS)

    def close(self):
        pass


class SharedRunDriftProcessor(StatefulProcessor):
    """T1 for all sources of a share: one value per source, read and written only if the source has rows in the batch."""

    def init(self, handle):
        self.good = handle.getMapState("good", T.StructType([T.StructField("source_id", T.StringType())]), GOOD)

    def handleInputRows(self, key, rows, timerValues):
        out = []
        df = _rows(rows, ["seq"])
        sources: dict = {}
        for source, *row in zip(*(df[c].tolist() for c in ("source_id", *RECEIPT))):
            sources.setdefault(None if pd.isna(source) else source, []).append(row)
        for source, own in sources.items():
            known = self.good.getValue((source,)) or (None, None, None)
            judged, known = _drift(source, own, *known)
            out += judged
            self.good.updateValue((source,), known)
        yield _frame(out, DRIFT_COLUMNS)

    def close(self):
        pass


DRIFT_COLUMNS = {"source_id": "object", "seq": "Int64", "event": "object", "drift_state": "object", "compared_to_seq": "Int64"}
INTAKE_COLUMNS = {"idempotency_key": "object", "request_id": "Int64", "verdict": "object"}
JOURNAL_COLUMNS = {"context_digest": "object", "seq": "Int64", "event_type": "object", "verdict": "object", "to_state": "object"}


def _frame(rows, columns) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=list(columns)).astype(columns)


def run_drift_stream(receipts: DataFrame, max_age_ms: int | None = None, shares: int = 256) -> DataFrame:
    """T1/T5 over (source_id string, seq long, outcome_state, result_sha256). Timers of T5 are kept by source; without
    them sources are grouped in ``shares``, which a checkpoint holds the stream to."""
    if max_age_ms is not None:
        return receipts.groupBy("source_id").transformWithStateInPandas(RunDriftProcessor(max_age_ms), DRIFT_OUT, "Append", "ProcessingTime")
    shared = receipts.withColumn("_share", F.pmod(F.xxhash64("source_id"), F.lit(shares)).cast("int"))
    return shared.groupBy("_share").transformWithStateInPandas(SharedRunDriftProcessor(), DRIFT_OUT, "Append", "None")


class IntakeProcessor(StatefulProcessor):
    """T2. The first request of a key is applied; the same digest again is already applied, another conflicts."""

    def init(self, handle):
        self.first = handle.getValueState("first", T.StructType([T.StructField("digest", T.StringType())]))

    def handleInputRows(self, key, rows, timerValues):
        digest = self.first.get()[0] if self.first.exists() else None
        out = []
        for r in _rows(rows, ["ts", "request_id"]).itertuples(index=False):
            if digest is None:
                digest = r.request_digest
                out.append((key[0], r.request_id, "APPLIED"))
            else:
                out.append((key[0], r.request_id, "ALREADY_APPLIED" if r.request_digest == digest else "CONFLICT"))
        self.first.update((digest,))
        yield _frame(out, INTAKE_COLUMNS)

    def close(self):
        pass


def intake_stream(requests: DataFrame) -> DataFrame:
    """T2 verdicts over (idempotency_key string, request_id long, request_digest string, ts)."""
    return requests.groupBy("idempotency_key").transformWithStateInPandas(IntakeProcessor(), INTAKE_OUT, "Append", "None")


class JournalProcessor(StatefulProcessor):
    """T3 and T4. Accepts a legal event against the current state; anything else is reported and changes nothing.
    An event that names an expected version other than the current one is stale."""

    def init(self, handle):
        self.state = handle.getValueState("state", T.StructType([T.StructField("state", T.StringType()), T.StructField("version", T.LongType())]))
        self.legal = {(a, e): b for a, e, b in JOURNAL_TRANSITIONS}

    def handleInputRows(self, key, rows, timerValues):
        state, version = self.state.get() if self.state.exists() else (JOURNAL_START, 0)
        out = []
        for r in _rows(rows, ["seq"]).itertuples(index=False):
            to = self.legal.get((state, r.event_type))
            if not pd.isna(r.expected_version) and int(r.expected_version) != version:
                out.append((key[0], r.seq, r.event_type, "STALE_VERSION", None))
            elif to is None:
                out.append((key[0], r.seq, r.event_type, "ILLEGAL_TRANSITION", None))
            else:
                state, version = to, version + 1
                out.append((key[0], r.seq, r.event_type, "ACCEPTED", to))
        self.state.update((state, version))
        yield _frame(out, JOURNAL_COLUMNS)

    def close(self):
        pass


def journal_stream(events: DataFrame) -> DataFrame:
    """T3/T4 over (context_digest string, seq long, event_type, expected_version long or null)."""
    return events.groupBy("context_digest").transformWithStateInPandas(JournalProcessor(), JOURNAL_OUT, "Append", "None")
