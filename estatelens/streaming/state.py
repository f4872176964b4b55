"""Keyed state of a stream as tables, for streams that run their batches with DataFrame operators.

Batch n reads the state that batches below n left and writes only the keys it touched, to a folder of its own; run again it
finds the same state and overwrites the same folder. Every ``fold`` batches the newest row of each key goes into one base
table, and what no replay can need any more is deleted, so the state's size follows the live keys, not the stream's age.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove


class KeyedState:
    """Newest row of each key. ``live`` (on state columns) says which rows still count; others are gone for all readers."""

    def __init__(self, path: str, schema: str, keys: list[str], fold: int = 16):
        self.path, self.schema, self.keys, self.fold = path, schema, keys, fold

    def before(self, spark: SparkSession, batch_id: int, live: Column | None = None) -> DataFrame:
        """State as batches below batch_id left it."""
        base = batch_id // self.fold * self.fold - 1
        parts = ([(base, f"{self.path}/base={base}")] if base >= 0 else []) + [(i, f"{self.path}/batch={i}") for i in range(base + 1, batch_id)]
        out = None
        for i, p in parts:
            rows = spark.read.schema(self.schema).parquet(p).withColumn("_at", F.lit(i))
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            return spark.createDataFrame([], self.schema)
        names = [c for c in out.columns if c not in (*self.keys, "_at")]
        newest = out.groupBy(*self.keys).agg(F.max_by(F.struct(*names), "_at").alias("_row")).select(*self.keys, "_row.*")
        return newest if live is None else newest.where(live)

    def touched(self, keys: DataFrame, batch_id: int, live: Column | None = None) -> DataFrame:
        """State of the keys that a batch holds."""
        return self.before(keys.sparkSession, batch_id, live).join(keys.select(*self.keys).distinct(), self.keys, "left_semi")

    def write(self, rows: DataFrame, batch_id: int, live: Column | None = None) -> None:
        """The touched keys of a batch; now and then the base table. ``live`` drops what has expired from the base."""
        names = [f.split()[0] for f in self.schema.split(", ")]
        rows.select(*names).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        if (batch_id + 1) % self.fold:
            return
        spark, first = rows.sparkSession, batch_id + 1 - self.fold
        base = batch_id // self.fold * self.fold - 1
        parts = ([f"{self.path}/base={base}"] if base >= 0 else []) + [f"{self.path}/batch={i}" for i in range(first, batch_id + 1)]
        every = None
        for i, p in enumerate(parts):
            one = spark.read.schema(self.schema).parquet(p).withColumn("_at", F.lit(i))
            every = one if every is None else every.unionByName(one)
        rest = [n for n in names if n not in self.keys]
        newest = every.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "_at").alias("_row")).select(*self.keys, "_row.*")
        (newest if live is None else newest.where(live)).select(*names).write.mode("overwrite").parquet(f"{self.path}/base={batch_id}")
        # batch_id may be run again and then reads the base before this one, and the batches since; older ones are of no use
        for gone in [f"{self.path}/base={batch_id - 2 * self.fold}"] + [f"{self.path}/batch={i}" for i in range(max(0, first - self.fold), first)]:
            remove(spark, gone)


def follow(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str):
    """Run step(batch, batch number) on what has landed so far, one micro-batch after the other."""
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows that the batches of a stream have put out below path, without the batch number."""
    return spark.read.schema(schema).parquet(f"{path}/batch=*")
