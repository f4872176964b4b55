"""Session helpers: defaults for a local run and fault-tolerant lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "estatelens", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution and UTC time. On a cluster, spark-submit supplies master and sizes."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        b = b.master(master).config("spark.driver.memory", "12g")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, for iterative jobs.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only a local session that names
    none gets a folder of its own. A cluster session that names none is an error, since a machine-local
    folder would not survive a lost executor.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a shared folder before running iterative operators")
            folder = tempfile.mkdtemp(prefix="estatelens-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """A new folder for job output that must outlive an executor: below spark.checkpoint.dir, or local in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/estatelens-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    return tempfile.mkdtemp(prefix="estatelens-")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that a job of ours has written and no longer reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run here go when each has ended, not when the driver happens to collect its garbage.

    For jobs that write one table after another, whose disk would else hold the shuffles of all of them. A plan that is run again
    makes its shuffles anew.
    """
    old = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, old)


class Scratch:
    """Tables of one job in a shared folder: lineage cuts that survive a lost executor and go when the job is done.

    ``with Scratch(spark) as s: t = s.keep(df)``. What ``keep(..., outlives=True)`` wrote is left for the caller, whose
    result reads it.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, shared_folder(spark)
        self.kept: list[tuple[DataFrame, str]] = []

    def keep(self, df: DataFrame, outlives: bool = False) -> DataFrame:
        path = f"{self.folder}/{uuid.uuid4().hex}"
        with shuffles_dropped(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        if not outlives:
            self.kept.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        for path in [p for d, p in self.kept if any(d is t for t in tables)]:
            remove(self.spark, path)
        self.kept = [(d, p) for d, p in self.kept if not any(d is t for t in tables)]

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        self.drop(*[d for d, _ in self.kept])


def measured(df: DataFrame) -> DataFrame:
    """``df`` written down, so that the planner knows how small it is before it deals any rows to meet it.

    At run time a small side with few keys is not broadcast, as most of its partitions are empty, and the rows of a hot key
    then meet in one task. A table that is large is still shuffled.
    """
    return Scratch(df.sparkSession).keep(df, outlives=True)
