"""Fact loads, projections, snapshot ingest, readback and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import table_digest, with_hash
from ..operators.evidence import one_row
from ..session import measured, shuffles_dropped

SECTIONS = ["relations", "columns", "constraints", "indexes"]


def load_fact(rows: DataFrame, dims: DataFrame, key: str = "truth_key") -> DataFrame:
    """S6. Facts with the dimension values of their key; joined on it; facts without one keep nulls."""
    return rows.join(dims, [key], "left")


def fact_check(facts: DataFrame, key: str = "truth_key") -> DataFrame:
    """S6 readback: rows and distinct keys; keys are combined before they are counted."""
    return facts.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("row_count"), F.count(key).alias("distinct_keys"))


def projection_summary(facts: DataFrame, keys: list[str] = ["snapshot_id"]) -> DataFrame:
    """S7. One row per snapshot with the count of each section."""
    return facts.groupBy(*keys).agg(*[F.count_if(F.col("category") == s).alias(s[:-1].replace("indexe", "index") + "_count") for s in SECTIONS])


def projection_detail(columns: DataFrame, receipt: str) -> DataFrame:
    """S7. One row per column, with a stable row id. columns is the column detail."""
    rid = F.sha2(F.concat_ws(":", F.lit(receipt), "schema_name", "relation_name", "column_name"), 256)
    return columns.select(rid.alias("row_id"), F.lit(receipt).alias("receipt_id"), "schema_name", "relation_name", "relation_kind", "column_name", "data_type", "ordinal_position",
                          F.coalesce("is_nullable", F.lit(False)).alias("is_nullable"))


def write_projection(facts: DataFrame, columns: DataFrame, receipt: str, root: str) -> None:
    projection_summary(facts).write.mode("overwrite").parquet(f"{root}/bi_analysis_summary")
    projection_detail(columns, receipt).write.mode("overwrite").parquet(f"{root}/bi_analysis_detail")


def _path(spark: SparkSession, root: str, name: str, snapshot=None):
    """(exists, file system, path) of a stored table, or of one snapshot of it, in any store Spark can write to."""
    part = "" if snapshot is None else "/snapshot_id=" + spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(str(snapshot))
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}{part}")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.exists(path), system, path


def ingest(tables: dict[str, DataFrame], snapshots: DataFrame, root: str) -> None:
    """S8. Replace all rows of the given snapshots in every table, then publish.

    tables carry snapshot_id; each write replaces only the partitions it brings. Rows of several snapshots are rebalanced by
    snapshot, which keeps files few and lets adaptive execution split a snapshot that holds most of them; one snapshot's
    rows are written where they are. ``snapshots`` (source_id,
    snapshot_id, analyzed_at, ...) is written last, one partition per source, and is the flag readers follow: a run
    that fails earlier leaves the previous snapshot active, and running it again is harmless. A given snapshot without
    rows in a table loses the rows it had there. Each table's shuffles go when it is written.
    """
    spark = snapshots.sparkSession
    with shuffles_dropped(spark):
        _ingest(spark, tables, snapshots, root)


def _ingest(spark: SparkSession, tables: dict[str, DataFrame], snapshots: DataFrame, root: str) -> None:
    given = [r.snapshot_id for r in snapshots.select("snapshot_id").distinct().collect()]  # one row per snapshot of this run
    for name, df in tables.items():
        held = [i for i in given if i is not None and _path(spark, root, name, i)[0]]
        kept = {r.snapshot_id for r in df.where(F.col("snapshot_id").isin(held)).select("snapshot_id").distinct().collect()} if held else set()
        rows = df.hint("rebalance", F.col("snapshot_id")) if len(given) > 1 else df
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("snapshot_id").parquet(f"{root}/{name}")
        for i in held:
            if i not in kept:
                _, system, path = _path(spark, root, name, i)
                system.delete(path, True)
    snapshots.withColumn("active", F.lit(True)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_id").parquet(f"{root}/catalog_snapshots")


def active_table(spark: SparkSession, root: str, name: str, source_id: str | None = None) -> DataFrame:
    """Rows of the active snapshots, of all sources or one. The snapshot list prunes partitions of the big side at run time."""
    act = spark.read.parquet(f"{root}/catalog_snapshots").filter("active")
    if source_id is not None:
        act = act.filter(F.col("source_id") == source_id)
    act = act.select("snapshot_id").distinct()
    return spark.read.parquet(f"{root}/{name}").join(act, ["snapshot_id"], "left_semi")


def digest_of(df: DataFrame, keys: list[str] = ["snapshot_id"]) -> DataFrame:
    return table_digest(with_hash(df, [x for x in df.columns if x not in keys], nfc=False), keys)


def readback(spark: SparkSession, expected: dict[str, DataFrame], root: str, snapshots: DataFrame | None = None) -> DataFrame:
    """S9. Per table and snapshot: expected and stored counts and digests, and whether they agree.

    Of the snapshots that have expected rows, and of those in ``snapshots`` (snapshot_id): stored rows where none are
    expected do not match. A table that is not there reads as empty; one that cannot be read is an error.
    """
    def one(name, df):
        cols = df.columns
        e = measured(digest_of(df).select("snapshot_id", F.col("row_count").alias("expected_rows"), F.col("digest_sha256").alias("expected_digest")))
        scope = e.select("snapshot_id")
        if snapshots is not None:
            scope = scope.unionAll(snapshots.select(F.col("snapshot_id").cast(df.schema["snapshot_id"].dataType))).distinct()
        stored = spark.read.schema(df.schema).parquet(f"{root}/{name}") if _path(spark, root, name)[0] else df.limit(0)
        stored = stored.select(*cols).join(measured(scope), "snapshot_id", "left_semi")
        s = digest_of(stored.select(*cols)).select("snapshot_id", F.col("row_count").alias("stored_rows"), F.col("digest_sha256").alias("stored_digest"))
        return e.join(s, "snapshot_id", "full_outer").select(
            F.lit(name).alias("table_name"), "snapshot_id", F.coalesce("expected_rows", F.lit(0)).cast("long").alias("expected_rows"), F.coalesce("stored_rows", F.lit(0)).cast("long").alias("stored_rows"),
            F.col("expected_digest").eqNullSafe(F.col("stored_digest")).alias("matches"))
    return reduce(DataFrame.unionByName, [one(n, d) for n, d in expected.items()])


def write_structure_map(inventory: DataFrame, relationships: DataFrame, coverage: DataFrame, root: str, fmt: str = "json") -> None:
    """S10. Inventory, relationships and coverage as files."""
    for name, df in (("inventory", inventory), ("relationships", relationships), ("coverage", coverage)):
        df.write.mode("overwrite").format(fmt).save(f"{root}/{name}")


def machine_report(summary: DataFrame, candidates: DataFrame) -> DataFrame:
    """S11. The summary row with counts and the order-independent digest of the candidates it stands on."""
    c = digest_of(candidates.withColumn("_k", F.lit(1)), ["_k"]).select("_k", F.col("row_count").alias("candidate_rows"), F.col("digest_sha256").alias("candidates_sha256"))
    return one_row(summary, c.drop("_k")).withColumn("candidate_rows", F.coalesce("candidate_rows", F.lit(0)).cast("long"))


def write_report(summary: DataFrame, candidates: DataFrame, root: str) -> None:
    """S11. A one-row JSON summary, and the candidates next to it as a table of any size."""
    machine_report(summary, candidates).write.mode("overwrite").json(f"{root}/report")
    candidates.write.mode("overwrite").parquet(f"{root}/candidates")
