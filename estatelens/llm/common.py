"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.session import cut_lineage, shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z only; other letters stay as they are."""
    return F.translate(c, UPPER, LOWER)


def id_remainder(c: Column, n: int) -> Column:
    """crc32 of the id as decimal text, modulo n; null for a null id."""
    return F.crc32(c.cast("string").cast("binary")) % n


def saved(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: a lineage cut that survives a lost executor."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(uri: str):
    """(file system, path) of a URI, for tasks that write or read whole files: local or shared mounts, HDFS, object stores."""
    from pyarrow import fs
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return fs.LocalFileSystem(), parsed.path or uri
    return fs.FileSystem.from_uri(uri)


def put_file(uri: str, chunks) -> int:
    """Write chunks to uri and return their size. The file appears under its name only when it is whole, so a retried task is safe."""
    system, path = file_system(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    n = 0
    with system.open_output_stream(part) as out:
        for c in chunks:
            out.write(c)
            n += len(c)
    system.move(part, path)
    return n


def components(nodes_edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list: (node, label), label the smallest node of the component.

    Alternates large-star and small-star contraction, so the number of rounds grows with the logarithm of the
    longest chain, and no step gathers a component. Each round is cut with a checkpoint. Ends once all edges are stars: each
    node has one smaller neighbour, which has none. Edges that are stars already take no round.
    """
    edges = nodes_edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = cut_lineage(edges)
    ends = lambda e: e.select(F.col("u").alias("x"), F.lit(1).alias("down")).unionAll(e.select(F.col("v").alias("x"), F.lit(0).alias("down")))
    while ends(edges).groupBy("x").agg(F.sum("down").alias("n"), F.min("down").alias("least")).agg(F.count_if(F.expr("n > 1 or n = 1 and least = 0"))).first()[0]:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = cut_lineage(small)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
