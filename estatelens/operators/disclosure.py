"""Disclosure rules over nested documents (P13): a breadth-first walk that names the place of each finding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import flags
from ..session import Scratch
from .rules import CONNECTION, CONTROL, RAW_SQL, ROW_KEY, SECRET_KEY, SECRET_VALUE, SQL_KEY, UNSAFE_KEYS, snake_key

LONGEST_TEXT, LONGEST_ARRAY = 100_000, 500  # fixed values: what a released document may hold in one place


def _findings(nodes: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, path, flag) of nodes: the key under which a value stands, and the value if it is a text or an array."""
    first, text = F.substring("body", 1, 1), F.variant_get(F.parse_json("body"), "$", "string")
    k, is_text = F.col("key"), first == '"'
    found = flags(
        (k.rlike(SECRET_KEY), "SECRET_KEY"), (k.rlike(ROW_KEY), "SOURCE_ROW_KEY"), (k.rlike(SQL_KEY), "RAW_SQL_KEY"), (snake_key("key").isin(UNSAFE_KEYS), "UNSAFE_EVIDENCE_KEY"),
        (is_text & ((F.length("text") < 1) | (F.length("text") > LONGEST_TEXT) | F.col("text").rlike(CONTROL)), "TEXT_DENIED"),
        (is_text & F.col("text").rlike(SECRET_VALUE), "SECRET_VALUE"), (is_text & F.col("text").rlike(CONNECTION), "CONNECTION_STRING"), (is_text & F.col("text").rlike(RAW_SQL), "RAW_SQL"), ((first == "[") & (F.col("size") > LONGEST_ARRAY), "ARRAY_OVERSIZED"))
    shown = nodes.withColumn("text", F.when(is_text, text)).withColumn("size", F.when(first == "[", F.json_array_length("body")))
    return shown.select(*ids, "path", F.explode(found).alias("flag"))


def disclosure_walk(df: DataFrame, ids: list[str], json_col: str) -> DataFrame:
    """P13. (ids, path, flag): every rule that a key or value breaks, at any depth and inside arrays.

    A level of the documents is one table of nodes, whatever their number in one document; children are exploded from
    VARIANT values until no container is left, which takes as many rounds as the deepest document has levels. Paths
    read ``$.a[0].b``. A null document has no finding; text that is no JSON is NOT_JSON at ``$``. Repeated rows repeat
    their findings.
    """
    spark = df.sparkSession
    with Scratch(spark) as scratch:
        docs = df.select(*ids, F.try_parse_json(F.col(json_col)).alias("v"), F.col(json_col).alias("raw"))
        broken = docs.where("v is null and raw is not null").select(*ids, F.lit("$").alias("path"), F.lit("NOT_JSON").alias("flag"))
        nodes = scratch.keep(docs.where("v is not null").select(*ids, F.lit("$").alias("path"), F.lit(None).cast("string").alias("key"), F.to_json("v").alias("body")))
        found = [broken, _findings(nodes, ids)]
        while True:
            open_ = nodes.where(F.substring("body", 1, 1).isin("{", "[")).select(*ids, "path", F.parse_json("body").alias("v"))
            step = open_.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
            at = F.when(F.col("key").isNotNull(), F.concat("path", F.lit("."), "key")).otherwise(F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]")))
            nodes = scratch.keep(step.select(*ids, at.alias("path"), "key", F.to_json("value").alias("body")))
            if nodes.isEmpty():
                break
            found.append(_findings(nodes, ids))
        out = found[0]
        for f in found[1:]:
            out = out.unionByName(f)
        return scratch.keep(out, outlives=True)
