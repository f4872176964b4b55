"""Inventory of tables and their columns (S5) and the method registry."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.scalars import spark_family
from ..operators import profiling, relationships

INVENTORY = T.StructType([
    T.StructField("table_name", T.StringType()), T.StructField("column_name", T.StringType()), T.StructField("data_type", T.StringType()),
    T.StructField("family", T.StringType()), T.StructField("ordinal_position", T.IntegerType()), T.StructField("is_nullable", T.BooleanType())])


def inventory(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """S5. One row per column, from schemas only; no data is read."""
    rows = [(t, f.name, f.dataType.simpleString(), spark_family(f.dataType), i + 1, f.nullable) for t, df in sorted(tables.items()) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, INVENTORY)


def catalog_inventory(spark: SparkSession, database: str | None = None) -> DataFrame:
    """S5 over the session catalog."""
    names = [t.name for t in spark.catalog.listTables(database)]
    return inventory(spark, {n: spark.table(f"{database}.{n}" if database else n) for n in names})


_COUNTS = "row_count bigint, null_count bigint, distinct_count bigint"


@dataclass(frozen=True)
class Method:
    """R1. An allowlisted operation: what it targets, the arguments it takes, the columns it returns."""
    name: str
    target_kind: str
    arguments: tuple[str, ...]
    output: str
    run: Callable[..., DataFrame]


METHODS: dict[str, Method] = {m.name: m for m in [
    Method("COLUMN_PROFILE", "COLUMN", ("column", "family"), "column_name string, type_family string, " + _COUNTS, lambda df, column, family: profiling.profile(df, column, family)),
    Method("COLUMN_SUMMARY", "COLUMN", ("column", "max_rows", "order"), _COUNTS, lambda df, column, max_rows, order=None: profiling.column_summary(df, column, max_rows, order)),
    Method("TEMPORAL_COVERAGE", "COLUMN", ("column", "max_rows", "order"), _COUNTS + ", minimum string, maximum string, freshness_maximum string",
           lambda df, column, max_rows, order=None: profiling.temporal_coverage(df, column, max_rows, order)),
    Method("QUALITY_INDICATORS", "COLUMN", ("column", "max_rows", "order"), _COUNTS, lambda df, column, max_rows, order=None: profiling.quality_indicators(df, column, max_rows, order)),
    Method("RELATIONSHIP_OVERLAP", "RELATIONSHIP", ("source_column", "target_column", "max_rows"),
           "source_non_null_count bigint, source_distinct_count bigint, target_non_null_count bigint, target_distinct_count bigint, matched_distinct_count bigint",
           lambda df, target, source_column, target_column, max_rows=None: relationships.relationship_overlap(df, source_column, target, target_column, max_rows)),
    Method("TABLE_PROFILE", "TABLE", ("columns", "distinct"), "column_name string, ordinal_position int, type_family string, " + _COUNTS, lambda df, columns=None, distinct="exact": profiling.profile_table(df, columns, distinct)),
]}


def run_method(name: str, *frames: DataFrame, **arguments) -> DataFrame:
    """Run an allowlisted method; an unknown name or argument, or a missing declared output column, is an error."""
    if name not in METHODS:
        raise KeyError(f"method {name} is not allowlisted")
    m = METHODS[name]
    extra = set(arguments) - set(m.arguments)
    if extra:
        raise ValueError(f"{name} does not take {sorted(extra)}")
    out = m.run(*frames, **arguments)
    missing = [x.split()[0] for x in m.output.split(",") if x.split()[0] not in out.columns]
    if missing:
        raise ValueError(f"{name} did not return {missing}")
    return out
