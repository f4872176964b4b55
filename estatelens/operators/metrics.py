"""Metric queries, named catalog metrics and evaluated semantic suggestions (M1-M3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import spark_family


def metric_query(df: DataFrame, measure: str, equals: dict | None = None, isin: dict | None = None, time_col: str | None = None,
                 time_range: tuple | None = None, grain: str | None = None, group_by: list[str] = (), row_limit: int | None = None) -> DataFrame:
    """M1. SUM of a measure under equality and IN filters, a half-open time range and a time grain.

    Filters are plain predicates, so they reach the Parquet scan. All groups are returned; with a row limit the rows are the first by key.
    """
    for k, v in (equals or {}).items():
        df = df.filter(F.col(k) == v)
    for k, v in (isin or {}).items():
        df = df.filter(F.col(k).isin(list(v)))
    if time_range:
        df = df.filter((F.col(time_col) >= F.lit(time_range[0]).cast("timestamp")) & (F.col(time_col) < F.lit(time_range[1]).cast("timestamp")))
    keys = ([F.date_trunc(grain, F.col(time_col)).alias("period_start")] if grain else []) + [F.col(x) for x in group_by]
    out = df.groupBy(*keys).agg(F.sum(measure).alias("metric_value"))
    if row_limit is None:
        return out
    return out.orderBy(*[x for x in out.columns if x != "metric_value"]).limit(row_limit)


def named_metrics(overview: DataFrame, capacity: DataFrame, code: DataFrame, coverage: DataFrame) -> DataFrame:
    """M2. Catalog totals, one row per metric; every input reduces to one row on its own."""
    parts = [
        overview.agg(F.sum("relation_count").cast("long").alias("v")).select(F.lit("relations_total").alias("metric"), "v"),
        overview.agg(F.sum("column_count").cast("long").alias("v")).select(F.lit("columns_total").alias("metric"), "v"),
        capacity.agg(F.sum("bytes").cast("long").alias("v")).select(F.lit("estimated_bytes").alias("metric"), "v"),
        capacity.agg(F.sum("constraint_count").cast("long").alias("v")).select(F.lit("constraints_total").alias("metric"), "v"),
        capacity.agg(F.sum("index_count").cast("long").alias("v")).select(F.lit("indexes_total").alias("metric"), "v"),
        code.agg(F.sum("compile_issue_count").cast("long").alias("v")).select(F.lit("compile_issues").alias("metric"), "v"),
        coverage.agg(F.count_if(F.col("state").isin("DENIED", "TIMEOUT", "ERROR", "PARTIAL")).alias("v")).select(F.lit("denied_or_unknown_collectors").alias("metric"), "v"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumnRenamed("v", "value")


KEY_NAME = "(?i)(^id$|_id$)"
SUM_NAME = "(?i)(amount|revenue|cost|price|total)"
AVG_NAME = "(?i)(delay|late|lead_time|duration)"


def semantic_model(columns: DataFrame) -> DataFrame:
    """M3. Measure, dimension and KPI suggestions from (table_name, column_name, family)."""
    n, fam = F.col("column_name"), F.col("family")
    def item(kind, expr: Column | None = None):
        return F.struct(F.lit(kind).alias("element"), (expr if expr is not None else F.lit(None).cast("string")).alias("expression"))
    items = F.array_compact(F.array(
        F.when((fam == "numeric") & ~n.rlike(KEY_NAME), item("measure")).when(fam.isin("text", "temporal"), item("dimension")),
        F.when(n.rlike(SUM_NAME), item("kpi", F.concat(F.lit("SUM("), n, F.lit(")")))),
        F.when(n.rlike(AVG_NAME), item("kpi", F.concat(F.lit("AVG("), n, F.lit(")"))))))
    return columns.select("table_name", "column_name", F.explode(items).alias("i")).select("table_name", "column_name", "i.element", "i.expression")


def evaluate_kpis(df: DataFrame, table: str) -> DataFrame:
    """M3, evaluated: the KPIs a table's column names suggest, all in one aggregate over one scan."""
    import re
    todo = []
    for f in df.schema.fields:
        if spark_family(f.dataType) != "NUMERIC":
            continue
        if re.search(SUM_NAME, f.name):
            todo.append((f"{table}.{f.name}.sum", F.sum(f.name)))
        if re.search(AVG_NAME, f.name):
            todo.append((f"{table}.{f.name}.avg", F.avg(f.name)))
    one = df.agg(*[e.cast("double").alias(f"_{i}") for i, (_, e) in enumerate(todo)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kpi_id"), F.col(f"_{i}").alias("value")) for i, (k, _) in enumerate(todo)])))
