"""Registry of bound queries: each pairs an operator run over the given tables with an independent SQL text."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf: str, *names: str):
    dfs = [spark.read.parquet(os.path.join(sf, n + ".parquet")) for n in names]
    return dfs[0] if len(dfs) == 1 else dfs


def typed(sql: str, casts: dict[str, str]) -> str:
    """The same SQL with the declared types of some columns: type -> column names."""
    parts = [f"CAST({c} AS {t}) AS {c}" for t, names in casts.items() for c in names.split()]
    return f"SELECT * REPLACE ({', '.join(parts)}) FROM ({sql})" if parts else sql


class Registry:
    def __init__(self):
        self.queries, self.oracles = {}, {}

    def add(self, name: str, sql: str | None = None):
        def wrap(fn):
            if name in self.queries:
                raise ValueError(f"query {name} registered twice")
            self.queries[name] = fn
            if sql:
                self.oracles[name] = sql
            return fn
        return wrap


def items_text(col: str) -> Column:
    """Counterevidence array as text, e.g. ``A=1;B=2``."""
    return F.array_join(F.transform(col, lambda x: F.concat(x["reason_code"], F.lit("="), x["count"].cast("string"))), ";")


def stringify(df: DataFrame, *cols: str) -> DataFrame:
    for x in cols:
        df = df.withColumn(x, F.array_join(F.col(x), ","))
    return df
