"""Ordered scans that split a hot key.

A plain window sends a whole key to one task. These helpers cut a key into blocks of its order column, scan
each block on its own, and carry one summary row per block across, so the largest unit of work is a block
or the list of block summaries of a key, not the key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blocked_row_number(df: DataFrame, keys: list[str], order_by: list[str], block: Column, out: str = "seq") -> DataFrame:
    """row_number() over (partition by keys order by order_by). ``block`` must not decrease along order_by."""
    b = df.withColumn("_blk", block)
    tot = b.groupBy(*keys, "_blk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*keys, "_blk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inner = Window.partitionBy(*keys, "_blk").orderBy(*order_by)
    return (
        b.withColumn("_rn", F.row_number().over(inner)).join(off, [*keys, "_blk"])
        .withColumn(out, (F.col("_rn") + F.col("_off")).cast("long")).drop("_rn", "_off", "_blk")
    )


def blocked_last(df: DataFrame, keys: list[str], order: str, block: Column, value: Column, out: str,
                 inclusive: bool = False) -> DataFrame:
    """Latest non-null ``value`` before each row (up to and with the row if ``inclusive``) by ``order``."""
    b = df.withColumn("_blk", block).withColumn("_val", value)
    at = F.when(F.col("_val").isNotNull(), F.col(order))
    blocks = b.groupBy(*keys, "_blk").agg(F.max_by("_val", at).alias("_last"))
    prior = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = blocks.select(*keys, "_blk", F.last("_last", ignorenulls=True).over(prior).alias("_carry"))
    inner = Window.partitionBy(*keys, "_blk").orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    return (
        b.withColumn("_own", F.last("_val", ignorenulls=True).over(inner)).join(carry, [*keys, "_blk"])
        .withColumn(out, F.coalesce("_own", "_carry")).drop("_own", "_carry", "_val", "_blk")
    )


def blocked_sums(df: DataFrame, keys: list[str], order: str, block: Column, sums: dict[str, str]) -> DataFrame:
    """Running sums up to and with each row by ``order``: {column: name of its sum}."""
    b = df.withColumn("_blk", block)
    totals = b.groupBy(*keys, "_blk").agg(*[F.sum(x).alias("_t_" + x) for x in sums])
    prior = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, "_blk", *[F.coalesce(F.sum("_t_" + x).over(prior), F.lit(0)).alias("_c_" + x) for x in sums])
    inner = Window.partitionBy(*keys, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = b.withColumns({"_o_" + x: F.sum(x).over(inner) for x in sums}).join(carry, [*keys, "_blk"])
    return own.withColumns({out: (F.col("_o_" + x) + F.col("_c_" + x)).cast("long") for x, out in sums.items()}).drop("_blk", *["_o_" + x for x in sums], *["_c_" + x for x in sums])


def with_previous(df: DataFrame, keys: list[str], seq: str, cols: list[str], prefix: str = "prev_") -> DataFrame:
    """Columns of the entry numbered seq-1, by an equi-join on (keys, seq): no key is ever gathered whole."""
    prev = df.select(*keys, (F.col(seq) + 1).alias(seq), *[F.col(x).alias(prefix + x) for x in cols])
    return df.join(prev, [*keys, seq], "left")


def complete_groups(batches: Iterator[pd.DataFrame], keys: list[str], rows: int = 65_536) -> Iterator[pd.DataFrame]:
    """Sorted batches cut anew so that no group of ``keys`` is split; each piece has about ``rows`` rows or one group."""
    held: list[pd.DataFrame] = []
    for b in batches:
        held.append(b)
        if sum(map(len, held)) < rows:
            continue
        df = pd.concat(held, ignore_index=True)
        last = (df[keys] == df[keys].iloc[-1]).all(axis=1).to_numpy()
        cut = len(df) - int(last[::-1].argmin()) if not last.all() else 0
        if cut:
            yield df.iloc[:cut].reset_index(drop=True)
        held = [df.iloc[cut:]]
    if held and sum(map(len, held)):
        yield pd.concat(held, ignore_index=True)
