"""Histograms of many columns at once over typed values, exact ranks by leading digits, distinct counts by 128-bit keys.

Columns of different types meet in one shuffle without becoming text: a value travels as a long (integers, and decimals of up
to 18 digits, unscaled), a double, the digits of a wide decimal, or two 64-bit hashes. Only distinct values are ever turned
into an order key, a string whose text order is the value order, and ranks are found by narrowing to the leading digits that
hold them, so a value above 2**53 or of 38 digits is as exact as any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import int_div, spark_family
from ..session import Scratch

UPPER_MEDIAN = "median"
LEAST_LONG = -(1 << 63)
DIGITS = 4  # of an order key that one round narrows by: at most 65,536 ranges a column and rank
CLOSING = 65_536  # distinct values that the closing window takes for one column and rank
SLOTS = "l long, f double, t string, h1 long, h2 long"


def _hashed(col: Column, dtype: T.DataType) -> tuple[Column, Column]:
    """128 bits of a value of any type; equal values have equal bits. Zero has one sign, a map the order of its keys."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        col = F.when(col == 0, F.lit(0.0)).otherwise(col)
    if isinstance(dtype, T.MapType):
        col = F.array_sort(F.map_entries(col))
    if isinstance(dtype, (T.VariantType, T.NullType)):
        col = col.cast("string")
    return tuple(F.when(col.isNotNull(), F.xxhash64(F.lit(seed), col)) for seed in (1, 2))


def slots(name: str, dtype: T.DataType) -> Column:
    """A value in the slot of its type; all slots are null for a null."""
    col, null = F.col(name), lambda t: F.lit(None).cast(t)
    if isinstance(dtype, T.DecimalType) and dtype.precision <= 18:
        got = {"l": (col * F.lit(10 ** dtype.scale).cast(T.DecimalType(dtype.scale + 1, 0))).cast("long")}
    elif isinstance(dtype, T.DecimalType):
        got = {"t": col.cast("string")}
    elif isinstance(dtype, (T.DoubleType, T.FloatType)):
        got = {"f": col.cast("double")}
    elif spark_family(dtype) == "NUMERIC":
        got = {"l": col.cast("long")}
    else:
        got = dict(zip(("h1", "h2"), _hashed(col, dtype)))
    return F.struct(*[got.get(s, null(t)).alias(s) for s, t in (x.split() for x in SLOTS.split(", "))])


def histogram(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, l, f, t, h1, h2, n): distinct values of all columns with their counts, nulls as one row, in one shuffle."""
    types = {f.name: f.dataType for f in df.schema.fields}
    rows = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), slots(x, types[x]).alias("s")) for i, x in enumerate(cols)]))).select("i", "s.*")
    g = rows.groupBy("i", "l", "f", "t", "h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    names = F.array(*[F.lit(x) for x in cols])
    return g.select(F.get(names, F.col("i")).alias("column_name"), "l", "f", "t", "h1", "h2", "n")


def is_value() -> Column:
    return F.coalesce(F.col("l").isNotNull() | F.col("f").isNotNull() | F.col("t").isNotNull() | F.col("h1").isNotNull(), F.lit(False))


def distinct_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, distinct_count) of all columns in one shuffle of 128-bit keys; no row for a table without rows."""
    types = {f.name: f.dataType for f in df.schema.fields}
    keys = [F.struct(F.lit(i).alias("i"), *[h.alias(n) for h, n in zip(_hashed(F.col(x), types[x]), ("h1", "h2"))]) for i, x in enumerate(cols)]
    g = df.select(F.inline(F.array(*keys))).groupBy("i", "h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    names = F.array(*[F.lit(x) for x in cols])
    return g.groupBy("i").agg(F.count("h1").alias("distinct_count")).select(F.get(names, F.col("i")).alias("column_name"), "distinct_count")


def order_key() -> Column:
    """Text whose order is that of the numbers in slots l, f and t (one column's values share a slot)."""
    sixteen = lambda x: F.lpad(F.hex(x), 16, "0")
    least = F.lit(LEAST_LONG).cast("long")
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.when(F.col("f") == 0, F.lit(0.0)).otherwise(F.coalesce("f", F.lit(0.0)))).cast("long")
    double = sixteen(F.when(bits < 0, F.bitwise_not(bits)).otherwise(bits.bitwiseXOR(least)))
    whole = F.lpad(F.regexp_extract("t", r"^-?(\d+)", 1), 38, "0")
    digits = F.concat(whole, F.rpad(F.regexp_extract("t", r"\.(\d+)$", 1), 38, "0"))
    decimal = F.when(F.col("t").startswith("-"), F.concat(F.lit("0"), F.translate(digits, "0123456789", "9876543210"))).otherwise(F.concat(F.lit("1"), digits))
    return F.when(F.col("l").isNotNull(), sixteen(F.col("l").bitwiseXOR(least))).when(F.col("f").isNotNull(), double).when(F.col("t").isNotNull(), decimal)


def value_text(scales: Column) -> Column:
    """Exact text of the number in the slots; ``scales`` is the decimal scale of a long slot, null for integers."""
    size = F.lpad(F.abs(F.col("l").cast("decimal(20,0)")).cast("string"), F.greatest(scales + 1, F.lit(1)), "0")
    digits = F.when(F.length(F.abs(F.col("l").cast("decimal(20,0)")).cast("string")) > scales, F.abs(F.col("l").cast("decimal(20,0)")).cast("string")).otherwise(size)
    point = F.length(digits) - scales
    scaled = F.concat(F.when(F.col("l") < 0, "-").otherwise(""), F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, scales))
    long = F.when(F.coalesce(scales, F.lit(0)) == 0, F.col("l").cast("string")).otherwise(scaled)
    return F.when(F.col("l").isNotNull(), long).when(F.col("f").isNotNull(), F.when(F.col("f") == 0, F.lit(0.0)).otherwise(F.col("f")).cast("string")).otherwise(F.col("t"))


def rank_of(p, n: Column) -> Column:
    """0-based rank: the upper median is n div 2, quantile p is floor((n - 1) * p)."""
    return int_div(n, F.lit(2)) if p == UPPER_MEDIAN else F.floor((n - 1) * F.lit(float(p))).cast("long")


def picked_ranks(scratch: Scratch, hist: DataFrame, wanted: dict, digits: int = DIGITS, closing: int = CLOSING) -> DataFrame:
    """(column_name, q, l, f, t): the value at each wanted rank of each column of a kept numeric histogram with ``_k``.

    A goal is a prefix of order keys that holds a rank. Each round sums the histogram by ``digits`` more places of the
    keys under the goals and keeps the range that holds the rank; leading places that all keys of a column share
    are skipped. When at most ``closing`` distinct values are left under each goal, one window per goal ends it.
    """
    ends = hist.groupBy("column_name").agg(F.sum("n").alias("total"), F.min("_k").alias("lo"), F.max("_k").alias("hi"), F.count(F.lit(1)).alias("left"))
    apart = F.filter(F.sequence(F.lit(1), F.length("lo")), lambda i: F.substring(F.col("lo"), i, F.lit(1)) != F.substring(F.col("hi"), i, F.lit(1)))
    same = F.coalesce(F.get(apart, 0) - 1, F.length("lo"))
    goals = ends.select("column_name", "left", F.substring("lo", F.lit(1), same).alias("prefix"), F.length("lo").alias("whole"), F.inline(F.array(*[
        F.struct(F.lit(q).alias("q"), rank_of(p, F.col("total")).alias("rank")) for q, p in wanted.items()])))
    goals = scratch.keep(goals)
    while (goals.where(F.length("prefix") < F.col("whole")).agg(F.max("left")).first()[0] or 0) > closing:
        under = hist.join(goals, "column_name").where(F.col("_k").startswith(F.col("prefix")))
        ranges = under.groupBy("column_name", "q", "whole", "rank", F.substring(F.col("_k"), F.lit(1), F.length("prefix") + digits).alias("prefix")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("left"))
        below = Window.partitionBy("column_name", "q").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
        ranges = ranges.withColumn("off", F.coalesce(F.sum("n").over(below), F.lit(0))).where((F.col("rank") >= F.col("off")) & (F.col("rank") < F.col("off") + F.col("n")))
        goals = scratch.keep(ranges.select("column_name", "q", "prefix", "whole", (F.col("rank") - F.col("off")).alias("rank"), "left"))
    under = hist.join(goals, "column_name").where(F.col("_k").startswith(F.col("prefix")))
    below = Window.partitionBy("column_name", "q").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    last = under.withColumn("off", F.coalesce(F.sum("n").over(below), F.lit(0)))
    return last.where((F.col("rank") >= F.col("off")) & (F.col("rank") < F.col("off") + F.col("n"))).select("column_name", "q", "l", "f", "t")


def exact_quantiles(df: DataFrame, cols: list[str], wanted: dict, digits: int = DIGITS, closing: int = CLOSING) -> DataFrame:
    """W10. One row per numeric column that has a value: each wanted quantile as exact text.

    wanted: name -> UPPER_MEDIAN or a share. Nulls take no part; NaN is above all numbers.
    """
    with Scratch(df.sparkSession) as scratch:
        hist = scratch.keep(histogram(df, cols).where(is_value()).withColumn("_k", order_key()))
        return scratch.keep(quantile_texts(picked_ranks(scratch, hist, wanted, digits, closing), df, cols, wanted), outlives=True)


def quantile_texts(picked: DataFrame, df: DataFrame, cols: list[str], wanted: dict) -> DataFrame:
    text = picked.withColumn("x", value_text(scales_of(df, cols)))
    return text.groupBy("column_name").agg(*[F.max(F.when(F.col("q") == q, F.col("x"))).alias(q) for q in wanted])


def scales_of(df: DataFrame, cols: list[str]) -> Column:
    """Decimal scale of a column by its name; null for other types."""
    pairs = [y for x in cols if isinstance(t := df.schema[x].dataType, T.DecimalType) for y in (F.lit(x), F.lit(t.scale))]
    return F.create_map(*pairs)[F.col("column_name")] if pairs else F.lit(None).cast("int")
