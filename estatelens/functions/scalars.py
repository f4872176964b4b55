"""Column helpers: floored ratios, flags, type families, array folding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bps(num, den) -> Column:
    """floor(num * 10000 / den) on longs, 0 where den is 0."""
    n, d = c(num).cast("long"), c(den).cast("long")
    return F.when(d == 0, F.lit(0).cast("long")).otherwise(_div(n * 10000, d))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def int_div(a, b) -> Column:
    return _div(c(a).cast("long"), c(b).cast("long"))


def clamp(x, lo: int, hi: int) -> Column:
    return F.greatest(F.least(c(x), F.lit(hi)), F.lit(lo))


def lit_null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def flags(*pairs) -> Column:
    """Array of the labels whose condition holds, in the order given."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(label)) for cond, label in pairs]))


def sorted_set(x) -> Column:
    return F.array_sort(F.array_distinct(c(x)))


def yes(x) -> Column:
    """Y / YES / 1 / TRUE in any case become true; everything else, null included, false."""
    return F.coalesce(F.lower(c(x).cast("string")).isin("y", "yes", "1", "true"), F.lit(False))


def domain_map(x, mapping: dict, default=None) -> Column:
    """CASE over a closed domain."""
    col = c(x)
    out = None
    for k, v in mapping.items():
        out = F.when(col == k, F.lit(v)) if out is None else out.when(col == k, F.lit(v))
    return out.otherwise(F.lit(default))


def spark_family(dtype: T.DataType) -> str:
    """Family of a Spark type: NUMERIC, TEMPORAL, BOOLEAN or TEXT."""
    if isinstance(dtype, NUMERIC):
        return "NUMERIC"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "TEMPORAL"
    if isinstance(dtype, T.BooleanType):
        return "BOOLEAN"
    return "TEXT"


def as_text(name: str, dtype: T.DataType) -> Column:
    """Injective text of a value of one type, for histograms and min/max report rows."""
    col = F.col(name)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(col)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(col == 0, F.lit(0.0)).otherwise(col).cast("string")
    return col.cast("string")


def iso(x) -> Column:
    return F.date_format(c(x), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
