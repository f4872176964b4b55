"""Canonical row text, content hashes and order-independent table digests."""

from __future__ import annotations

import unicodedata
from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contracts import OBSERVATION_FIELDS
from .scalars import c

SCHEME = "v2"  # v2: escaped separators, nested texts folded and composed, maps by key; no v1 hash is comparable
SEP = "\u001f"
NULL = "\u0000null"


@F.pandas_udf(T.StringType())
def _nfc_batch(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


def composed(txt: Column) -> Column:
    """NFC. Spark runs a Python function on every row, whatever CASE it stands in, so values that are plain ASCII are
    sent to it as nulls and kept as they are."""
    return F.coalesce(_nfc_batch(F.when(txt.rlike("[^\\x00-\\x7F]"), txt)), txt)


def normal_text(col: Column) -> Column:
    """LF line ends, NFC."""
    return composed(F.regexp_replace(col, "\r\n?", "\n"))


def folded(col: Column, dtype: T.DataType) -> Column:
    """A nested value in one form: LF line ends in all its texts, one zero, maps as entries in order of their keys."""
    if isinstance(dtype, T.StringType):
        return F.regexp_replace(col, "\r\n?", "\n")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(col == 0, F.lit(0.0)).otherwise(col)
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda x: folded(x, dtype.elementType))
    if isinstance(dtype, T.StructType):
        return F.when(col.isNotNull(), F.struct(*[folded(col[f.name], f.dataType).alias(f.name) for f in dtype.fields]))
    if isinstance(dtype, T.MapType):
        entries = F.transform(F.map_entries(col), lambda e: F.struct(folded(e["key"], dtype.keyType).alias("key"), folded(e["value"], dtype.valueType).alias("value")))
        return F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    return col


def field_text(name: str, dtype: T.DataType, nfc: bool = True) -> Column:
    """Canonical text of one field; null keeps its own marker so that '' and null differ."""
    col = F.col(name)
    if isinstance(dtype, T.StringType):
        txt = normal_text(col) if nfc else F.regexp_replace(col, "\r\n?", "\n")
    elif isinstance(dtype, (T.DoubleType, T.FloatType)):
        txt = F.when(col == 0, F.lit(0.0)).otherwise(col).cast("string")
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        txt = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    elif isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        txt = F.to_json(folded(col, dtype), {"ignoreNullFields": "false"})
        txt = composed(txt) if nfc else txt
    else:
        txt = col.cast("string")
    return F.coalesce(escaped(txt), F.lit(NULL))


def escaped(txt: Column) -> Column:
    """A backslash before each backslash, separator and null mark, so that joined parts can be told apart again."""
    return F.regexp_replace(txt, "([\\\\\\x1f\\x00])", "\\\\$1")


def canonical(df: DataFrame, cols: list[str] | None = None, nfc: bool = True) -> Column:
    """P2. Scheme tag, then ``name=value`` by sorted name. Observation-time fields never take part."""
    types = {f.name: f.dataType for f in df.schema.fields}
    names = sorted(n for n in (cols or df.columns) if n not in OBSERVATION_FIELDS)
    parts = [F.lit(SCHEME)] + [F.concat(F.lit(n + "="), field_text(n, types[n], nfc)) for n in names]
    return F.concat_ws(SEP, *parts)


def with_hash(df: DataFrame, cols: list[str] | None = None, out: str = "object_sha256", nfc: bool = True) -> DataFrame:
    """P3. SHA-256 of the canonical text."""
    return df.withColumn(out, F.sha2(canonical(df, cols, nfc), 256))


HASHED, PLAIN = bytearray(b"\x00"), bytearray(b"\x01")  # first byte of a packed id


def packed(x) -> Column:
    """An id on its way through shuffles: a SHA-256 in hex as its 32 bytes, any other text as it is, after a byte that tells which.
    Ids are equal if they are packed, and of one kind they keep their order."""
    t = c(x)
    return F.when(t.rlike("\\A[0-9a-f]{64}\\z"), F.concat(F.lit(HASHED), F.unhex(t))).otherwise(F.concat(F.lit(PLAIN), t.cast("binary")))


def is_hash(x) -> Column:
    """Whether a packed id is a SHA-256; not of null."""
    return F.coalesce(F.substring(c(x), 1, 1) == F.lit(HASHED), F.lit(False))


def unpacked(x) -> Column:
    """The id again."""
    rest = F.substring(c(x), 2, 2**31 - 1)
    return F.when(is_hash(x), F.lower(F.hex(rest))).otherwise(rest.cast("string"))


def verify_hash(df: DataFrame, cols: list[str], stored: str = "object_sha256", nfc: bool = True) -> DataFrame:
    """P5. Rows whose stored hash is not the hash of their content."""
    return df.withColumn("recomputed_sha256", F.sha2(canonical(df, cols, nfc), 256)).filter(
        ~F.col("recomputed_sha256").eqNullSafe(F.col(stored)))


def table_digest(df: DataFrame, keys: list[str], hash_col: str = "object_sha256", levels: tuple[int, ...] = (6, 3)) -> DataFrame:
    """P4. One digest per key, the same for any row order or partitioning.

    Copies are counted before anything is collected, so a hot row is one entry. Hashes are then folded by
    prefix, longest first; each fold collects only the distinct hashes that share a prefix (uniform by
    construction), so a level of n hex digits splits a key over 16**n groups.
    """
    leaf = (
        df.groupBy(*keys, hash_col).agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, F.col(hash_col).alias("_p"), F.concat_ws(":", hash_col, "_n").alias("_v"), F.col("_n"))
    )
    for width in levels + (0,):
        leaf = (
            leaf.groupBy(*keys, F.substring("_p", 1, width).alias("_p"))
            .agg(F.sha2(F.array_join(F.array_sort(F.collect_list("_v")), ","), 256).alias("_d"), F.sum("_n").alias("_n"))
            .select(*keys, "_p", F.concat_ws(":", "_p", "_d").alias("_v"), "_n", "_d")
        )
    return leaf.select(*keys, F.col("_n").cast("long").alias("row_count"), F.col("_d").alias("digest_sha256"))
