"""Collectors: conforming jobs over landed raw catalog tables.

A catalog holds raw tables by name. ``by`` names the columns that tell sources (and snapshots) apart when many
databases are landed together; they join every join and lead every output, so one job serves a whole estate.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...contracts import EXTRACT_SCHEMAS
from ...functions.scalars import c


def shape(df: DataFrame, by: list[str], spec: str) -> DataFrame:
    """Exactly the declared columns, cast; what a source lacks is a typed null."""
    cols = []
    for item in spec.split(","):
        name, kind = item.split()
        cols.append((F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name))
    return df.select(*by, *cols)


def conform(df: DataFrame, category: str, by: list[str] = ()) -> DataFrame:
    """Shared schema of a category, so that engines union into one estate table."""
    spec = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in EXTRACT_SCHEMAS[category].fields)
    return shape(df, list(by), spec)


class Catalog:
    def __init__(self, raw: Mapping[str, DataFrame], by: list[str] = ()):
        self.raw, self.by = raw, list(by)

    def t(self, table: str, **cols) -> DataFrame:
        """Columns of a raw table under new names: new=old, or new=expression."""
        return self.raw[table].select(*self.by, *[c(e).alias(n) for n, e in cols.items()])

    def join(self, a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
        return a.join(b, self.by + on, how)

    def beside(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """Rows of a with the session facts b of their source."""
        if not self.by:
            raise ValueError("session-level collectors need the column that names the source")
        return a.join(b, self.by)

    def out(self, df: DataFrame, spec: str) -> DataFrame:
        return shape(df, self.by, spec)


@dataclass(frozen=True)
class Collector:
    query_id: str
    category: str
    scope_column: str | None
    sort_keys: tuple[str, ...]
    timeout_seconds: int
    run: Callable[[Catalog], DataFrame]


def seconds(x) -> Column:
    """ISO text to the second."""
    return F.date_format(c(x), "yyyy-MM-dd'T'HH:mm:ss")


def millis(x) -> Column:
    """ISO text, with milliseconds only where there are any."""
    full = F.date_format(c(x), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    return F.regexp_replace(full, r"\.000$", "")


def case(x, mapping: dict, default=None) -> Column:
    col = c(x)
    out = None
    for k, v in mapping.items():
        hit = col.isin(list(k)) if isinstance(k, tuple) else col == k
        out = F.when(hit, v) if out is None else out.when(hit, v)
    return out if default is None else out.otherwise(default)


CONSTRAINTS = ("schema_name string, relation_name string, constraint_name string, constraint_kind string, column_name string, ordinal_position int, "
               "referenced_schema_name string, referenced_relation_name string, referenced_column_name string, check_expression string, delete_rule string, update_rule string, "
               "is_enabled boolean, is_validated boolean, is_deferrable boolean, is_initially_deferred boolean")
COLUMNS = ("schema_name string, relation_name string, relation_kind string, column_name string, ordinal_position bigint, data_type_schema string, data_type string, max_length int, "
           "numeric_precision int, numeric_scale int, is_nullable boolean, default_expression string, generation_kind string, generation_expression string, is_identity boolean, "
           "identity_seed string, identity_increment string, identity_generation string, identity_options string")
INDEXES = ("schema_name string, relation_name string, index_name string, index_kind string, column_name string, ordinal_position int, column_expression string, is_included boolean, "
           "is_partition_key boolean, partition_ordinal int, is_unique boolean, is_primary_key boolean, is_unique_constraint boolean, is_enabled boolean, filter_expression string, "
           "data_space_name string, partitioning_kind string, partition_count bigint")
SEQUENCES = ("schema_name string, sequence_name string, data_type string, numeric_precision int, numeric_scale int, start_value string, increment_by string, min_value string, max_value string, "
             "is_cycling boolean, cache_size bigint, observed_value string, observed_value_semantics string")
SYNONYMS = "schema_name string, synonym_name string, target_reference string, target_catalog_name string, target_schema_name string, target_object_name string, remote_locator string"
IDENTITY = "engine string, engine_version string, engine_edition string, database_name string, container_name string, compatibility_level int"
