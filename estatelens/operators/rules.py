"""Row rules: contracts, scope, gates, names, disclosure and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contracts import AMBIENT_SCHEMAS, COVERAGE_STATES, POSTGRES_TYPE_FAMILY, REASON_CODE
from ..functions.scalars import c, domain_map, flags


def column_contract(df: DataFrame, spec: T.StructType) -> list[str]:
    """P1, schema part: missing, unexpected and mistyped columns."""
    have, want = {f.name: f.dataType for f in df.schema.fields}, {f.name: f.dataType for f in spec.fields}
    return sorted(
        [f"MISSING:{n}" for n in want if n not in have] + [f"UNEXPECTED:{n}" for n in have if n not in want]
        + [f"TYPE:{n}" for n in want if n in have and have[n] != want[n]])


def check_contract(extracts: DataFrame) -> DataFrame:
    """P1, row part: one row per broken rule of an extract's state, reason and row count."""
    s, r = F.col("state"), F.col("reason_code")
    broken = flags(
        (~F.coalesce(s.isin(COVERAGE_STATES), F.lit(False)), "STATE_UNKNOWN"),
        ((s == "SUCCEEDED") & r.isNotNull(), "REASON_ON_SUCCESS"),
        ((s != "SUCCEEDED") & ~F.coalesce(r.rlike(REASON_CODE), F.lit(False)), "REASON_MISSING"),
        (~s.isin("SUCCEEDED", "PARTIAL") & (F.col("row_count") > 0), "ROWS_IN_INVISIBLE_STATE"),
        (F.col("row_count") < 0, "ROW_COUNT_NEGATIVE"))
    return extracts.withColumn("violation", F.explode(broken))


def in_scope(df: DataFrame, scope: DataFrame, on: list[str] = ["schema_name"]) -> DataFrame:
    """P6. Keep rows of declared schemas; the scope list is metadata-sized."""
    return df.join(scope.select(*on).distinct(), on, "left_semi")


def drop_ambient(df: DataFrame, declared: DataFrame) -> DataFrame:
    """P7. Built-in principal schemas go, unless a profile declares them."""
    d = declared.select("schema_name", F.lit(True).alias("_declared")).distinct()
    return df.join(d, ["schema_name"], "left").filter(
        F.col("_declared").isNotNull() | ~F.col("schema_name").isin(AMBIENT_SCHEMAS)).drop("_declared")


def scope_violations(df: DataFrame, scope: DataFrame) -> DataFrame:
    """P8. Rows outside scope, and foreign keys that point outside it."""
    s = scope.select("schema_name").distinct()
    own = df.join(s, ["schema_name"], "left_anti").withColumn("violation", F.lit("OUT_OF_SCOPE"))
    if "referenced_schema_name" not in df.columns:
        return own
    ref = df.filter("referenced_schema_name is not null")
    ref = ref.join(s.withColumnRenamed("schema_name", "referenced_schema_name"), ["referenced_schema_name"], "left_anti")
    return own.unionByName(ref.withColumn("violation", F.lit("REFERENCE_OUT_OF_SCOPE")))


TARGET_KEYS = ["schema_name", "relation_name", "column_name"]


def allowed_targets(targets: DataFrame, allow: DataFrame, sensitive: DataFrame) -> DataFrame:
    """P9. Verdict per target; a sensitive target is denied even when allowlisted."""
    a = allow.select(*TARGET_KEYS, F.lit(True).alias("_a")).distinct()
    s = sensitive.select(*TARGET_KEYS, F.lit(True).alias("_s")).distinct()
    return targets.join(a, TARGET_KEYS, "left").join(s, TARGET_KEYS, "left").withColumn(
        "verdict", F.when(F.col("_s").isNotNull(), "SENSITIVE_DENIED").when(F.col("_a").isNull(), "NOT_ALLOWLISTED").otherwise("ALLOWED")).drop("_a", "_s")


def type_family(native) -> Column:
    """P10. Family of a native type name; null for a type no profile method supports."""
    return domain_map(F.lower(c(native)), POSTGRES_TYPE_FAMILY)


def declared_family(declared) -> Column:
    """P10 for free declared type text: the first family whose word occurs."""
    u = F.upper(c(declared))
    return (F.when(u.rlike("INT|REAL|FLOA|DOUB|NUM|DEC"), "numeric").when(u.rlike("DATE|TIME"), "temporal")
            .when(u.rlike("CHAR|CLOB|TEXT"), "text").otherwise("other"))


# fixed values: where the object name of a category comes from, first non-null wins
OBJECT_NAME = {
    "schemas": ["schema_name"], "relations": ["relation_name"], "columns": ["column_name"],
    "comments": ["column_name", "relation_name"], "constraints": ["constraint_name"], "indexes": ["index_name"],
    "sequences": ["sequence_name"], "synonyms": ["synonym_name"],
    "partitions": ["subpartition_name", "partition_name", "relation_name"], "lobs": ["segment_name", "column_name"],
    "tablespaces": ["tablespace_name"], "statistics": ["index_name", "relation_name"], "sizes": ["segment_name"],
    "stored-objects": ["object_name"], "stored-arguments": ["argument_name", "subprogram_name", "object_name"],
    "stored-errors": ["object_name"], "stored-dependencies": ["source_object_name"], "dependencies": ["source_relation_name"],
    "operations": ["object_name", "relation_name"], "db-links": ["db_link_name"],
}


def ref_columns(df: DataFrame, category: str) -> list[Column]:
    """Category, schema, relation, column and object name of a category's rows, whatever it calls them."""
    def first(*names):
        have = [F.col(n).cast("string") for n in names if n in df.columns]
        return F.coalesce(*have) if have else F.lit(None).cast("string")
    return [
        F.lit(category).alias("category"),
        first("schema_name", "source_schema_name", "owner_name").alias("schema_name"),
        first("relation_name", "source_relation_name", "trigger_table_name").alias("relation_name"),
        first("column_name", "source_column_name").alias("column_name"),
        first(*OBJECT_NAME[category]).alias("object_name")]


def object_ref(df: DataFrame, category: str) -> DataFrame:
    """P12. Uniform (schema_name, relation_name, column_name, object_name) of any category's rows."""
    return df.select(*ref_columns(df, category))


# --- disclosure: fixed patterns, as published; the connection part of the secret values is a rule of its own, so that a
# finding says which of the two it is ------------------------------------------------------------------
SECRET_VALUE = r"(?i)(?:ghp_[A-Za-z0-9_]{20,}|sk-[A-Za-z0-9]{20,}|hf_[A-Za-z0-9]{20,}|Bearer\s+[A-Za-z0-9._~+/-]{16,}|Basic\s+[A-Za-z0-9+/=]{16,}|BEGIN (?:RSA |EC )?PRIVATE KEY)"
CONNECTION = r"(?i)(?:jdbc:|oracle:|mssql:|postgres(?:ql)?:\/\/)[^\s]+"
RAW_SQL = r"(?i)\b(?:select\s+[\s\S]{0,160}\sfrom|insert\s+into|update\s+[A-Za-z0-9_.]+\s+set|delete\s+from|drop\s+(?:table|view)|alter\s+(?:table|view)|create\s+(?:table|view)|merge\s+into)\b"
DENIED_TEXT = (
    r"(?i)(\b(insert|update|delete|merge|drop|alter|create|truncate|grant|revoke|exec(ute)?|dbcc|backup|restore)\b"
    r"|\braw\s+sql\b|password|credential|api[_ -]?key|ignore\s+(all\s+)?previous|system\s+prompt)")
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
SECRET_KEY = r"(?i)^(?:authorization|cookie|set-cookie|password|passwd|secret|token|api[_-]?key|credential|credentials|client[_-]?secret|connection_uri|sqlalchemy_uri)$"
ROW_KEY = r"(?i)^(?:rows?|records?|sample_data|row_values|result_set|raw_data)$"
SQL_KEY = r"(?i)^(?:sql|raw_sql|query_text|statement|sqla_query)$"
UNSAFE_KEYS = [
    "password", "passwd", "credential", "credentials", "secret", "token", "api_key", "connection_string", "dsn",
    "sql", "query", "raw_value", "raw_row", "source_row", "sample_value", "example_value"]


def disclosure_flags(text) -> Column:
    """P13. Labels of the rules a text breaks, over the whole text."""
    t = c(text)
    return flags((t.rlike(SECRET_VALUE), "SECRET_VALUE"), (t.rlike(CONNECTION), "CONNECTION_STRING"), (t.rlike(RAW_SQL), "RAW_SQL"),
                 (t.rlike(DENIED_TEXT), "DENIED_TEXT"), (t.rlike(CONTROL), "CONTROL_CHARACTER"))


def disclosure_scan(df: DataFrame, text_cols: list[str]) -> DataFrame:
    """P13. One narrow pass, no shuffle: a flag array per text column."""
    return df.withColumns({x + "_flags": disclosure_flags(x) for x in text_cols})


def snake_key(key) -> Column:
    """camelCase, spaces, dots and dashes to lower snake_case."""
    return F.lower(F.regexp_replace(F.regexp_replace(c(key), "([a-z0-9])([A-Z])", "$1_$2"), "[ .-]+", "_"))


def key_flags(json_text) -> Column:
    """P13 for the top-level keys of a JSON object: secrets, row material, SQL, and the evidence denylist."""
    keys = F.json_object_keys(c(json_text))
    return flags(
        (F.exists(keys, lambda k: k.rlike(SECRET_KEY)), "SECRET_KEY"), (F.exists(keys, lambda k: k.rlike(ROW_KEY)), "SOURCE_ROW_KEY"),
        (F.exists(keys, lambda k: k.rlike(SQL_KEY)), "RAW_SQL_KEY"), (F.exists(keys, lambda k: snake_key(k).isin(UNSAFE_KEYS)), "UNSAFE_EVIDENCE_KEY"))


# --- routing: fixed rules, first match wins ---------------------------------------------------------
INTENT_RULES = [
    ("largest_tables", "(?i)(größte|largest|size|capacity|bytes|block|verteilung)"),
    ("row_estimates_freshness", "(?i)(row|zeilen|estimate|schätz|fresh|stale|statist)"),
    ("object_inventory_validity", "(?i)(inventory|inventar|valid|invalid|compile|schema|object|objekt)"),
    ("dependencies", "(?i)(depend|abhäng|impact|uses|verwendet|nutzt|benutzt)"),
    ("stored_logic_signatures", "(?i)(signature|signatur|argument|stored|procedure|function|package|logic|code)"),
    ("scheduler_mv_refresh", r"(?i)(scheduler|job|materialized|mview|refresh|mv\b)"),
    ("coverage_blind_spots", "(?i)(coverage|blind|denied|timeout|partial|caveat|abdeckung|lücke)"),
    ("bi_relevance_candidates", "(?i)(candidate|kandidat|bi[- ]?relev|dimension|measure|kennzahl)"),
]
# fixed patterns
TASK_RULES = [
    ("persistent_apply", "delete|drop|publish|apply|persist"),
    ("visualization", "dashboard|visual|chart|layout"),
    ("relationship_cause", "root.?cause|relationship|driver|correlat"),
    ("anomaly_quality", "anomal|quality|defect|outlier|missing|duplicate"),
    ("sql", "sql|query|filter"),
    ("repair", "repair|correct|retry|critique"),
    ("synthesis", "summary|recommend|executive|synthesi"),
]
# fixed pattern
OBJECT_MENTION = (
    r"(?i)\b(?:object|objekt|table|tabelle|uses|verwendet|nutzt|impact|dependencies|abhängigkeiten|signatures?|signaturen?)"
    r"\s+([A-Za-z][A-Za-z0-9_$#]*(?:\.[A-Za-z][A-Za-z0-9_$#]*)?)")


def first_rule(text: Column, rules, default=None) -> Column:
    out = None
    for label, pattern in rules:
        hit = text.rlike(pattern)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(F.lit(default))


def route_intent(df: DataFrame, text_col: str) -> DataFrame:
    """P16. Question family, mentioned object and task class of an utterance."""
    mention = F.regexp_extract(text_col, OBJECT_MENTION, 1)
    return df.withColumns({
        "family": first_rule(F.col(text_col), INTENT_RULES),
        "mentioned_object": F.when(mention != "", mention),
        "task_class": first_rule(F.lower(text_col), TASK_RULES, "extraction")})


# fixed patterns: words of names that hint at a role
TIME_HINT = "(?i)(date|time|period|month|year|created|updated)"
MEASURE_HINT = "(?i)(amount|total|qty|quantity|count|price|cost|value|measure)"
DIMENSION_HINT = "(?i)(id|key|code|type|status|category|name)"
GUIDE_TIME = "(?i)(date|time|period|month|year|created|updated|modified)"
GUIDE_KPI = "(?i)(amount|total|qty|quantity|count|price|cost|value|measure|revenue|sales|margin)"
GUIDE_DIMENSION = "(?i)(id|key|code|type|status|category|name|region|customer|product|department)"


def name_hints(columns: DataFrame, col: str = "column_name") -> DataFrame:
    """P20."""
    return columns.withColumns({
        "time_hint": F.col(col).rlike(TIME_HINT), "measure_hint": F.col(col).rlike(MEASURE_HINT), "dimension_hint": F.col(col).rlike(DIMENSION_HINT)})


# fixed pattern: actions that write
WRITE_LIKE = "(?i)(write|import|export|promot|publish|materialize|dataset|chart|dashboard|zip)"


def freshness_gate(df: DataFrame, now, contract_version: str, default_max_age: int = 86_400) -> DataFrame:
    """P21. Planning gate over fingerprints; any reason blocks, else a write-like action waits for review.

    Columns: contract_version, compatibility, observed_at, max_age_seconds, content_sha256, canonical_sha256,
    expected_sha256, target, expected_target, action.
    """
    t = F.lit(now).cast("timestamp") if not isinstance(now, Column) else now
    age = F.unix_micros(t) - F.unix_micros(F.col("observed_at").cast("timestamp"))
    reasons = flags(
        (~F.col("contract_version").eqNullSafe(F.lit(contract_version)), "CONTRACT_DENIED"),
        (~F.col("compatibility").eqNullSafe(F.lit("compatible")), "INCOMPATIBLE"),
        (F.col("observed_at").isNull() | (age > F.coalesce("max_age_seconds", F.lit(default_max_age)).cast("long") * 1_000_000), "STALE"),
        (F.col("content_sha256").isNull() | ~F.col("content_sha256").eqNullSafe(F.col("canonical_sha256")), "HASH_MISMATCH"),
        (F.col("expected_sha256").isNotNull() & ~F.col("expected_sha256").eqNullSafe(F.col("content_sha256")), "CONTENT_DRIFT"),
        (F.col("expected_target").isNotNull() & ~F.col("expected_target").eqNullSafe(F.col("target")), "TARGET_MISMATCH"))
    return df.withColumn("reasons", reasons).withColumn("status", F.when(F.size("reasons") > 0, "BLOCKED").when(
        F.col("action").rlike(WRITE_LIKE), "READY_FOR_REVIEW").otherwise("ALLOWED_READ_ONLY"))
