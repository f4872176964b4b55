"""Audit of statement logs and table references in SQL text, by pattern functions on whole texts."""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import c

# --- fixed values -----------------------------------------------------------------------------------
DENIED_TOKENS = [
    "ALTER", "BACKUP", "BEGIN", "BULK", "CALL", "CREATE", "DBCC", "DELETE", "DENY", "DROP", "EXEC", "EXECUTE", "GRANT", "INSERT",
    "MERGE", "OPENROWSET", "OPENDATASOURCE", "RESTORE", "REVOKE", "SET", "TRUNCATE", "UPDATE", "USE"]
CATALOG_SOURCES = {
    "mssql": [
        "SYS.CHECK_CONSTRAINTS", "SYS.COLUMNS", "SYS.COMPUTED_COLUMNS", "SYS.DATABASES", "SYS.DATA_SPACES", "SYS.DEFAULT_CONSTRAINTS",
        "SYS.FOREIGN_KEYS", "SYS.FOREIGN_KEY_COLUMNS", "SYS.IDENTITY_COLUMNS", "SYS.INDEX_COLUMNS", "SYS.INDEXES", "SYS.KEY_CONSTRAINTS",
        "SYS.OBJECTS", "SYS.PARTITIONS", "SYS.PARTITION_SCHEMES", "SYS.SCHEMAS", "SYS.SEQUENCES", "SYS.SQL_EXPRESSION_DEPENDENCIES",
        "SYS.SQL_MODULES", "SYS.SYNONYMS", "SYS.TABLES", "SYS.TRIGGERS", "SYS.TYPES"],
    "oracle": [
        "ALL_ARGUMENTS", "ALL_COL_COMMENTS", "ALL_COL_PRIVS", "ALL_CONSTRAINTS", "ALL_CONS_COLUMNS", "ALL_DB_LINKS", "ALL_DEPENDENCIES",
        "ALL_ERRORS", "ALL_INDEXES", "ALL_IND_COLUMNS", "ALL_IND_EXPRESSIONS", "ALL_IND_STATISTICS", "ALL_LOBS", "ALL_MVIEWS", "ALL_OBJECTS",
        "ALL_PART_INDEXES", "ALL_PART_KEY_COLUMNS", "ALL_PART_TABLES", "ALL_SCHEDULER_JOBS", "ALL_SCHEDULER_PROGRAMS", "ALL_SCHEDULER_SCHEDULES",
        "ALL_SEGMENTS", "ALL_SEQUENCES", "ALL_SOURCE", "ALL_SYNONYMS", "ALL_TABLES", "ALL_TABLESPACES", "ALL_TAB_COLS", "ALL_TAB_COLUMNS",
        "ALL_TAB_COMMENTS", "ALL_TAB_IDENTITY_COLS", "ALL_TAB_PARTITIONS", "ALL_TAB_STATISTICS", "ALL_TAB_SUBPARTITIONS", "ALL_TRIGGERS",
        "ALL_TAB_PRIVS", "PRODUCT_COMPONENT_VERSION", "ROLE_TAB_PRIVS", "SESSION_PRIVS", "SESSION_ROLES"],
    "postgresql": [
        "INFORMATION_SCHEMA.COLUMNS", "INFORMATION_SCHEMA.REFERENTIAL_CONSTRAINTS", "INFORMATION_SCHEMA.TABLES",
        "INFORMATION_SCHEMA.TABLE_CONSTRAINTS", "PG_CATALOG.PG_ATTRIBUTE", "PG_CATALOG.PG_CLASS", "PG_CATALOG.PG_CONSTRAINT",
        "PG_CATALOG.PG_DEPEND", "PG_CATALOG.PG_NAMESPACE", "PG_CATALOG.PG_REWRITE", "PG_CATALOG.PG_ROLES", "PG_CATALOG.PG_SETTINGS", "PG_CATALOG.PG_TYPE"],
}

_STRING = r"'[^']*+(?:''[^']*+)*+'"
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"|\[[^\]]*+(?:\]\][^\]]*+)*+\]'
_LINE = r"--[^\n]*+"
_BLOCK = r"/\*(?:[^*]++|\*(?!/))*+\*/"
_MASK = f"{_STRING}|{_LINE}|{_BLOCK}|({_QUOTED})"
_NESTED = r"/\*(?:(?!\*/)[\s\S])*?/\*"
_TOKEN = r"([A-Za-z_][A-Za-z0-9_$#]*|[0-9]+|[().,;*])"
_IDENT = "^[A-Z_][A-Z0-9_$#]*$"
_NAME = r"[A-Za-z_][\w$#]*(?:\s*\.\s*[A-Za-z_][\w$#]*)*"
_CLAUSE = (r"(?:WHERE|GROUP|ORDER|HAVING|UNION|EXCEPT|MINUS|INTERSECT|LIMIT|OFFSET|FETCH|FOR|WINDOW|QUALIFY|CONNECT|START|ON|USING|WITH"
           r"|JOIN|INNER|LEFT|RIGHT|FULL|CROSS|OUTER|NATURAL|SELECT|FROM)\b")
_TABLE = rf"{_NAME}(?:\s+(?:AS\s+)?(?!{_CLAUSE})[A-Za-z_][\w$#]*)?"
#: Plain names after FROM or JOIN, one or a comma-separated list, each with an alias or without.
_TABLES = rf"(?i)\b(?:FROM|JOIN)\s+({_TABLE}(?:\s*,\s*{_TABLE})*)"
_INSIDE = r"[^()]*+"
for _ in range(8):  # parentheses in parentheses
    _INSIDE = rf"(?:[^()]++|\({_INSIDE}\))*+"
#: A comma between the sources of a FROM clause, outside of parentheses.
_COMMA_SOURCES = (rf"(?i)\bFROM\b(?:(?!\b(?:WHERE|GROUP|ORDER|HAVING|UNION|EXCEPT|MINUS|INTERSECT|LIMIT|OFFSET|FETCH|FOR|WINDOW|QUALIFY|CONNECT|START)\b)"
                  rf"[^(),;]|\({_INSIDE}\))*+,")
#: FROM as a word of a call (``extract(year from x)``), and a call where a table would stand.
_FROM_IN_CALL = rf"(?i)\((?!\s*(?:SELECT|WITH|VALUES)\b)(?:[^()]|\({_INSIDE}\))*?\bFROM\b"
#: Quoted names that are plain words; the others are marked by ?, also where a table stands.
_PLAIN = r'(?<!")"([A-Za-z_][\w$#]*)"(?!")|\[([A-Za-z_][\w$#]*)\](?!\])'
_ODD_SOURCE = rf"(?i)\b(?:FROM|JOIN)\s+(?:{_NAME}\s*\.\s*)?\?"
_CALL_AS_SOURCE = rf"(?i)\b(?:FROM|JOIN)\s+{_NAME}\s*\("
DYNAMIC =r"(?i)\b(?:sp_executesql|EXEC(?:UTE)?\s*\(|EXECUTE\s+IMMEDIATE)\b"


@F.pandas_udf(T.StringType())
def _unnest_comments(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Blank out nested block comments; an unclosed one swallows the rest and leaves its opening mark."""
    import re
    skip = re.compile(r"'(?:[^']|'')*'|--[^\n]*|\"(?:[^\"]|\"\")*\"|\[(?:[^\]]|\]\])*\]|/\*")
    mark = re.compile(r"/\*|\*/")

    def one(t):
        if t is None:
            return None
        out, at = [], 0
        while (m := skip.search(t, at)) is not None:
            if m.group() != "/*":
                out.append(t[at:m.end()])
                at = m.end()
                continue
            depth, pos = 1, m.end()
            while depth and (k := mark.search(t, pos)) is not None:
                depth += 1 if k.group() == "/*" else -1
                pos = k.end()
            if depth:
                return "".join(out) + t[at:m.start()] + " /* "
            out.append(t[at:m.start()] + " ")
            at = pos
        return "".join(out) + t[at:]

    for s in batches:
        yield s.map(one)


def masked(sql) -> Column:
    """Text without literals and comments; quoted names stay quoted. Only nested comments visit Python."""
    t = c(sql)
    t = F.coalesce(_unnest_comments(F.when(t.rlike(_NESTED), t)), t)
    return F.regexp_replace(t, _MASK, " $1 ")


def _names(mask: Column) -> Column:
    q = F.regexp_extract_all(mask, F.lit(f"({_QUOTED})"), F.lit(1))
    return F.transform(q, lambda x: F.substring(x, F.lit(2), F.length(x) - 2))


def audit_sql(df: DataFrame, sql_col: str, engine_col: str = "engine") -> DataFrame:
    """P14. Verdict per statement, the catalog sources it reads and how many derived tables it has.

    The first rule broken is the verdict: lexical form, SELECT only, no mutating or privileged word, one statement,
    no ``SELECT *``, a source present and well formed (a list by comma is not), and every source on the engine's allowlist. Row-wise, no shuffle.
    """
    d = df.withColumn("_m", masked(sql_col))
    bare = F.regexp_replace("_m", r'["\[\]]', " ")
    d = d.withColumn("_lex", F.coalesce(F.regexp_replace("_m", _QUOTED, " ").rlike(r"""['"\[]|/\*"""), F.lit(False))
                     | F.exists(_names(F.col("_m")), lambda x: ~x.rlike("^[A-Za-z_][A-Za-z0-9_$#]*$")))
    d = d.withColumn("_t", F.regexp_extract_all(F.upper(bare), F.lit(_TOKEN), F.lit(1)))
    n = F.size("_t")
    tok = lambda i: F.get(F.col("_t"), i)
    at = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: tok(i).isin("FROM", "JOIN"))
    src = F.transform(at, lambda i: F.when((tok(i + 1) == "(") & tok(i + 2).isin("SELECT", "VALUES"), F.lit("(derived)"))
                      .when(~F.coalesce(tok(i + 1).rlike(_IDENT), F.lit(False)), F.lit("(boundary)"))
                      .when((tok(i + 2) == ".") & F.coalesce(tok(i + 3).rlike(_IDENT), F.lit(False)), F.concat(tok(i + 1), F.lit("."), tok(i + 3)))
                      .otherwise(tok(i + 1)))
    d = d.withColumn("_s", F.when(n > 0, src).otherwise(F.array().cast("array<string>")))
    semis = F.size(F.filter("_t", lambda x: x == ";"))
    star = F.exists(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (tok(i) == "SELECT") & (tok(i + 1) == "*"))
    named = F.filter("_s", lambda x: ~x.isin("(derived)", "(boundary)"))
    allow = F.create_map(*[y for k, v in CATALOG_SOURCES.items() for y in (F.lit(k), F.array(*[F.lit(x) for x in v]))])
    verdict = (
        F.when(F.col(sql_col).isNull() | (F.col(sql_col) == ""), "SQL_INVALID").when(F.col("_lex"), "LEXICAL_INVALID")
        .when((n == 0) | (tok(F.lit(0)) != "SELECT"), "SELECT_ONLY_DENIED")
        .when(F.arrays_overlap("_t", F.array(*[F.lit(x) for x in DENIED_TOKENS + ["INTO"]])), "MUTATION_DENIED")
        .when((semis > 1) | ((semis == 1) & (F.element_at("_t", -1) != ";")), "MULTI_STATEMENT_DENIED").when(star, "WILDCARD_DENIED")
        .when(F.array_contains("_s", "(boundary)") | bare.rlike(_COMMA_SOURCES), "SOURCE_BOUNDARY_DENIED").when(F.size("_s") == 0, "CATALOG_SOURCE_MISSING")
        .when(F.exists(named, lambda x: ~F.coalesce(F.array_contains(allow[F.col(engine_col)], x), F.lit(False))), "ROW_SOURCE_DENIED").otherwise("ALLOWED"))
    return d.withColumns({
        "verdict": verdict, "sources": F.array_sort(F.array_distinct(named)), "derived_sources": F.size(F.filter("_s", lambda x: x == "(derived)")).cast("long")}).drop("_m", "_lex", "_t", "_s")


def sql_table_refs(df: DataFrame, sql_col: str, id_cols: list[str]) -> DataFrame:
    """P15. One row per table a SELECT reads, or one row with the gap class of a text that cannot be read.

    Dynamic SQL and anything but a single SELECT with a table are gaps, never edges; edges stay inferred. So are quoted
    tables that are no plain words, FROM inside a call, a call in place of a table, and lists by comma that hold anything but plain names.
    """
    # each step is a column of its own: functions of arrays are not compiled and would work out again all that stands in them
    bare, refs = F.col("_b"), F.col("_r")
    d = df.withColumn("_b", F.regexp_replace(F.regexp_replace(F.regexp_replace(masked(sql_col), _PLAIN, " $1$2 "), _QUOTED, " ? "), r'["\[\]`]', " "))
    lists = F.flatten(F.transform(F.regexp_extract_all(bare, F.lit(_TABLES), F.lit(1)), lambda x: F.split(x, r"\s*,\s*")))
    d = d.withColumn("_r", F.array_distinct(F.transform(lists, lambda x: F.regexp_replace(F.regexp_extract(x, f"^{_NAME}", 0), r"\s", ""))))
    parts = F.size(F.filter(F.split(bare, ";"), lambda x: F.length(F.trim(x)) > 0))
    holds = lambda mark: F.contains(bare, F.lit(mark))  # noqa: E731  what a pattern cannot do without is looked for first
    unread = ((holds("?") & bare.rlike(_ODD_SOURCE)) | (holds("(") & (bare.rlike(_FROM_IN_CALL) | bare.rlike(_CALL_AS_SOURCE)))
              | (holds(",") & F.regexp_replace(bare, _TABLES, "FROM x").rlike(_COMMA_SOURCES)))
    gap = F.when(F.col(sql_col).rlike(DYNAMIC), "DYNAMIC_SQL_BLIND_SPOT").when(
        ~F.col(sql_col).rlike(r"(?i)^\s*SELECT\b") | (parts != 1) | (F.size(refs) == 0) | bare.rlike(r"'|/\*") | unread, "UNSUPPORTED_SYNTAX_BLIND_SPOT")
    d = d.select(*id_cols, gap.alias("gap_state"), "_r")
    rows = F.when(F.col("gap_state").isNull(), F.col("_r")).otherwise(F.array(F.lit(None).cast("string")))
    d = d.select(*id_cols, "gap_state", F.explode(rows).alias("ref"))
    p = F.split("ref", r"\.")
    return d.select(*id_cols, "gap_state", F.when(F.size(p) > 1, F.get(p, F.size(p) - 2)).alias("target_schema_name"), F.get(p, F.size(p) - 1).alias("target_object_name"),
                    F.when(F.col("gap_state").isNull(), "INFERRED_PARSER").alias("proof_state"))
