"""Catalog overviews and the fixed question families.

``keys`` names the columns that tell databases and snapshots apart (such as source_id, snapshot_id; never null). They lead
every group and join and come first in the result, so that equal names in two databases never meet.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import c, lit_null
from ..session import measured
from .rules import DIMENSION_HINT, GUIDE_DIMENSION, GUIDE_KPI, GUIDE_TIME, MEASURE_HINT, TIME_HINT, ref_columns

KEY = ["_schema", "_object"]
PART_ROWS = 1_000_000  # of a result that outgrows its input, in one partition


def upper_key(df: DataFrame, schema="schema_name", name="relation_name") -> DataFrame:
    """Join keys of catalog objects are upper-cased."""
    return df.withColumn("_schema", F.upper(F.coalesce(F.col(schema), F.lit("")))).withColumn("_object", F.upper(F.coalesce(F.col(name), F.lit(""))))


def per_object(df: DataFrame, out: str, schema="schema_name", name="relation_name", extra: list[Column] = (), keys: list[str] = ()) -> DataFrame:
    return upper_key(df, schema, name).groupBy(*keys, *KEY).agg(F.count(F.lit(1)).alias(out), *extra)


def latest_per_object(df: DataFrame, cols: list[str], recent: str | Column, schema="schema_name", name="relation_name", keys: list[str] = ()) -> DataFrame:
    """One row per object where a source repeats it: the most recent, ties by content."""
    row = F.struct(*cols)
    tie = F.struct(c(recent).isNotNull().alias("k"), c(recent).alias("r"), F.xxhash64(*cols).alias("h"))
    return upper_key(df, schema, name).groupBy(*keys, *KEY).agg(F.max_by(row, tie).alias("_row")).select(*keys, *KEY, "_row.*")


def facts(categories: dict[str, DataFrame], keys: list[str] = ()) -> DataFrame:
    """All categories as one long table: reference, kind, query id and a JSON detail."""
    def one(cat, df):
        kinds = [F.col(k) for k in ("object_kind", "relation_kind", "constraint_kind", "index_kind") if k in df.columns]
        qid = F.col("query_id") if "query_id" in df.columns else F.lit(cat)
        names = sorted(x for x in df.columns if x != "query_id" and x not in keys)
        return df.select(*keys, *ref_columns(df, cat), F.coalesce(*kinds, lit_null()).alias("object_kind"), qid.alias("query_id"),
                         F.to_json(F.struct(*names)).alias("detail_json"))
    return reduce(DataFrame.unionByName, [one(k, d) for k, d in categories.items()])


def schema_overview(f: DataFrame, keys: list[str] = ()) -> DataFrame:
    """A19. One aggregate over the fact table; a status other than VALID counts as invalid."""
    cat = F.col("category")
    status = F.get_json_object("detail_json", "$.status")
    return f.groupBy(*keys, "schema_name").agg(
        F.count_if(cat == "relations").alias("relation_count"), F.count_if(cat == "columns").alias("column_count"),
        F.count_if(cat == "stored-objects").alias("stored_object_count"),
        F.count_if((cat == "stored-objects") & F.coalesce(status != "VALID", F.lit(False))).alias("invalid_object_count"),
        F.count_if(cat == "stored-errors").alias("compile_issue_count"))


def schema_summary(categories: dict[str, DataFrame], coverage: DataFrame, keys: list[str] = ()) -> DataFrame:
    """A19. The schema overview straight from the categories, with what its scope could not see.

    Every schema that the ``schemas`` category or any other row names has a row. denied_unknown_count: extracts of the scope
    (``keys``) that were denied, timed out, failed or are partial; all_complete: whether there is none and every extract
    succeeded. Only schema names and status travel, no detail.
    """
    def one(cat, df):
        status = F.col("status").cast("string") if "status" in df.columns else lit_null()
        return df.where("schema_name is not null").select(*keys, "schema_name", F.lit(cat).alias("category"), status.alias("status"))

    cat = F.col("category")
    rows = reduce(DataFrame.unionByName, [one(k, d) for k, d in categories.items()])
    g = rows.groupBy(*keys, "schema_name").agg(
        F.count_if(cat == "relations").alias("relation_count"), F.count_if(cat == "columns").alias("column_count"), F.count_if(cat == "stored-objects").alias("stored_object_count"),
        F.count_if((cat == "stored-objects") & F.coalesce(F.col("status") != "VALID", F.lit(False))).alias("invalid_object_count"), F.count_if(cat == "stored-errors").alias("compile_issue_count"))
    dark = coverage.groupBy(*keys).agg(F.count_if(F.col("state").isin(*STATE_RANK)).alias("denied_unknown_count"), F.bool_and(F.col("state") == "SUCCEEDED").alias("all_complete"))
    on = list(keys) or ["_all"]
    if not keys:  # one row for all
        g, dark = g.withColumn("_all", F.lit(0)), dark.withColumn("_all", F.lit(0))
    g = g.join(dark, on, "left").drop("_all")
    return g.withColumn("denied_unknown_count", F.coalesce("denied_unknown_count", F.lit(0)).cast("long")).withColumn("all_complete", F.coalesce("all_complete", F.lit(False)))


def table_capacity(relations: DataFrame, columns: DataFrame, constraints: DataFrame, indexes: DataFrame,
                   statistics: DataFrame, sizes: DataFrame, keys: list[str] = ()) -> DataFrame:
    """A20 with J9. Counts are pre-aggregated per object; unknown bytes stay null.

    Every side is one row per object before it is joined, so no key repeats on the right.
    """
    on = [*keys, *KEY]
    st = latest_per_object(statistics, ["num_rows_estimate", "last_analyzed", "stale_stats", "row_count_semantics"], "last_analyzed", keys=keys)
    sz = latest_per_object(sizes, ["bytes", "blocks", "size_semantics"], "bytes", name="segment_name", keys=keys)
    out = upper_key(relations)
    for df, name in ((columns, "column_count"), (constraints, "constraint_count"), (indexes, "index_count")):
        out = out.join(per_object(df, name, keys=keys), on, "left")
    return out.join(st, on, "left").join(sz, on, "left").select(
        *keys, "schema_name", "relation_name", "relation_kind",
        *[F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("column_count", "constraint_count", "index_count")],
        "num_rows_estimate", "last_analyzed", "stale_stats", "bytes", "blocks", "size_semantics", "row_count_semantics")


def code_dependencies(objects: DataFrame, arguments: DataFrame, errors: DataFrame, deps: DataFrame, keys: list[str] = ()) -> DataFrame:
    """A21. Both ends of the edge list are counted separately."""
    out = upper_key(objects, name="object_name")
    sides = [
        per_object(arguments, "signature_count", name="object_name", keys=keys), per_object(errors, "compile_issue_count", name="object_name", keys=keys),
        per_object(deps, "depends_on_count", "source_schema_name", "source_object_name", keys=keys),
        per_object(deps, "used_by_count", "target_schema_name", "target_object_name", keys=keys)]
    for s in sides:
        out = out.join(s, [*keys, *KEY], "left")
    return out.select(
        *keys, "schema_name", "object_name", "object_kind", "status",
        *[F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("signature_count", "compile_issue_count", "depends_on_count", "used_by_count")],
        "source_line_count", "source_hash_sha256")


def bi_relevance(relations: DataFrame, columns: DataFrame, comments: DataFrame, keys: list[str] = ()) -> DataFrame:
    """A23. Five signals per relation; relations without any are left out."""
    n, on = F.col("column_name"), [*keys, *KEY]
    cols = upper_key(columns).groupBy(*on).agg(
        F.bool_or(n.rlike(TIME_HINT)).alias("_t"), F.bool_or(n.rlike(MEASURE_HINT)).alias("_m"), F.bool_or(n.rlike(DIMENSION_HINT)).alias("_d"))
    com = upper_key(comments).select(*on, F.lit(True).alias("_c")).distinct()
    j = upper_key(relations).join(cols, on, "left").join(com, on, "left")
    signals = F.array_compact(F.array(
        F.when(F.col("_c"), "comment_metadata_present"), F.when(F.col("_d"), "dimension_hint_column"), F.when(F.col("_m"), "measure_hint_column"),
        F.when(F.col("relation_kind").isin("TABLE", "MATERIALIZED_VIEW"), "persisted_relation"), F.when(F.col("_t"), "time_column")))
    return j.withColumn("_s", signals).filter(F.size("_s") > 0).select(
        *keys, "schema_name", "relation_name", "relation_kind", F.size("_s").cast("long").alias("deterministic_score"),
        F.array_join("_s", ", ").alias("signal_summary"), F.lit("DETERMINISTIC_TECHNICAL_CANDIDATE").alias("candidate_label"))


def column_detail(columns: DataFrame, relations: DataFrame, keys: list[str] = ()) -> DataFrame:
    """J8. Relation kind by lookup, else the column's own, else UNKNOWN."""
    kinds = relations.groupBy(*keys, "schema_name", "relation_name").agg(F.min("relation_kind").alias("_k"))  # listed as two kinds: the first by name
    own = F.col("relation_kind") if "relation_kind" in columns.columns else lit_null()
    j = columns.withColumn("_own", own).drop("relation_kind").join(kinds, [*keys, "schema_name", "relation_name"], "left")
    return j.withColumn("relation_kind", F.coalesce("_k", "_own", F.lit("UNKNOWN"))).drop("_k", "_own")


def object_dependencies(deps: DataFrame, objects: DataFrame, keys: list[str] = ()) -> DataFrame:
    """J18. Edges of each wanted object (schema_name, object_name), in both directions."""
    o = objects.select(*keys, "schema_name", "object_name").distinct()
    def side(direction, end):
        keyed = o.select(*keys, F.col("schema_name").alias(f"{end}_schema_name"), F.col("object_name").alias(f"{end}_object_name"))
        return deps.join(keyed, [*keys, f"{end}_schema_name", f"{end}_object_name"], "left_semi").withColumn("direction", F.lit(direction))
    return side("DEPENDS_ON", "source").unionByName(side("USED_BY", "target"))


def resolve(f: DataFrame, names: DataFrame, keys: list[str] = ()) -> DataFrame:
    """P18. Names, with or without a schema, against the catalog: RESOLVED, AMBIGUOUS or NOT_FOUND. Both sides carry ``keys``."""
    objs = f.filter(F.col("category").isin("relations", "stored-objects", "sequences", "synonyms")).select(
        *keys, "schema_name", "object_name", F.upper("object_name").alias("_n")).distinct()
    parts = F.split("name", r"\.")
    two = F.size(parts) == 2
    w = names.select(*keys, "name").distinct().withColumn("_n", F.upper(F.when(two, parts[1]).otherwise(F.col("name")))).withColumn(
        "_s", F.when(two, F.upper(parts[0])))
    # a name many schemas use is one row before any wanted name meets it
    tally = [F.count(F.lit(1)).alias("matches"), F.min(F.struct("schema_name", "object_name")).alias("m")]
    by_both = objs.groupBy(*keys, F.upper("schema_name").alias("_s"), "_n").agg(*tally)
    by_name = by_both.groupBy(*keys, "_n").agg(F.sum("matches").alias("matches"), F.min("m").alias("m"))
    g = w.filter("_s is null").drop("_s").join(by_name, [*keys, "_n"], "left").select(*keys, "name", "matches", "m").unionByName(
        w.filter("_s is not null").join(by_both, [*keys, "_s", "_n"], "left").select(*keys, "name", "matches", "m"))
    g = g.withColumn("matches", F.coalesce("matches", F.lit(0)).cast("long"))
    one = F.col("matches") == 1
    return g.select(*keys, "name", "matches", F.when(one, "RESOLVED").when(F.col("matches") == 0, "NOT_FOUND").otherwise("AMBIGUOUS").alias("status"),
                    F.when(one, F.col("m.schema_name")).alias("schema_name"), F.when(one, F.col("m.object_name")).alias("object_name"))


def search(f: DataFrame, term: str, schemas: list[str] | None = None, limit: int | None = None, keys: list[str] = ()) -> DataFrame:
    """P17. Literal, case-insensitive search (ASCII letters) of names and detail, ordered: all hits, or the first ``limit``."""
    if len(term) < 2 or (limit is not None and limit < 1):
        raise ValueError("search takes a term of two characters or more and a positive limit")
    t = F.lower(F.lit(term))
    src = f if schemas is None else f.filter(F.col("schema_name").isin(schemas))
    hit = reduce(Column.__or__, [F.coalesce(F.lower(x).contains(t), F.lit(False)) for x in ("object_name", "relation_name", "column_name", "detail_json")])
    hits = src.filter(hit).select(*keys, "category", "schema_name", "relation_name", "object_name", "object_kind", "column_name", "query_id").orderBy(
        *keys, "schema_name", F.col("relation_name").asc_nulls_first(), F.col("object_name").asc_nulls_first(), F.col("column_name").asc_nulls_first(),
        "category", F.col("object_kind").asc_nulls_first())
    return hits if limit is None else hits.limit(limit)


def canonical_order(df: DataFrame, keys: list[str]) -> DataFrame:
    """Q12. Declared sort keys, nulls first, then the remaining columns."""
    return df.orderBy(*[F.col(k).asc_nulls_first() for k in keys + [x for x in df.columns if x not in keys]])


STATE_RANK = {"DENIED": 0, "TIMEOUT": 1, "ERROR": 2, "PARTIAL": 3}


def _scoped(df, schemas):
    return df if schemas is None else df.filter(F.col("schema_name").isin(schemas))


def answer(family: str, tables: dict[str, DataFrame], schemas: list[str] | None = None, limit: int | None = None, objects: DataFrame | None = None,
           scope: dict[str, str] | None = None) -> DataFrame:
    """Q1-Q8. One fixed question family over the overview tables.

    All rows, in the family's order, or the first ``limit`` of them for a top-k report.

    tables: capacity (A20), overview (A19), deps, facts, coverage (A22), relevance (A23).
    ``scope`` gives the key values (source_id, snapshot_id) of the one database that is asked, where the tables hold several.
    """
    if limit is not None and limit < 1:
        raise ValueError("an answer holds one row or more")
    found = _answer(family, tables, schemas, objects, scope)
    return found if limit is None else found.limit(limit)


def _answer(family: str, tables: dict[str, DataFrame], schemas: list[str] | None, objects: DataFrame | None, scope: dict[str, str] | None) -> DataFrame:
    for key, value in (scope or {}).items():
        tables = {k: t.filter(F.col(key) == value) for k, t in tables.items()}
    if family == "largest_tables":
        return _scoped(tables["capacity"], schemas).select(
            "schema_name", "relation_name", "relation_kind", "bytes", "blocks", "num_rows_estimate", "size_semantics", "row_count_semantics").orderBy(
            F.col("bytes").desc_nulls_last(), F.col("num_rows_estimate").desc_nulls_last(), "schema_name", "relation_name")
    if family == "row_estimates_freshness":
        return _scoped(tables["capacity"], schemas).select(
            "schema_name", "relation_name", "relation_kind", "num_rows_estimate", "last_analyzed", "stale_stats", "row_count_semantics").orderBy(
            F.col("last_analyzed").asc_nulls_last(), "schema_name", "relation_name")
    if family == "object_inventory_validity":
        return _scoped(tables["overview"], schemas).orderBy("schema_name")
    if family == "dependencies":
        return object_dependencies(tables["deps"], objects).orderBy(
            "direction", "source_schema_name", "source_object_name", "target_schema_name", "target_object_name", "native_dependency_kind")
    if family == "stored_logic_signatures":
        f = _scoped(tables["facts"], schemas).filter(F.col("category").isin("stored-objects", "stored-arguments", "stored-errors"))
        if objects is not None:
            f = f.join(objects.select("schema_name", "object_name").distinct(), ["schema_name", "object_name"], "left_semi")
        return f.orderBy("schema_name", "object_name", "category", F.col("column_name").asc_nulls_first(), "detail_json")
    if family == "scheduler_mv_refresh":
        return _scoped(tables["facts"], schemas).filter("query_id like '%.operations.scheduler' or query_id like '%.structure.mview_refresh'").orderBy(
            "schema_name", F.col("relation_name").asc_nulls_first(), "object_name", "detail_json")
    if family == "coverage_blind_spots":
        rank = F.coalesce(*[F.when(F.col("state") == s, r) for s, r in STATE_RANK.items()], F.lit(4))
        return tables["coverage"].orderBy(rank, "query_id")
    if family == "bi_relevance_candidates":
        return _scoped(tables["relevance"], schemas).orderBy(F.col("deterministic_score").desc(), "schema_name", "relation_name")
    raise ValueError("unsupported question family: " + family)


FAMILY_COVERAGE = {
    "largest_tables": ["sizes", "statistics", "relations"], "row_estimates_freshness": ["statistics", "relations"],
    "object_inventory_validity": ["schemas", "relations", "stored-objects", "stored-errors"], "dependencies": ["stored-dependencies"],
    "stored_logic_signatures": ["stored-objects", "stored-arguments", "stored-errors"], "scheduler_mv_refresh": ["operations"],
    "coverage_blind_spots": None, "bi_relevance_candidates": ["relations", "columns", "comments", "constraints", "indexes", "statistics"],
}


def answer_provenance(family: str, coverage: DataFrame) -> DataFrame:
    """Coverage rows an answer of this family rests on."""
    cats = FAMILY_COVERAGE[family]
    return coverage if cats is None else coverage.filter(F.col("category").isin(cats))


def guidance(snapshot_id: str | None, columns: DataFrame, relevance: DataFrame, scan: int | None = None, most: dict[str, int] | None = None, keys: list[str] = ()) -> DataFrame:
    """Q9. Measure, dimension, time and drill-down suggestions with stable ids, from all columns and relations.

    The ids name the snapshot: ``snapshot_id`` where the frames hold one, else the frames' ``keys`` (such as source_id,
    snapshot_id), which then lead every row. On request only from the first ``scan`` columns, and with at most ``most[type]`` suggestions of a type (kpi, dim, time, drill).
    """
    own = [F.lit(snapshot_id)] if snapshot_id is not None else [F.col(k) for k in keys]
    order = [*map(F.col, keys), F.col("schema_name"), F.col("relation_name"), F.col("ordinal_position"), F.col("column_name")]
    first = columns.select(*keys, "schema_name", "relation_name", "column_name", "data_type", "ordinal_position")
    if scan is not None:
        first = first.orderBy(*order).limit(scan)
    most = most or {}

    def capped(df, kind, order):
        return df.orderBy(*order).limit(most[kind]) if kind in most else df

    def from_columns(kind, pattern, why):
        hit = capped(first.filter(F.col("column_name").rlike(pattern)), kind, order)
        key = F.concat_ws(":", *own, F.lit(kind), "schema_name", "relation_name", "column_name")
        return hit.select(*keys,
            F.lit(kind).alias("suggestion_type"), F.concat(F.lit(kind + "_"), F.substring(F.sha2(key, 256), 1, 16)).alias("suggestion_id"),
            F.concat_ws(".", "schema_name", "relation_name", "column_name").alias("label"),
            F.concat(F.lit(f"Technical {why} hint from column name and type "), "data_type", F.lit(".")).alias("rationale"))
    top = capped(relevance, "drill", [F.col("deterministic_score").desc(), "schema_name", "relation_name"])
    dkey = F.concat_ws(":", *own, F.lit("drill"), "schema_name", "relation_name")
    drill = top.select(*keys,
        F.lit("drill").alias("suggestion_type"), F.concat(F.lit("drill_"), F.substring(F.sha2(dkey, 256), 1, 16)).alias("suggestion_id"),
        F.concat_ws(".", "schema_name", "relation_name").alias("label"),
        F.concat(F.lit("Catalog BI relevance signals: "), "signal_summary", F.lit(".")).alias("rationale"))
    return (from_columns("kpi", GUIDE_KPI, "measure").unionByName(from_columns("dim", GUIDE_DIMENSION, "dimension"))
            .unionByName(from_columns("time", GUIDE_TIME, "time")).unionByName(drill))


def prioritize_tables(columns: DataFrame, objectives: DataFrame) -> DataFrame:
    """Q10. Score of each table for each objective: 3 per word in its name, 1 per column whose name holds a word.

    objectives: objective_id, objective. Every word counts each time it is said, as each is a separate token. Results are far more
    than objectives, so they are dealt by their own number, not by the size of what they are made of.
    """
    words = objectives.select("objective_id", F.explode(F.split(F.lower("objective"), "[^a-z0-9]+")).alias("w")).filter(
        F.length("w") > 3).groupBy("objective_id", "w").agg(F.count(F.lit(1)).alias("said"))
    # Names are matched once per distinct name and word; the words of an objective list are metadata-sized.
    tnames = columns.select(F.lower("table_name").alias("name")).distinct()
    cnames = columns.select(F.lower("column_name").alias("name")).distinct()
    vocab = words.select("w").distinct()
    # only substrings as long as some word; the lengths are at most as many as the longest word has letters
    lengths = F.array(*[F.lit(r.n) for r in vocab.select(F.length("w").alias("n")).distinct().orderBy("n").collect()]).cast("array<int>")
    def hits(names):
        spots = names.select("name", F.explode(F.array_distinct(F.flatten(F.transform(lengths, lambda k: F.transform(
            F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("name") - k + 1)), lambda i: F.expr("name").substr(i, k)))))).alias("w"))
        return spots.join(vocab, "w", "left_semi").distinct()
    t = columns.select("table_name").distinct().withColumn("name", F.lower("table_name")).join(hits(tnames), "name").select("table_name", "w", F.lit(3).cast("long").alias("n"))
    k = columns.select("table_name", F.lower("column_name").alias("name")).groupBy("table_name", "name").agg(F.count(F.lit(1)).alias("n")).join(
        hits(cnames), "name").select("table_name", "w", "n")
    # what a word is worth to a table is summed before any objective that says it, and results are counted before they are dealt
    worth = measured(t.unionByName(k).groupBy("w", "table_name").agg(F.sum("n").alias("s")))
    met = words.groupBy("w").agg(F.count(F.lit(1)).alias("a")).join(worth.groupBy("w").agg(F.count(F.lit(1)).alias("b")), "w")
    parts = -(-(met.agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 1) // PART_ROWS)
    return words.join(worth, "w").select("objective_id", "table_name", (F.col("said") * F.col("s")).alias("s")).repartition(
        parts, "objective_id", "table_name").groupBy("objective_id", "table_name").agg(F.sum("s").cast("long").alias("score"))


def rank_tables(columns: DataFrame, objective: str) -> DataFrame:
    """Q10 for one objective: every table with its score, 0 for a table that no word meets."""
    asked = columns.sparkSession.createDataFrame([(0, objective)], "objective_id int, objective string")
    scored = prioritize_tables(columns, asked).select("table_name", "score")
    return columns.select("table_name").distinct().join(scored, "table_name", "left").withColumn("score", F.coalesce("score", F.lit(0)).cast("long"))


def active_snapshot(snapshots: DataFrame, keys: list[str] = ["source_id"]) -> DataFrame:
    """W11. Newest active snapshot per source; ties by id."""
    s = snapshots.filter("active") if "active" in snapshots.columns else snapshots
    rest = [x for x in s.columns if x not in keys]
    return s.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("analyzed_at", "snapshot_id")).alias("_r")).select(*keys, "_r.*")
