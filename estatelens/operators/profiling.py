"""Column profiles, rank quantiles, quality metrics, anomalies and profile candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import as_text, bps, c, int_div, lit_null, spark_family
from ..session import Scratch, cut_lineage
from .typed_values import UPPER_MEDIAN, distinct_counts, histogram, is_value, order_key, picked_ranks, quantile_texts

def _counts(col: str) -> list[Column]:
    x = F.col(col)
    return [
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(x.isNull()).alias("null_count"),
        F.countDistinct(x).alias("distinct_count"),
    ]


def profile(df: DataFrame, col: str, family: str) -> DataFrame:
    """A1-A5. One row; NUMERIC and TEMPORAL add extrema as text, TEMPORAL its freshness maximum."""
    dtype = df.schema[col].dataType
    ext = df.select(col)
    aggs = _counts(col)
    if family in ("NUMERIC", "TEMPORAL"):
        aggs += [F.min(col).alias("_lo"), F.max(col).alias("_hi")]
    out = ext.agg(*aggs)
    if family in ("NUMERIC", "TEMPORAL"):
        out = out.withColumn("minimum", as_text("_lo", dtype)).withColumn("maximum", as_text("_hi", dtype))
        if family == "TEMPORAL":
            out = out.withColumn("freshness_maximum", F.col("maximum"))
    return out.drop("_lo", "_hi").select(F.lit(col).alias("column_name"), F.lit(family).alias("type_family"), "*")


def profile_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """A6. Row, null and distinct counts of several columns, one row per column.

    Counts come from one wide aggregate; distinct values of all columns meet in one shuffle of 128-bit keys, without
    text and without a copy of each row per column and count.
    """
    one = df.select(*cols).agg(F.count(F.lit(1)).alias("_rows"), *[F.count(x).alias(f"_c{i}") for i, x in enumerate(cols)])
    base = one.select(F.inline(F.array(*[
        F.struct(F.lit(x).alias("column_name"), F.col("_rows").alias("row_count"), (F.col("_rows") - F.col(f"_c{i}")).alias("null_count")) for i, x in enumerate(cols)])))
    return base.join(distinct_counts(df, cols), "column_name", "left").select("column_name", "row_count", "null_count", F.coalesce("distinct_count", F.lit(0)).cast("long").alias("distinct_count"))


def profile_table(df: DataFrame, cols: list[str] | None = None, distinct: str = "exact", key_slack: float = 0.1) -> DataFrame:
    """A7. Every column of a table in one pass, one row per column.

    Counts and extrema come from one wide aggregate over one scan. Distinct counts: ``exact`` uses one
    shuffle of 128-bit keys for all columns, ``approx`` the sketch of the wide aggregate, ``screened`` the exact
    path only for columns whose sketch is within ``key_slack`` of the non-null count (possible keys).
    """
    cols = cols or df.columns
    types = {f.name: f.dataType for f in df.schema.fields}

    def sortable(x):
        return spark_family(types[x]) in ("NUMERIC", "TEMPORAL")

    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, x in enumerate(cols):
        aggs += [F.count(x).alias(f"_c{i}")]
        if sortable(x):
            aggs += [F.min(x).alias(f"_lo{i}"), F.max(x).alias(f"_hi{i}")]
        if distinct != "exact":
            aggs += [F.approx_count_distinct(x).alias(f"_a{i}")]
    wide = df.agg(*aggs)
    if distinct == "screened":
        est = wide.first()
        todo = [x for i, x in enumerate(cols) if est[f"_c{i}"] and est[f"_a{i}"] >= (1 - key_slack) * est[f"_c{i}"]]
        wide = df.sparkSession.range(1).select(*[F.lit(est[x]).cast(wide.schema[x].dataType).alias(x) for x in wide.columns])
    else:
        todo = cols if distinct == "exact" else []

    def entry(i, x):
        fam = spark_family(types[x])
        lo = as_text(f"_lo{i}", types[x]) if sortable(x) else lit_null()
        hi = as_text(f"_hi{i}", types[x]) if sortable(x) else lit_null()
        approx = F.col(f"_a{i}") if distinct != "exact" else lit_null("long")
        return F.struct(
            F.lit(x).alias("column_name"), F.lit(i + 1).alias("ordinal_position"), F.lit(fam).alias("type_family"),
            F.col("_rows").alias("row_count"), (F.col("_rows") - F.col(f"_c{i}")).alias("null_count"),
            lo.alias("minimum"), hi.alias("maximum"), approx.alias("_approx"))

    base = wide.select(F.inline(F.array(*[entry(i, x) for i, x in enumerate(cols)])))
    if todo:
        found = distinct_counts(df, todo).withColumnRenamed("distinct_count", "_exact")
        base = base.join(found, "column_name", "left")
        if distinct == "exact":  # a table without rows has no distinct value
            base = base.withColumn("_exact", F.coalesce("_exact", F.lit(0)))
    else:
        base = base.withColumn("_exact", lit_null("long"))
    return base.withColumn("distinct_count", F.coalesce("_exact", "_approx").cast("long")).withColumn(
        "distinct_exact", F.col("_exact").isNotNull()).drop("_exact", "_approx")


def first_rows(df: DataFrame, n: int | None, order: list[str] | None = None) -> DataFrame:
    """Q11. Bounded scan; with an order key the bound is repeatable. n is the caller's choice, all rows without it."""
    if n is None:
        return df
    if n < 1:
        raise ValueError("a bounded scan takes one row or more")
    return (df.orderBy(*order) if order else df).limit(n)


def column_summary(df: DataFrame, col: str, n: int | None = None, order: list[str] | None = None) -> DataFrame:
    """A8."""
    return first_rows(df, n, order).agg(*_counts(col))


def temporal_coverage(df: DataFrame, col: str, n: int | None = None, order: list[str] | None = None) -> DataFrame:
    """A9. Null when the bounded scope is empty; the freshness maximum repeats the maximum."""
    def iso_text(x):
        return F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss.SSS")
    return first_rows(df, n, order).agg(
        *_counts(col), iso_text(F.min(col)).alias("minimum"), iso_text(F.max(col)).alias("maximum"),
        iso_text(F.max(col)).alias("freshness_maximum"))


def quality_indicators(df: DataFrame, col: str, n: int | None = None, order: list[str] | None = None) -> DataFrame:
    """A10. Same counts as A8, read as quality evidence."""
    return column_summary(df, col, n, order)


def quality_metrics(p: DataFrame) -> DataFrame:
    """A11. Rates in floored basis points, key eligibility and the counterevidence list."""
    rows, nulls, dist = F.col("row_count"), F.col("null_count"), F.col("distinct_count")
    out = p.withColumn("non_null_count", rows - nulls).withColumn("duplicate_count", rows - nulls - dist)
    out = out.withColumn("null_rate_bps", bps("null_count", "row_count")).withColumn(
        "distinct_rate_bps", bps("distinct_count", "non_null_count"))
    out = out.withColumn("key_eligible", (rows > 0) & (nulls == 0) & (F.col("duplicate_count") == 0))

    def item(code, n):
        return F.struct(F.lit(code).alias("reason_code"), n.cast("long").alias("count"))

    return out.withColumn("counterevidence", F.array_compact(F.array(
        F.when(nulls > 0, item("NULLS_OBSERVED", nulls)),
        F.when(F.col("duplicate_count") > 0, item("DUPLICATES_OBSERVED", F.col("duplicate_count"))),
        F.when(rows == 0, item("EMPTY_BOUNDED_SCOPE", F.lit(0))),
    )))


def temporal_completeness(p: DataFrame) -> DataFrame:
    """A11 for temporal targets: only the null rate."""
    return p.withColumn("null_rate_bps", bps("null_count", "row_count"))


def profile_violations(p: DataFrame) -> DataFrame:
    """Counts that cannot be true: more nulls than rows, more distinct values than non-null rows."""
    return p.filter((F.col("null_count") > F.col("row_count")) | (F.col("distinct_count") > F.col("row_count") - F.col("null_count")))


# --- rank quantiles -----------------------------------------------------------------------------------

def rank_index(p, n: Column) -> Column:
    """0-based rank: the upper median is n div 2, quantile p is floor((n-1)*p)."""
    if p == UPPER_MEDIAN:
        return int_div(n, F.lit(2))
    return F.floor((n - 1) * F.lit(float(p))).cast("long")


def _at_or_below(value: Column, cuts: str) -> Column:
    """How many of a short sorted array of cut points are <= value."""
    return F.size(F.filter(cuts, lambda x: x <= value))


def histogram_quantiles(hist: DataFrame, keys: list[str], value: str, n: str, wanted: dict, rounds: int = 1,
                        coarse: int = 32, fine: int = 32) -> DataFrame:
    """W10. Exact rank-picked quantiles of a (keys, value, n) histogram.

    A round cuts a key's values into coarse*fine ranges at sketch quantiles, sums the ranges, and keeps only the
    range that covers each wanted rank. The closing window sees about one range of distinct values of a key;
    ``rounds=2`` cuts the surviving ranges once more, for histograms of more than about 1e9 values a key. The
    sketch decides speed only, never the answer. The histogram feeds several branches, so it is checkpointed once
    instead of being scanned and shuffled again for each.

    Cut points reach the rows in two short arrays, coarse then fine; how they are joined is left to adaptive execution.
    Values keep their type, so the answer is as exact as it; ``typed_values`` takes columns of several types at once.
    """
    h = cut_lineage(hist.select(*keys, F.col(value).alias("_v"), F.col(n).cast("long").alias("_n")))
    total = h.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    targets = total.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(name).alias("_q"), rank_index(p, F.col("_total")).alias("_rank")) for name, p in wanted.items()])))
    m = coarse * fine
    points = F.array(*[F.lit(i / m) for i in range(1, m)])

    def narrow(play, scope, goal):
        cuts = play.groupBy(*scope).agg(F.percentile_approx("_v", points, F.lit(10000)).alias("_cuts"))
        marks = F.transform(F.sequence(F.lit(1), F.lit(coarse - 1)), lambda i: F.element_at("_cuts", (i * fine).cast("int")))
        rest = F.transform(F.sequence(F.lit(0), F.lit(coarse - 1)), lambda i: F.slice("_cuts", i * fine + 1, F.lit(fine - 1)))
        outer = cuts.select(*scope, marks.alias("_marks"))
        inner = cuts.select(*scope, F.posexplode(rest).alias("_c", "_rest"))
        play = play.join(outer, scope).withColumn("_c", _at_or_below(F.col("_v"), "_marks")).drop("_marks")
        play = play.join(inner, [*scope, "_c"]).withColumn("_b", F.col("_c") * fine + _at_or_below(F.col("_v"), "_rest")).drop("_rest", "_c")
        before = Window.partitionBy(*scope).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        ranges = play.groupBy(*scope, "_b").agg(F.sum("_n").alias("_bn")).withColumn(
            "_off", F.coalesce(F.sum("_bn").over(before), F.lit(0)))
        hit = ranges.join(goal, scope).filter((F.col("_rank") >= F.col("_off")) & (F.col("_rank") < F.col("_off") + F.col("_bn")))
        hit = hit.withColumn("_rank", F.col("_rank") - F.col("_off")).drop("_off", "_bn")
        return play.join(hit, [*scope, "_b"]).drop("_b")

    scope = keys + ["_q"]
    play = narrow(h, keys, targets)
    for _ in range(rounds - 1):
        play = cut_lineage(play)
        goal = play.groupBy(*scope).agg(F.max("_rank").alias("_rank"))
        play = narrow(play.drop("_rank"), scope, goal)
    run = Window.partitionBy(*scope).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    picked = play.withColumn("_cum", F.sum("_n").over(run)).filter(
        (F.col("_cum") > F.col("_rank")) & (F.col("_cum") - F.col("_n") <= F.col("_rank")))
    return picked.groupBy(*keys).agg(*[F.max(F.when(F.col("_q") == name, F.col("_v"))).alias(name) for name in wanted])


def sample_profile(df: DataFrame, cols: list[str] | None = None, n: int | None = None, order: list[str] | None = None) -> DataFrame:
    """A12. Sample counts, duplicates beyond the first, and for numbers min, max, upper median, q1, q3.

    Numbers come as doubles (min_value, max_value, median_value, q1, q3) for rules that compare them, and as exact text
    (the same names with ``_exact``), which keeps integers above 2**53 and wide decimals apart. Without ``n`` the
    sample is the whole table. One histogram of typed values, kept once, feeds everything.
    """
    src = first_rows(df, n, order) if n else df
    cols = cols or src.columns
    fam = {x: spark_family(src.schema[x].dataType) for x in cols}
    nums = [x for x in cols if fam[x] == "NUMERIC"]
    wanted = {"median_value": UPPER_MEDIAN, "q1": 0.25, "q3": 0.75}
    with Scratch(df.sparkSession) as scratch:
        hist = scratch.keep(histogram(src, cols).withColumn("_v", is_value()).withColumn("_k", order_key()))
        base = hist.groupBy("column_name").agg(
            F.sum("n").alias("sampled"), F.coalesce(F.sum(F.when(~F.col("_v"), F.col("n"))), F.lit(0)).alias("nulls"), F.count_if("_v").alias("distinct_sampled"),
            F.coalesce(F.sum(F.when(F.col("_v"), F.col("n") - 1)), F.lit(0)).alias("duplicate_sampled"))
        kinds = F.create_map(*[y for x in cols for y in (F.lit(x), F.lit(fam[x]))])
        base = base.withColumn("type_family", kinds[F.col("column_name")])
        names = ["min_value", "max_value", *wanted]
        if not nums:
            for x in names:
                base = base.withColumn(x, lit_null("double")).withColumn(x + "_exact", lit_null())
            return scratch.keep(base, outlives=True)
        values = hist.where("_v and _k is not null").drop("_v")
        row = F.struct("l", "f", "t")
        ends = values.groupBy("column_name").agg(F.min_by(row, "_k").alias("lo"), F.max_by(row, "_k").alias("hi"))
        ends = ends.select("column_name", F.inline(F.array(F.struct(F.lit("min_value").alias("q"), F.col("lo").alias("v")), F.struct(F.lit("max_value").alias("q"), F.col("hi").alias("v"))))).select("column_name", "q", "v.*")
        picked = picked_ranks(scratch, values, wanted).unionByName(ends)
        exact = quantile_texts(picked, src, nums, dict.fromkeys(names))
        exact = exact.select("column_name", *[F.col(x).cast("double").alias(x) for x in names], *[F.col(x).alias(x + "_exact") for x in names])
        return scratch.keep(base.join(exact, "column_name", "left"), outlives=True)


CODE_LIKE = "(?i)(email|code|number|reference|serial)"  # fixed pattern: names whose duplicates matter


def anomalies(p: DataFrame, orphans: DataFrame | None = None) -> DataFrame:
    """A13. One row per anomaly; ``p`` carries table_name next to the A12 columns.

    ``orphans`` (relationship, is_orphan, evidence) adds failed link tests. ``cause_rows`` turns
    anomalies into causes for review at fixed low confidence.
    """
    iqr = F.col("q3") - F.col("q1")
    def item(t, sev):
        return F.struct(F.lit(t).alias("anomaly_type"), c(sev).alias("severity"))
    rules = F.array_compact(F.array(
        F.when(F.col("nulls") > 0, item("missing_values", F.when(
            F.col("nulls") >= 0.25 * F.greatest(F.lit(1), F.col("sampled")), F.lit("high")).otherwise(F.lit("medium")))),
        F.when(F.col("min_value") < 0, item("negative_values", F.lit("high"))),
        F.when(F.col("column_name").rlike(CODE_LIKE) & (F.col("duplicate_sampled") > 0), item("duplicate_values", F.lit("medium"))),
        F.when((F.col("sampled") >= 5) & (iqr > 0) & (F.col("max_value") > F.col("q3") + 3 * iqr), item("extreme_values", F.lit("medium"))),
    ))
    found = p.select("table_name", "column_name", F.explode(rules).alias("a")).select(
        "a.anomaly_type", "table_name", "column_name", "a.severity",
        F.concat(F.lit("profile:"), "table_name", F.lit("."), "column_name").alias("evidence"),
        lit_null().alias("relationship"))
    if orphans is not None:
        found = found.unionByName(orphans.filter("is_orphan").select(
            F.lit("orphan_relationship").alias("anomaly_type"), lit_null().alias("table_name"), lit_null().alias("column_name"),
            F.lit("high").alias("severity"), "evidence", "relationship"))
    return found


def cause_rows(found: DataFrame, limit: int | None = None) -> DataFrame:
    """A13, second part: all anomalies, or the first ``limit``, as low-confidence causes that cite their evidence."""
    if limit is not None:
        found = found.orderBy(F.col("relationship").isNotNull(), "table_name", "column_name", "anomaly_type", "relationship").limit(limit)
    return found.select(
        F.concat("anomaly_type", F.lit(" may affect KPI trust or process performance")).alias("hypothesis"),
        F.lit(0.45).alias("confidence"), F.lit("requires-targeted-domain-test").alias("status"), "evidence")


def profile_candidates(p: DataFrame) -> DataFrame:
    """A14. KEY / AMOUNT / TIME / CATEGORY / QUALITY candidates with their rule and signals."""
    rows, nulls, dist, fam = F.col("row_count"), F.col("null_count"), F.col("distinct_count"), F.col("type_family")
    unique = (rows > 0) & (nulls == 0) & (dist == rows)

    def cand(kind, rule, *signals):
        return F.struct(F.lit(kind).alias("candidate_type"), F.lit(rule).alias("rule_id"), F.array(*[c(s) for s in signals]).alias("signals"))

    options = F.array_compact(F.array(
        F.when(unique, cand("KEY", "UNIQUE_COMPLETE_AGGREGATE_V1", F.lit("ALL_ROWS_NON_NULL"), F.lit("ALL_ROWS_DISTINCT"))),
        F.when(~unique & (fam == "NUMERIC"), cand("AMOUNT", "NON_UNIQUE_NUMERIC_FAMILY_V1", F.lit("NUMERIC_TYPE_FAMILY"), F.lit("NOT_UNIQUE_COMPLETE"))),
        F.when(fam == "TEMPORAL", cand("TIME", "TEMPORAL_FAMILY_V1", F.lit("TEMPORAL_TYPE_FAMILY"))),
        F.when(fam.isin("CATEGORY", "BOOLEAN"), cand("CATEGORY", "BOUNDED_CARDINALITY_FAMILY_V1", F.concat(fam, F.lit("_TYPE_FAMILY")))),
        cand("QUALITY", "NULL_AND_DISTINCT_OBSERVATION_V1",
             F.when(nulls == 0, F.lit("NO_NULLS_OBSERVED")).otherwise(F.lit("NULLS_OBSERVED")),
             F.when((rows - nulls > 0) & (dist == rows - nulls), F.lit("ALL_NON_NULL_VALUES_DISTINCT")).otherwise(F.lit("REPEATED_NON_NULL_VALUES"))),
    ))
    keep = [x for x in p.columns if x in ("source_id", "schema_name", "table_name", "column_name")]
    return p.select(*keep, "type_family", "row_count", "null_count", "distinct_count", F.explode(options).alias("o")).select(
        *keep, "type_family", "row_count", "null_count", "distinct_count", "o.candidate_type", "o.rule_id", "o.signals",
        F.lit("REVIEW_REQUIRED").alias("review_state"), F.lit("UNKNOWN").alias("classification_state"))
