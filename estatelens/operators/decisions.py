"""Ranking, budgets and rule labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import c, flags, int_div
from .rules import first_rule


def expected_gain(df: DataFrame) -> DataFrame:
    """W7. floor(uncertainty * probability * relevance / 1e8) on longs (at most 1e12)."""
    p = F.col("uncertainty_bps").cast("long") * F.col("outcome_probability_bps").cast("long") * F.col("relevance_bps").cast("long")
    return df.withColumn("expected_gain_bps", int_div(p, F.lit(100_000_000)))


def by_gain():
    return [F.col("expected_gain_bps").desc(), F.col("candidate_id")]


def suppress_near_duplicates(df: DataFrame, key: str = "near_duplicate_key") -> DataFrame:
    """W9. First candidate per intent key by rank; the rank filter is pruned map-side."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*by_gain()))).filter("_rn = 1").drop("_rn")


def budgeted_selection(df: DataFrame, max_hypothesis: int, max_table: int, max_run: int, min_gain_bps: int = 0,
                       hypothesis: str = "hypothesis_id", table: str = "table_key") -> DataFrame:
    """W6. Greedy selection under nested caps (a hypothesis lies in one table).

    Taking the best max_hypothesis per hypothesis, of those the best max_table per table, of those the best max_run
    equals the greedy walk. Every cap is a rank filter Spark prunes before the shuffle; the last is a top-k.
    """
    def cap(d, keys, n):
        w = Window.partitionBy(*keys).orderBy(*by_gain())
        return d.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
    d = cap(cap(df.filter(F.col("expected_gain_bps") >= min_gain_bps), [table, hypothesis], max_hypothesis), [table], max_table)
    return d.orderBy(*by_gain()).limit(max_run)


def object_capped_selection(df: DataFrame, max_object: int) -> DataFrame:
    """W6, object cap: candidates debit every object in ``objects`` (a link debits two columns).

    The greedy walk is settled in rounds over the whole table instead of row by row. A candidate is decided once
    it is known that it must be taken (for each object, all better open candidates plus what is taken fit the
    cap) or must be refused (one of its objects is full). Each round decides at least the best open candidate, so the
    rounds end; a round without a decision means repeated ids or objects and is an error. A candidate without objects is taken.
    """
    from ..session import cut_lineage
    ranked = df.select("candidate_id", "expected_gain_bps", F.coalesce("objects", F.array().cast(df.schema["objects"].dataType)).alias("objects"))
    open_, taken = ranked, ranked.limit(0).select("candidate_id", F.explode("objects").alias("object"))
    picks, still = None, ranked.count()
    while True:
        use = taken.groupBy("object").agg(F.count(F.lit(1)).alias("used"))
        ends = open_.select("candidate_id", "expected_gain_bps", F.explode("objects").alias("object")).join(use, "object", "left")
        ends = ends.withColumn("room", F.lit(max_object) - F.coalesce("used", F.lit(0)))
        w = Window.partitionBy("object").orderBy(*by_gain())
        best = ends.filter("room > 0").withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= max_object).filter("_rn <= room")
        fits = best.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("ok"))
        full = ends.filter("room <= 0").select("candidate_id").distinct()
        open_ = cut_lineage(open_.join(full, "candidate_id", "left_anti").join(fits, "candidate_id", "left").withColumn("ok", F.coalesce("ok", F.lit(0))))
        win = open_.filter(F.col("ok") == F.size("objects")).drop("ok")
        picks = win if picks is None else picks.unionByName(win)
        taken = picks.select("candidate_id", F.explode("objects").alias("object"))
        open_ = open_.filter(F.col("ok") != F.size("objects")).drop("ok")
        before, still = still, open_.count()
        if not still:
            return picks
        if still == before:
            raise ValueError("a candidate_id stands twice, or an object twice in one candidate")


ANOMALY_PRIORITY = ["grain_conflict", "corruption_signal", "material_missingness", "outlier_cluster"]


def anomaly_labels(strict: bool = False) -> Column:
    """M4. Sorted labels of a profile summary; ``strict`` is the older, stricter rule set."""
    n, z, f, i, k = (F.col(x) for x in ("null_pct_max", "outlier_z_max", "format_error_pct_max", "impossible_value_pct_max", "candidate_key_collision_pct"))
    if strict:
        return F.array_sort(flags((n >= 0.2, "material_missingness"), (z >= 6.5, "outlier_cluster"), (i >= 0.04, "corruption_signal"), (k >= 0.08, "grain_conflict")))
    return F.array_sort(flags(
        (n >= 0.15, "material_missingness"), (z >= 5, "outlier_cluster"), ((f >= 0.01) | (F.col("noise_score") >= 0.4), "format_noise"),
        (i >= 0.02, "corruption_signal"), ((k >= 0.05) | F.coalesce("time_grain_conflict", F.lit(False)), "grain_conflict")))


def profile_summary(df: DataFrame, keys: list[str], value: str, nullable: str, key_cols: list[str], time: str | None = None) -> DataFrame:
    """M4 input: null share, largest z score, impossible (negative) share and key collision share per group.

    Copies of a key are counted before the group is. Deviations come from combined moments, so large means cancel nothing.
    """
    own = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    d = df.groupBy(*keys, *key_cols).agg(F.count(F.lit(1)).alias("_n")).groupBy(*own).agg(F.sum(F.col("_n") - 1).alias("coll"))
    g = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(nullable).isNull()).alias("nulls"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"),
        F.min(value).alias("lo"), F.max(value).alias("hi"), F.count_if(F.col(value) < 0).alias("neg"))
    g = g.join(d, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    mean, sd = F.col("mean"), F.col("sd")
    z = F.when(sd > 0, F.greatest(F.col("hi") - mean, mean - F.col("lo")) / sd).otherwise(F.lit(0.0))
    return g.select(
        *keys, (F.col("nulls") / F.col("n")).alias("null_pct_max"), z.alias("outlier_z_max"), F.lit(0.0).alias("format_error_pct_max"),
        (F.col("neg") / F.col("n")).alias("impossible_value_pct_max"), F.lit(0.0).alias("noise_score"),
        (F.col("coll") / F.col("n")).alias("candidate_key_collision_pct"), F.lit(False).alias("time_grain_conflict"))


# fixed rules: domain of a set of terms, first match wins
DOMAIN_RULES = [
    ("order_fulfillment_margin", "order|shipment|return|margin"),
    ("supplier_quality_lead_time", "supplier|receipt|defect|lead"),
    ("station_yield_hold_analysis", "lot|station|yield|hold"),
    ("berth_queue_demurrage", "vessel|berth|queue|demurrage"),
    ("care_episode_adjustment_quality", "episode|rx|service|adjustment|denominator"),
    ("asset_cycle_rework_downtime", "asset|cycle|downtime|rework"),
]
UNKNOWN_DOMAIN = "unknown_domain_nonclaim"


def domain_of(terms, signals=None) -> Column:
    """M5. Domain of an array of terms, together with the signals of a probe if there was one."""
    joined = c(terms) if signals is None else F.concat(c(terms), F.coalesce(c(signals), F.array().cast("array<string>")))
    return first_rule(F.lower(F.array_join(joined, " ")), DOMAIN_RULES, UNKNOWN_DOMAIN)


def incumbent_domain(terms, tier) -> Column:
    """M5, older rule: full rules only on easy cases."""
    return F.when(c(tier) == "easy", domain_of(terms)).when(
        F.array_join(c(terms), " ").rlike("lot|station|yield"), "station_yield_hold_analysis").otherwise(UNKNOWN_DOMAIN)


# fixed rules: probe per anomaly, and the summaries it may read
PROBES = [
    ("grain_conflict", "grain_collision_summary", "(?i)grain|denominator|reuse|disagree"),
    ("corruption_signal", "contradiction_check", "(?i)contradict|zero|impossible"),
    ("material_missingness", "null_pattern_by_metric", "(?i)null|sparse"),
    ("outlier_cluster", "outlier_cluster_by_segment", "(?i)spike|tail|cluster"),
]


def needs_probe(domain, labels, noise) -> Column:
    return (c(domain) == UNKNOWN_DOMAIN) | F.array_contains(c(labels), "grain_conflict") | F.array_contains(c(labels), "corruption_signal") | (c(noise) >= 0.4)


def _matching(items: str, pattern: str) -> Column:
    return F.filter(items, lambda x: x.rlike(pattern))


def choose_probe(df: DataFrame, labels: str = "labels", summaries: str = "summaries") -> DataFrame:
    """M6. Probe kind by anomaly priority and the summaries that may answer it."""
    kind, sig = None, None
    for label, probe, pat in PROBES:
        hit = F.array_contains(labels, label)
        s = _matching(summaries, pat)
        kind = F.when(hit, probe) if kind is None else kind.when(hit, probe)
        sig = F.when(hit, s) if sig is None else sig.when(hit, s)
    return df.withColumn("probe_kind", kind.otherwise("domain_alias_lookup")).withColumn("probe_signals", sig.otherwise(F.col(summaries)))


def case_budget(cases: DataFrame, max_total: int, order: str = "case_id") -> DataFrame:
    """M7. One probe per case, ``max_total`` in all, in case order; the rest keep their gap unprobed."""
    first = cases.filter("needs_probe").select(order).orderBy(order).limit(max_total).withColumn("probed", F.lit(True))
    return cases.join(F.broadcast(first), order, "left").withColumn("probed", F.coalesce("probed", F.lit(False)))  # max_total rows
