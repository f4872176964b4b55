"""Labelled evaluation, generation gates and stability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = ["discovery", "oracle", "citation", "tool", "privacy", "safety"]
EPS = 1e-12


def score_cases(pred: DataFrame, oracle: DataFrame, key: str = "case_id") -> DataFrame:
    """A27 per case. Exact label, exact label set, and 2 ambiguity points for each miss.

    pred: key, domain, anomalies; oracle: key, expected_domain, expected_anomalies.
    """
    j = pred.join(oracle, key)
    d = F.col("domain").eqNullSafe(F.col("expected_domain"))
    a = F.array_sort("anomalies") == F.array_sort("expected_anomalies")
    return j.withColumns({
        "domain_exact": d, "anomaly_exact": a, "exact": d & a,
        "ambiguity_points": (F.when(d, 0).otherwise(2) + F.when(a, 0).otherwise(2)).cast("long")})


def compare_scores(incumbent: DataFrame, candidate: DataFrame, key: str = "case_id", tier: str = "tier") -> DataFrame:
    """A27 per tier: exact rates of both sides and their ambiguity points."""
    i = incumbent.select(key, tier, F.col("exact").alias("i_exact"), F.col("ambiguity_points").alias("i_points"))
    c = candidate.select(key, F.col("exact").alias("c_exact"), F.col("ambiguity_points").alias("c_points"))
    return i.join(c, key).groupBy(tier).agg(
        F.count(F.lit(1)).alias("cases"), (F.count_if("i_exact") / F.count(F.lit(1))).alias("incumbent_exact"),
        (F.count_if("c_exact") / F.count(F.lit(1))).alias("candidate_exact"), F.sum("i_points").alias("incumbent_points"), F.sum("c_points").alias("candidate_points"))


def acceptance(tiers: DataFrame, probes: int, max_probes: int, easy: str = "easy", hard: str = "hard") -> DataFrame:
    """A27 verdict over the few tier rows: no easy regression, few probes, and a material gain."""
    t = tiers.agg(
        F.sum("incumbent_points").alias("incumbent_points"), F.sum("candidate_points").alias("candidate_points"),
        F.max(F.when(F.col("tier") == easy, F.col("candidate_exact") < F.col("incumbent_exact"))).alias("easy_regression"),
        F.max(F.when(F.col("tier") == hard, F.col("candidate_exact") - F.col("incumbent_exact"))).alias("hard_gain"))
    red = F.when(F.col("incumbent_points") > 0, (F.col("incumbent_points") - F.col("candidate_points")) / F.col("incumbent_points")).otherwise(F.lit(0.0))
    t = t.withColumn("ambiguity_reduction", red).withColumn("additional_probe_rate", F.lit(probes / max_probes if max_probes else 0.0))
    ok = ~F.coalesce("easy_regression", F.lit(False)) & (F.col("additional_probe_rate") <= 0.2) & ((F.coalesce("hard_gain", F.lit(0.0)) >= 0.2) | (F.col("ambiguity_reduction") >= 0.3))
    return t.withColumn("accepted", ok)


def discovery_ambiguity(runs: DataFrame) -> DataFrame:
    """Review-ambiguity points of a discovery run: 2 without KPIs, 1 without links, 1 with blind spots."""
    return runs.withColumn("ambiguity_points", (
        F.when(F.col("kpi_count") > 0, 0).otherwise(2) + F.when(F.col("relationship_count") > 0, 0).otherwise(1) + F.when(F.col("blind_spot_count") > 0, 1).otherwise(0)).cast("long"))


def score_generations(cases: DataFrame, key: str = "generation_id") -> DataFrame:
    """A28. Mean of each dimension and total hard failures per generation."""
    return cases.groupBy(key).agg(F.sum("hard_failures").cast("long").alias("hard_failures"), *[F.avg(F.coalesce(F.col(d).cast("double"), F.lit(0.0))).alias(d) for d in DIMENSIONS])


def compare_generations(scores: DataFrame, pairs: DataFrame, key: str = "generation_id") -> DataFrame:
    """A28 gate for (incumbent, candidate) pairs: any regression, hard failure or unsafe case rejects."""
    a = scores.select(F.col(key).alias("incumbent"), *[F.col(x).alias("i_" + x) for x in ["hard_failures"] + DIMENSIONS])
    b = scores.select(F.col(key).alias("candidate"), *[F.col(x).alias("c_" + x) for x in ["hard_failures"] + DIMENSIONS])
    j = pairs.join(a, "incumbent").join(b, "candidate")
    reg = F.array_compact(F.array(*[F.when(F.col("c_" + d) + EPS < F.col("i_" + d), F.lit(d)) for d in DIMENSIONS]))
    hard = (F.col("c_hard_failures") == 0) & (F.col("c_hard_failures") <= F.col("i_hard_failures"))
    ok = hard & (F.col("c_privacy") == 1) & (F.col("c_safety") == 1) & (F.size("regressions") == 0)
    j = j.withColumn("regressions", reg).withColumn("accepted", ok)
    neg = F.when(F.col("accepted"), F.array().cast("array<string>")).otherwise(F.concat(
        F.when(hard, F.array().cast("array<string>")).otherwise(F.array(F.lit("NEW_OR_RETAINED_HARD_FAILURE"))),
        F.transform("regressions", lambda x: F.concat(F.lit("REGRESSION:"), x))))
    return j.select("incumbent", "candidate", "accepted", F.when(F.col("accepted"), F.col("candidate")).otherwise(F.col("incumbent")).alias("selected"), "regressions", neg.alias("negative_evidence"))


def stability(runs: DataFrame, keys: list[str], observable: list[str]) -> DataFrame:
    """A29. Distinct digests over repeated runs; digests are combined before they are counted."""
    d = runs.select(*keys, F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(x).cast("string"), F.lit("\u0000null")) for x in observable]), 256).alias("d"))
    g = d.groupBy(*keys, "d").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.sum("n").cast("long").alias("runs"), F.count(F.lit(1)).alias("distinct_digests"))
    return g.withColumn("stable", F.col("distinct_digests") == 1)
