"""Comparison of two record sets: pairing, agreement, stability and summaries of runs."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwire.operators.ranking import quantiles, spearman
from cellwire.operators.session import materialize

KEY = ["sender_group", "receiver_group", "interaction_name"]


def pair_records(left: DataFrame, right: DataFrame, keys: Sequence[str] = KEY, values: Sequence[str] = ("probability", "pvalue")) -> DataFrame:
    """Full outer pairing with ``side``: both, left_only or right_only."""
    keys = list(keys)
    l = left.select(*keys, *[F.col(v).alias(f"{v}_left") for v in values], F.lit(1).alias("_l"))
    r = right.select(*keys, *[F.col(v).alias(f"{v}_right") for v in values], F.lit(1).alias("_r"))
    side = F.when(F.col("_l").isNull(), "right_only").when(F.col("_r").isNull(), "left_only").otherwise("both")
    return l.join(r, keys, "full").withColumn("side", side).drop("_l", "_r")


def _gap(column: str) -> Column:
    return F.abs(F.col(f"{column}_left") - F.col(f"{column}_right"))


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def agreement_report(pairs: DataFrame, tolerance: float = 1e-9, alpha: float = 0.05) -> DataFrame:
    """Matches, Jaccard index, largest errors, decision changes and the strict verdict."""
    both = F.col("side") == "both"
    p_left, p_right = F.col("pvalue_left"), F.col("pvalue_right")
    out = pairs.agg(
        _count(both).alias("matched"), _count(F.col("side") == "left_only").alias("left_only"),
        _count(F.col("side") == "right_only").alias("right_only"),
        (_count(both) / F.count(F.lit(1))).alias("active_jaccard"),
        F.max(_gap("probability")).alias("max_probability_error"), F.max(_gap("pvalue")).alias("max_pvalue_error"),
        F.avg(F.when(both, (p_left == p_right).cast("double"))).alias("exact_pvalue_fraction"),
        _count(both & ((p_left < alpha) != (p_right < alpha))).alias("decision_changes"),
        F.corr("probability_left", "probability_right").alias("probability_pearson"),
    )
    strict = (
        (F.col("matched") > 0) & (F.col("left_only") + F.col("right_only") == 0)
        & (F.col("max_probability_error") <= tolerance) & (F.col("max_pvalue_error") == 0) & (F.col("decision_changes") == 0)
    )
    return out.withColumn("strict_pass", F.coalesce(strict, F.lit(False)))


def zero_inclusive_report(pairs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Agreement over the union of records: a missing score is 0 and a missing p value 1."""
    filled = pairs.fillna(0.0, ["probability_left", "probability_right"]).fillna(1.0, ["pvalue_left", "pvalue_right"])
    return filled.agg(
        _count(F.col("side") != "right_only").alias("left_records"), _count(F.col("side") != "left_only").alias("right_records"),
        _count(F.col("side") == "both").alias("shared_records"),
        (_count(F.col("side") == "both") / F.count(F.lit(1))).alias("active_jaccard"),
        F.max(_gap("probability")).alias("max_probability_difference"),
        F.avg((_gap("probability") == 0).cast("double")).alias("exact_probability_fraction"),
        F.max(_gap("pvalue")).alias("max_pvalue_difference"),
        F.avg((_gap("pvalue") == 0).cast("double")).alias("exact_pvalue_fraction"),
        _count((F.col("pvalue_left") < alpha) != (F.col("pvalue_right") < alpha)).alias("decision_changes"),
    )


def agreement_exceptions(pairs: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Records on one side only or with different values."""
    return pairs.where(
        (F.col("side") != "both") | (_gap("probability") > tolerance)
        | ~F.col("pvalue_left").eqNullSafe(F.col("pvalue_right")))


def record_jaccard(left: DataFrame, right: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Shared and united record keys; two empty sets agree fully."""
    pairs = pair_records(left, right, keys, [])
    shared, union = _count(F.col("side") == "both"), F.count(F.lit(1))
    return pairs.agg(shared.alias("shared"), union.alias("united"),
                     F.when(union > 0, shared / union).otherwise(F.lit(1.0)).alias("jaccard"))


def call_transitions(pairs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Significant records that two inputs share, lose or gain."""
    l, r = (F.coalesce(F.col(f"pvalue_{s}") < alpha, F.lit(False)) for s in ("left", "right"))
    kind = F.when(l & r, "shared").when(l, "lost").when(r, "gained")
    return pairs.withColumn("category", kind).where("category IS NOT NULL").groupBy("category").agg(
        F.count(F.lit(1)).alias("records"))


def top_retention(full: DataFrame, subset: DataFrame, top: int = 100) -> DataFrame:
    """How many of the highest-scoring records of the full run the subset run contains."""
    first = full.orderBy(F.desc("probability"), *KEY).limit(top)
    kept = first.join(subset.select(*KEY), KEY, "left_semi")
    return first.agg(F.count(F.lit(1)).alias("top_full_count")).withColumn(
        "top_retained", kept.agg(F.count(F.lit(1))).scalar())


def sampling_stability(full: DataFrame, subset: DataFrame, subset_groups: DataFrame) -> DataFrame:
    """Stability of a subset run against the full run, among groups the subset contains."""
    names = subset_groups.select("group").distinct()
    eligible = full
    for side in ("sender_group", "receiver_group"):
        eligible = eligible.join(names.withColumnRenamed("group", side), side, "left_semi")
    pairs = pair_records(eligible, subset, values=["probability"])
    both = pairs.where("side = 'both'")
    filled = pairs.fillna(0.0, ["probability_left", "probability_right"])
    rank = lambda df: spearman(df, [], "probability_left", "probability_right", "r").select("r").scalar()
    matched = _count(F.col("side") == "both")
    return pairs.agg(
        matched.alias("matched"), _count(F.col("side") != "right_only").alias("eligible_full_records"),
        _count(F.col("side") != "left_only").alias("subset_records"),
        (matched / F.count(F.lit(1))).alias("active_jaccard"),
        (matched / _count(F.col("side") != "right_only")).alias("retained_fraction"),
    ).withColumns({"spearman_matched": rank(both), "spearman_zero_inclusive": rank(filled)})


def shared_log_bins(pairs: DataFrame, bins: int = 24) -> DataFrame:
    """Histogram of positive paired probabilities on equal log10 bins shared by both sides."""
    long = pairs.where("probability_left > 0 AND probability_right > 0").select(F.explode(F.array(*[
        F.struct(F.lit(s).alias("side"), F.log10(f"probability_{s}").alias("v")) for s in ("left", "right")])).alias("_e")
    ).select("_e.side", "_e.v")
    edge = long.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi"))).scalar()
    width = (edge["hi"] - edge["lo"]) / F.lit(float(bins))
    place = F.least(F.floor((F.col("v") - edge["lo"]) / width), F.lit(bins - 1))
    return long.withColumn("bin", F.when(width > 0, place).otherwise(F.lit(0))).groupBy("side", "bin").agg(
        F.count(F.lit(1)).alias("records"))


def run_summary(runs: DataFrame, key: str, state: str, fields: Sequence[str]) -> DataFrame:
    """Runs per state and min, median and max of each field over the completed runs."""
    states = F.upper(F.col(state))
    counts = runs.groupBy(key).agg(
        F.count(F.lit(1)).alias("input_samples"), _count(states == "COMPLETED").alias("completed_samples"),
        _count(states.isin("FAILED", "TIMEOUT")).alias("failed_samples"),
        _count(states == "EXCLUDED").alias("excluded_samples"),
        _count(states.isin("PENDING", "RUNNING")).alias("pending_samples"))
    done = runs.where(states == "COMPLETED")
    for f in fields:
        stats = quantiles(done, [key], f, [0, 0.5, 1], [f"{f}_min", f"{f}_median", f"{f}_max"])
        counts = counts.join(stats, key, "left")
    return counts


def ratio_to_baseline(runs: DataFrame, case: Sequence[str], variant: str, value: str, baseline: str = "full") -> DataFrame:
    """Median and quartiles per configuration and the ratio to the baseline of the same case."""
    case = list(case)
    # Read twice below, one row per configuration.
    stats = materialize(quantiles(runs, [*case, variant], value, [0.25, 0.5, 0.75], ["q25", "median", "q75"]))
    base = stats.where(F.col(variant) == baseline).select(*case, F.col("median").alias("_base"))
    return stats.join(base, case, "left").withColumn("ratio_to_baseline", F.col("median") / F.col("_base")).drop("_base")
