"""Cohort tables and per-feature models over sections and patients.

``scores(section_id, feature_id, score)`` holds nonzero scores; an absent pair is a zero. ``units``
has one row per section: section_id, patient_id, condition and covariates. The models read only the
nonzero scores: zeros enter through counts and through the design, which is the same for every
feature, so no zero-filled matrix is built.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwire.functions.expressions import feature_key, hash_order
from cellwire.functions.tails import t_critical, t_two_sided_tail
from cellwire.operators.expression import zero_filled_quantiles
from cellwire.operators.ranking import bh_adjust, complete_grid, quantiles, running, spearman, zero_filled
from cellwire.operators.session import ROWS_PER_TASK, materialize

# Named design terms, as Columns or SQL expressions over the unit columns; the intercept is added.
Design = Sequence[tuple[str, Column | str]]


# ---- tables -----------------------------------------------------------------------------------
def stack_records(results: dict[str, DataFrame]) -> DataFrame:
    """Records of several samples in one table with ``sample_id``."""
    parts = [df.withColumn("sample_id", F.lit(name)) for name, df in results.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def feature_scores(records: DataFrame) -> DataFrame:
    """Nonzero scores with the feature key of (sender, receiver, interaction)."""
    key = feature_key("sender_group", "receiver_group", "interaction_name")
    return records.where("probability > 0").select(
        F.col("sample_id").alias("section_id"), key.alias("feature_id"), "sender_group", "receiver_group",
        "interaction_name", F.col("probability").alias("score"))


def score_matrix(scores: DataFrame, units: DataFrame, unit: str = "section_id") -> DataFrame:
    """Every (unit, feature) with its score, zeros written out."""
    features = scores.select("feature_id").distinct()
    return zero_filled(scores, units.select(unit).distinct(), features, unit, "feature_id").fillna(0.0, ["score"])


def missing_metadata(records: DataFrame, units: DataFrame) -> DataFrame:
    """Samples with records but without a metadata row."""
    return records.select("section_id").distinct().join(units, "section_id", "left_anti")


def patient_scores(scores: DataFrame, units: DataFrame, how: str = "mean") -> DataFrame:
    """Mean or median over the sections of a patient, zeros included; nonzero results only."""
    owned = scores.join(units.select("section_id", "patient_id"), "section_id")
    sizes = units.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n"))
    keys = ["patient_id", "feature_id"]
    if how == "median":
        out = zero_filled_quantiles(owned.withColumnRenamed("score", "value"), sizes, keys, ["patient_id"], [0.5], ["score"])
    else:
        out = owned.groupBy(*keys).agg(F.sum("score").alias("_s")).join(sizes, "patient_id").select(
            *keys, (F.col("_s") / F.col("n")).alias("score"))
    return out.where("score > 0")


def patient_responses(scores: DataFrame, units: DataFrame) -> DataFrame:
    """``y``: mean of log1p(score) over the sections of a patient, zeros included; nonzero rows."""
    logged = scores.withColumn("score", F.log1p("score"))
    return patient_scores(logged, units).withColumnRenamed("score", "y")


def patient_table(units: DataFrame, runs: Sequence[str] = ()) -> DataFrame:
    """One row per patient: condition, sections and the share of sections in each run."""
    shares = [F.avg((F.col("run") == r).cast("double")).alias(f"fraction_{r}") for r in runs]
    return units.groupBy("patient_id").agg(
        F.first("condition").alias("condition"), F.count(F.lit(1)).alias("sections"), *shares)


def section_metadata(records: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """One row per section from row-level metadata that is constant within the section."""
    return records.groupBy(key).agg(*[F.min(c).alias(c) for c in columns], F.count(F.lit(1)).alias("cells"))


def example_tables(scores: DataFrame, units: DataFrame, features: DataFrame) -> DataFrame:
    """Patient means of log1p and nonzero section counts for chosen features, zeros included."""
    chosen = scores.join(features.select("feature_id").distinct(), "feature_id", "left_semi")
    per = chosen.join(units.select("section_id", "patient_id"), "section_id").groupBy("patient_id", "feature_id").agg(
        F.sum(F.log1p("score")).alias("_y"), F.count(F.lit(1)).alias("nonzero_sections"))
    patients = units.groupBy("patient_id").agg(F.first("condition").alias("condition"), F.count(F.lit(1)).alias("sections"))
    grid = complete_grid(patients, features.select("feature_id").distinct(), "patient_id", "feature_id")
    return grid.join(per, ["patient_id", "feature_id"], "left").join(patients, "patient_id").select(
        "patient_id", "condition", "feature_id", "sections", F.coalesce("nonzero_sections", F.lit(0)).alias("nonzero_sections"),
        (F.coalesce("_y", F.lit(0.0)) / F.col("sections")).alias("mean_log1p"))


def conserved_programs(
    scores: DataFrame, units: DataFrame, conditions: Sequence[str], unit: str = "section_id",
    threshold: float = 0.0, min_prevalence: float = 0.5, min_units: int = 2,
) -> DataFrame:
    """Prevalence and mean per condition, and whether the smallest prevalence is high enough."""
    sizes = {r["condition"]: r["n"] for r in units.groupBy("condition").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(sizes.get(c, 0) < min_units for c in conditions):
        raise ValueError("a condition has too few units")
    owned = scores.join(units.select(unit, "condition"), unit)
    is_ = lambda c: F.col("condition") == c
    columns = []
    for c in conditions:
        columns.append((F.count(F.when(is_(c) & (F.col("score") > threshold), 1)) / sizes[c]).alias(f"prevalence_{c}"))
        columns.append((F.coalesce(F.sum(F.when(is_(c), F.col("score"))), F.lit(0.0)) / sizes[c]).alias(f"mean_{c}"))
    out = owned.groupBy("feature_id").agg(*columns)
    low = F.least(*[F.col(f"prevalence_{c}") for c in conditions])
    return out.withColumn("minimum_group_prevalence", low).withColumn("conserved", low >= min_prevalence)


# ---- linear models ----------------------------------------------------------------------------
def _x(design: Design) -> Column:
    terms = [F.expr(c) if isinstance(c, str) else c for _, c in design]
    return F.array(F.lit(1.0), *[c.cast("double") for c in terms])


def _moments(rows: DataFrame, p: int, weight: Column | None = None) -> np.ndarray:
    """Sum of w * x x' over the design rows: p * p numbers come to the driver."""
    w = F.lit(1.0) if weight is None else weight
    sums = [F.sum(w * F.col("x")[i] * F.col("x")[j]).alias(f"m{i}_{j}") for i in range(p) for j in range(p)]
    return np.array(rows.agg(*sums).first(), dtype=float).reshape(p, p)


def _dot(vector: Sequence[float], array: str, p: int) -> Column:
    return reduce(lambda a, b: a + b, [F.lit(float(vector[i])) * F.col(array)[i] for i in range(p)])


def _invert(moments: np.ndarray) -> np.ndarray | None:
    if np.linalg.matrix_rank(moments, tol=1e-10 * max(1.0, np.abs(moments).max())) < len(moments):
        return None
    return np.linalg.inv(moments)


def _vector_sum(p: int, value: Column) -> list[Column]:
    return [F.sum(F.col("x")[i] * value).alias(f"s{i}") for i in range(p)]


def fit_glm(
    scores: DataFrame, units: DataFrame, design: Design, coefficient: str, family: str = "gaussian_log1p",
    unit: str = "section_id", min_units: int = 6, min_nonzero: int = 2, presence_threshold: float = 0.0,
) -> DataFrame:
    """Per-feature regression on an intercept and the design terms.

    Least squares needs only sums per feature over its nonzero scores. The presence model counts
    units per distinct design row first and iterates on those counts.
    """
    names = [n for n, _ in design]
    k, p = names.index(coefficient) + 1, len(names) + 1
    # Read by several small jobs, hence stored once; the same holds for the other models.
    rows = materialize(units.select(unit, _x(design).alias("x")))
    n = rows.count()
    counted = scores.groupBy("feature_id").agg(
        F.count(F.when(F.col("score") > presence_threshold, 1)).alias("nonzero_units"))
    base = counted.withColumn("total_units", F.lit(n)).withColumn("coefficient", F.lit(coefficient))
    inverse = _invert(_moments(rows, p)) if n >= min_units else None
    empty = [F.lit(None).cast("double").alias(c) for c in ("estimate", "std_error", "statistic", "p_value", "q_value")]
    if inverse is None:
        return base.select("*", *empty, F.lit("insufficient_units" if n < min_units else "rank_deficient").alias("status"))
    screen = F.when(F.col("nonzero_units") < min_nonzero, "insufficient_nonzero")
    if family == "binomial_presence":
        fitted = _fit_presence(scores, rows, unit, p, k, presence_threshold).join(base, "feature_id", "right")
        status = screen.when(F.col("nonzero_units") == n, "constant_response").otherwise(F.col("_fit"))
    else:
        value = F.log1p("score") if family == "gaussian_log1p" else F.col("score")
        sums = scores.withColumn("y", value).join(rows, unit).groupBy("feature_id").agg(
            *_vector_sum(p, F.col("y")), F.sum(F.col("y") * F.col("y")).alias("_yy"), F.sum("y").alias("_y"))
        s = F.array(*[F.col(f"s{i}") for i in range(p)])
        beta = F.array(*[_dot(inverse[i], "_s", p) for i in range(p)])
        held = sums.withColumn("_s", s).withColumn("_beta", beta)
        fitted_part = reduce(lambda a, b: a + b, [F.col("_beta")[i] * F.col("_s")[i] for i in range(p)])
        rss = F.greatest(F.col("_yy") - fitted_part, F.lit(0.0))
        spread = F.col("_yy") - F.col("_y") * F.col("_y") / n
        fitted = held.withColumns({
            "estimate": F.col("_beta")[k], "std_error": F.sqrt(rss / (n - p) * float(inverse[k, k])),
            "_flat": spread <= F.col("_yy") * 1e-14,
        }).join(base, "feature_id", "right")
        status = screen.when(F.col("_flat"), "constant_response").otherwise("ok")
    held = fitted.withColumn("status", status)
    ok = F.col("status") == "ok"
    held = held.withColumn("statistic", F.when(ok, F.col("estimate") / F.col("std_error")))
    tail = t_two_sided_tail("statistic", F.lit(float(n - p))) if family != "binomial_presence" else _normal_two_sided("statistic")
    held = held.withColumn("p_value", tail).withColumns({
        c: F.when(ok, F.col(c)) for c in ("estimate", "std_error")})
    return bh_adjust(held.select(
        "feature_id", "coefficient", "estimate", "std_error", "statistic", "p_value", "nonzero_units", "total_units", "status"))


def _normal_two_sided(column: str) -> Column:
    from cellwire.functions.tails import normal_upper_tail
    return 2 * normal_upper_tail(F.abs(F.col(column)))


def _fit_presence(scores: DataFrame, rows: DataFrame, unit: str, p: int, k: int, threshold: float) -> DataFrame:
    totals = rows.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    present = scores.where(F.col("score") > threshold).join(rows, unit).groupBy("feature_id", "x").agg(F.count(F.lit(1)).alias("k"))
    features = scores.select("feature_id").distinct()
    # Distinct design rows, numbered so that every feature meets each of them once.
    grid = complete_grid(
        totals.withColumn("_id", F.concat_ws(",", F.transform("x", lambda v: v.cast("string")))), features, "_id", "feature_id"
    ).join(totals.withColumn("_id", F.concat_ws(",", F.transform("x", lambda v: v.cast("string")))), "_id")
    table = grid.join(present, ["feature_id", "x"], "left").select(
        "feature_id", "x", F.col("n").cast("double").alias("n"), F.coalesce("k", F.lit(0)).cast("double").alias("k"))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        x, n, hits = np.stack(part["x"].to_numpy()), part["n"].to_numpy(), part["k"].to_numpy()
        beta, cov, state = logistic_fit(x, n, hits)
        return pd.DataFrame({"feature_id": [part["feature_id"].iloc[0]], "estimate": [beta[k]],
                             "std_error": [np.sqrt(cov[k, k]) if cov is not None else np.nan], "_fit": [state]})

    return table.groupBy("feature_id").applyInPandas(fit, "feature_id string, estimate double, std_error double, _fit string")


def logistic_fit(x: np.ndarray, n: np.ndarray, k: np.ndarray, rounds: int = 25):
    """Iteratively reweighted least squares on counts ``k`` of ``n`` per design row."""
    start = np.log(3.0)
    weight = np.full(len(n), 0.1875) * n
    # First step from the usual starting values 3/4 for presence and 1/4 for absence.
    target = np.where(n > 0, ((start + 0.25 / 0.1875) * k - (start + 0.25 / 0.1875) * (n - k)) / np.maximum(n, 1), 0.0)
    deviance, cov = None, None
    for _ in range(rounds):
        moments = x.T @ (x * weight[:, None])
        if np.linalg.matrix_rank(moments) < x.shape[1]:
            return np.full(x.shape[1], np.nan), None, "rank_deficient"
        cov = np.linalg.inv(moments)
        beta = cov @ (x.T @ (weight * target))
        eta = x @ beta
        mu = np.clip(1 / (1 + np.exp(-eta)), 1e-15, 1 - 1e-15)
        current = -2 * np.sum(k * np.log(mu) + (n - k) * np.log1p(-mu))
        weight = n * mu * (1 - mu)
        target = eta + (k / np.maximum(n, 1) - mu) / (mu * (1 - mu))
        if deviance is not None and abs(current - deviance) / (abs(current) + 0.1) < 1e-8:
            # Errors at the converged fit rather than one step before it.
            return beta, np.linalg.inv(x.T @ (x * weight[:, None])), "ok"
        deviance = current
    return beta, cov, "fit_failed"


def fit_lmm(
    scores: DataFrame, units: DataFrame, design: Design, coefficient: str, reml: bool = False,
    min_units: int = 6, min_nonzero: int = 2, max_zero_fraction: float = 0.98, min_response_sd: float = 1e-12,
) -> DataFrame:
    """Random patient intercept model of log1p(score) per feature, Wald test, BH over the fitted.

    The likelihood depends on the data only through sums over patients with equally many sections.
    These sums are plain aggregates; the one-dimensional search over the variance ratio then runs on
    a few numbers per feature.
    """
    names = [n for n, _ in design]
    k, p = names.index(coefficient) + 1, len(names) + 1
    rows = materialize(units.select("section_id", "patient_id", _x(design).alias("x")))
    sizes = rows.groupBy("patient_id").agg(F.count(F.lit(1)).alias("_n"))
    n = rows.count()
    sums = [F.sum(F.col("x")[i]).alias(f"t{i}") for i in range(p)]
    per_patient = rows.groupBy("patient_id").agg(F.count(F.lit(1)).alias("_n"), *sums)
    x = lambda i: F.col("x")[i]
    # p * p sums per distinct number of sections: what the driver sees is bounded by that number.
    cross = rows.join(sizes, "patient_id").groupBy("_n").agg(*[F.sum(x(i) * x(j)).alias(f"c{i}_{j}") for i in range(p) for j in range(p)])
    outer = per_patient.groupBy("_n").agg(F.count(F.lit(1)).alias("_p"), *[
        F.sum(F.col(f"t{i}") * F.col(f"t{j}")).alias(f"o{i}_{j}") for i in range(p) for j in range(p)])
    known = sorted(cross.join(outer, "_n").collect(), key=lambda r: r["_n"])
    order = [r["_n"] for r in known]
    xx = np.array([[[r[f"c{i}_{j}"] for j in range(p)] for i in range(p)] for r in known], dtype=float)
    x1 = np.array([[[r[f"o{i}_{j}"] for j in range(p)] for i in range(p)] for r in known], dtype=float)
    patients = np.array([r["_p"] for r in known], dtype=float)
    y = scores.withColumn("y", F.log1p("score")).join(rows, "section_id")
    inner = y.groupBy("feature_id", "patient_id").agg(
        F.sum("y").alias("_y"), F.sum(F.col("y") * F.col("y")).alias("_yy"), F.count(F.lit(1)).alias("_k"),
        *[F.sum(x(i) * F.col("y")).alias(f"a{i}") for i in range(p)])
    held = inner.join(per_patient, "patient_id").groupBy("feature_id", "_n").agg(
        F.sum("_k").alias("k"), F.sum("_y").alias("y"), F.sum("_yy").alias("yy"), F.sum(F.col("_y") * F.col("_y")).alias("y1"),
        F.array(*[F.sum(f"a{i}") for i in range(p)]).alias("a"),
        F.array(*[F.sum(F.col(f"t{i}") * F.col("_y")) for i in range(p)]).alias("b"))
    stats = held.groupBy("feature_id").agg(F.collect_list(F.struct("_n", "k", "y", "yy", "y1", "a", "b")).alias("parts"))
    rank_ok = _invert(xx.sum(axis=0)) is not None
    limits = (min_units, min_nonzero, max_zero_fraction, min_response_sd)

    def fit(batches):
        for part in batches:
            yield _fit_lmm_batch(part, order, xx, x1, patients, n, k, p, reml, rank_ok, limits)

    schema = ("feature_id string, nonzero_units long, total_units long, patient_count long, zero_fraction double, response_sd double, "
              "estimate double, std_error double, statistic double, singular boolean, random_effect_variance double, "
              "residual_variance double, status string")
    fitted = stats.mapInPandas(fit, schema)
    held = fitted.withColumn("coefficient", F.lit(coefficient)).withColumn("p_value", _normal_two_sided("statistic"))
    return bh_adjust(held)


def profile_lmm(theta, order, xx, x1, patients, n, a, b, yy, y1, reml):
    """Deviance, coefficients, scale and information of the model at relative deviation ``theta``."""
    size = np.array(order, dtype=float)
    gamma = theta ** 2 / (1 + size * theta ** 2)
    info = np.tensordot(np.ones(len(size)), xx, 1) - np.tensordot(gamma, x1, 1)
    right = a.sum(axis=0) - gamma @ b
    beta = np.linalg.solve(info, right)
    r2 = yy.sum() - gamma @ y1 - beta @ right
    logdet = patients @ np.log1p(size * theta ** 2)
    df = n - len(beta) if reml else n
    deviance = logdet + df * (1 + np.log(2 * np.pi * max(r2, 1e-300) / df))
    if reml:
        deviance += np.linalg.slogdet(info)[1]
    return deviance, beta, r2 / df, info


def search_theta(deviance) -> float:
    """Minimum over theta >= 0: a coarse grid, then golden section in the best interval."""
    grid = np.concatenate([[0.0], np.logspace(-3, 3, 61)])
    values = np.array([deviance(t) for t in grid])
    best = int(np.argmin(values))
    # As long as the deviance still falls at the end, look further; beyond 1e12 it is flat in floating point.
    while best == len(grid) - 1 and grid[-1] < 1e12:
        more = grid[-1] * np.logspace(0.1, 2, 20)
        grid = np.concatenate([grid, more])
        values = np.concatenate([values, [deviance(t) for t in more]])
        best = int(np.argmin(values))
    low, high = grid[max(best - 1, 0)], grid[min(best + 1, len(grid) - 1)]
    ratio = (np.sqrt(5) - 1) / 2
    for _ in range(80):
        left, right = high - ratio * (high - low), low + ratio * (high - low)
        if deviance(left) <= deviance(right):
            high = right
        else:
            low = left
        if high - low < 1e-9 * (1 + low):
            break
    middle = (low + high) / 2
    return 0.0 if values[0] <= deviance(middle) else middle


def _fit_lmm_batch(part, order, xx, x1, patients, n, k, p, reml, rank_ok, limits):
    min_units, min_nonzero, max_zero, min_sd = limits
    out = []
    for feature, parts in zip(part["feature_id"], part["parts"]):
        index = {r["_n"]: r for r in parts}
        pick = lambda key, zero: np.array([index[m][key] if m in index else zero for m in order], dtype=float)
        y, yy, y1, hits = pick("y", 0), pick("yy", 0), pick("y1", 0), pick("k", 0)
        a, b = pick("a", np.zeros(p)), pick("b", np.zeros(p))
        nonzero = int(hits.sum())
        sd = float(np.sqrt(max(yy.sum() - y.sum() ** 2 / n, 0) / (n - 1))) if n > 1 else np.nan
        zero = 1 - nonzero / n
        row = dict(feature_id=feature, nonzero_units=nonzero, total_units=n, patient_count=int(patients.sum()),
                   zero_fraction=zero, response_sd=sd, status="ok", estimate=None, std_error=None, statistic=None,
                   singular=None, random_effect_variance=None, residual_variance=None)
        if not rank_ok:
            row["status"] = "rank_deficient"
        elif n < min_units:
            row["status"] = "insufficient_units"
        elif nonzero < min_nonzero:
            row["status"] = "insufficient_nonzero"
        elif zero > max_zero:
            row["status"] = "insufficient_zero_support"
        elif not np.isfinite(sd) or sd <= min_sd:
            row["status"] = "insufficient_variation"
        else:
            args = (order, xx, x1, patients, n, a / sd, b / sd, yy / sd ** 2, y1 / sd ** 2, reml)
            try:
                theta = search_theta(lambda t: profile_lmm(t, *args)[0])
                _, beta, sigma2, info = profile_lmm(theta, *args)
                se = np.sqrt(sigma2 * np.linalg.inv(info)[k, k])
                row.update(estimate=beta[k] * sd, std_error=se * sd, statistic=beta[k] / se, singular=bool(theta < 1e-4),
                           random_effect_variance=theta ** 2 * sigma2 * sd ** 2, residual_variance=sigma2 * sd ** 2)
            except np.linalg.LinAlgError:
                row["status"] = "numerical_failure"
        out.append(row)
    return pd.DataFrame(out)


def fit_hc3(
    scores: DataFrame, units: DataFrame, design: Design, coefficient: str, runs: Sequence[str] = (), min_df: int = 3
) -> DataFrame:
    """Patient-level regression of mean log1p scores with HC3 errors, t test, interval and BH."""
    patients, y = patient_table(units, runs), patient_responses(scores, units)
    names = [n for n, _ in design]
    k, p = names.index(coefficient) + 1, len(names) + 1
    rows = materialize(patients.select("patient_id", _x(design).alias("x")))
    n = rows.count()
    inverse = _invert(_moments(rows, p))
    if inverse is None:
        raise ValueError("the patient design is not identifiable")
    if n - p < min_df:
        raise ValueError("too few residual degrees of freedom")
    leverage = reduce(lambda a, b: a + b, [F.col("x")[i] * _dot(inverse[i], "x", p) for i in range(p)])
    held = rows.withColumn("_h", leverage).withColumn("_w", _dot(inverse[k], "x", p))
    held = held.withColumn("_c", F.pow(F.col("_w") / (1 - F.col("_h")), F.lit(2.0)))
    if not held.where(F.col("_h") >= 1 - 1e-10).isEmpty():
        raise ValueError("a patient has leverage one")
    middle = _moments(held, p, F.col("_c"))
    s = y.join(held, "patient_id").groupBy("feature_id").agg(
        *_vector_sum(p, F.col("y")), *[F.sum(F.col("_c") * F.col("x")[i] * F.col("y")).alias(f"q{i}") for i in range(p)],
        F.sum(F.col("_c") * F.col("y") * F.col("y")).alias("_cyy"), F.sum("y").alias("_y"),
        F.sum(F.col("y") * F.col("y")).alias("_yy"), F.count(F.lit(1)).alias("nonzero_patients"))
    s = s.withColumn("_s", F.array(*[F.col(f"s{i}") for i in range(p)])).withColumn(
        "_b", F.array(*[_dot(inverse[i], "_s", p) for i in range(p)]))
    cross = reduce(lambda a, b: a + b, [F.col("_b")[i] * F.col(f"q{i}") for i in range(p)])
    square = reduce(lambda a, b: a + b, [F.col("_b")[i] * _dot(middle[i], "_b", p) for i in range(p)])
    variance = F.greatest(F.col("_cyy") - 2 * cross + square, F.lit(0.0))
    sd = F.sqrt(F.greatest((F.col("_yy") - F.col("_y") * F.col("_y") / n) / (n - 1), F.lit(0.0)))
    out = s.withColumns({"estimate": F.col("_b")[k], "std_error": F.sqrt(variance), "_sd": sd}).withColumns({
        "residual_df": F.lit(float(n - p)), "total_patients": F.lit(n)})
    return _t_inference(out, (F.col("nonzero_patients") >= 2) & (F.col("_sd") > 1e-12) & (F.col("std_error") > 0))


def _t_inference(out: DataFrame, eligible: Column) -> DataFrame:
    """t test, interval, status and BH from estimate, std_error and residual_df."""
    held = out.withColumn("_ok", F.coalesce(eligible, F.lit(False))).withColumn("_t", F.when(F.col("_ok"), F.col("estimate") / F.col("std_error")))
    held = held.withColumn("p_value", t_two_sided_tail("_t", "residual_df")).withColumn("_q", t_critical("residual_df"))
    held = held.withColumns({
        "ci_lower": F.col("estimate") - F.col("_q") * F.col("std_error"),
        "ci_upper": F.col("estimate") + F.col("_q") * F.col("std_error"),
        "status": F.when(F.col("_ok"), "ok").otherwise("insufficient_support_or_variation")})
    return bh_adjust(held.select("feature_id", "estimate", "std_error", "ci_lower", "ci_upper", "p_value", "residual_df",
                                 "total_patients", "nonzero_patients", "status"))


def welch_contrast(scores: DataFrame, units: DataFrame, control: str = "Control", disease: str = "Disease") -> DataFrame:
    """Difference of condition means of the patient responses with unequal variances."""
    patients, y = patient_table(units), patient_responses(scores, units)
    sizes = {r["condition"]: r["n"] for r in patients.groupBy("condition").agg(F.count(F.lit(1)).alias("n")).collect()}
    owned = y.join(patients.select("patient_id", "condition"), "patient_id")
    aggs = []
    for tag, c in (("d", disease), ("c", control)):
        mine = F.when(F.col("condition") == c, F.col("y"))
        aggs += [F.coalesce(F.sum(mine), F.lit(0.0)).alias(f"_s{tag}"), F.coalesce(F.sum(mine * mine), F.lit(0.0)).alias(f"_q{tag}")]
    s = owned.groupBy("feature_id").agg(*aggs, F.count(F.lit(1)).alias("nonzero_patients"))
    nd, nc = sizes[disease], sizes[control]
    part = lambda t, m: F.greatest(F.col(f"_q{t}") - F.col(f"_s{t}") * F.col(f"_s{t}") / m, F.lit(0.0)) / (m - 1) / m
    s = s.withColumn("_vd", part("d", nd)).withColumn("_vc", part("c", nc))
    total = F.col("_vd") + F.col("_vc")
    s = s.withColumns({
        "estimate": F.col("_sd") / nd - F.col("_sc") / nc, "std_error": F.sqrt(total),
        "residual_df": F.when(total > 0, total * total / (F.col("_vd") * F.col("_vd") / (nd - 1) + F.col("_vc") * F.col("_vc") / (nc - 1))),
        "total_patients": F.lit(nd + nc)})
    return _t_inference(s, (F.col("nonzero_patients") >= 2) & (F.col("std_error") > 1e-12))


def leave_one_out(
    scores: DataFrame, units: DataFrame, design: Design, coefficient: str, runs: Sequence[str] = ()
) -> DataFrame:
    """Estimate without each patient, per (omitted patient, feature), next to the full estimate.

    The estimate without one patient follows from the full fit, the patient's residual and leverage,
    so no model is refitted.
    """
    patients, y = patient_table(units, runs), patient_responses(scores, units)
    names = [n for n, _ in design]
    k, p = names.index(coefficient) + 1, len(names) + 1
    rows = materialize(patients.select("patient_id", _x(design).alias("x")))
    inverse = _invert(_moments(rows, p))
    if inverse is None:
        raise ValueError("the patient design is not identifiable")
    fit = y.join(rows, "patient_id").groupBy("feature_id").agg(*_vector_sum(p, F.col("y")))
    fit = fit.withColumn("_s", F.array(*[F.col(f"s{i}") for i in range(p)])).select(
        "feature_id", F.array(*[_dot(inverse[i], "_s", p) for i in range(p)]).alias("_b"))
    leverage = reduce(lambda a, b: a + b, [F.col("x")[i] * _dot(inverse[i], "x", p) for i in range(p)])
    held = rows.withColumn("_h", leverage).withColumn("_w", _dot(inverse[k], "x", p))
    grid = complete_grid(rows, fit, "patient_id", "feature_id").join(held, "patient_id").join(fit, "feature_id").join(
        y, ["patient_id", "feature_id"], "left")
    fitted = reduce(lambda a, b: a + b, [F.col("x")[i] * F.col("_b")[i] for i in range(p)])
    residual = F.coalesce("y", F.lit(0.0)) - fitted
    return grid.select(
        F.col("patient_id").alias("omitted_patient"), "feature_id", F.col("_b")[k].alias("full_estimate"),
        (F.col("_b")[k] - F.col("_w") * residual / (1 - F.col("_h"))).alias("estimate"))


def leave_one_out_tests(
    scores: DataFrame, units: DataFrame, design: Design, coefficient: str, runs: Sequence[str] = ()
) -> DataFrame:
    """HC3 test without each patient, per (omitted patient, feature), BH within each omission.

    Weights and leverages without a patient depend only on the design row of that patient, and the
    responses enter as sums per design row, so the refits are joins of small tables.
    """
    patients, y = patient_table(units, runs), patient_responses(scores, units)
    names = [n for n, _ in design]
    k, p = names.index(coefficient) + 1, len(names) + 1
    rows = patients.select("patient_id", _x(design).alias("x"))
    n = rows.count()
    inverse = _invert(_moments(rows, p))
    if inverse is None or n - 1 - p < 1:
        raise ValueError("the patient design is not identifiable")
    row_id = F.md5(F.concat_ws(",", F.transform("x", lambda v: v.cast("string"))))
    rows = materialize(rows.withColumn("row", row_id))
    total = lambda f: reduce(lambda a, b: a + b, [f(i) for i in range(p)])
    kinds = rows.groupBy("row").agg(F.first("x").alias("x"), F.count(F.lit(1)).alias("n")).withColumn(
        "u", F.array(*[_dot(inverse[i], "x", p) for i in range(p)])).withColumn(
        "h", total(lambda i: F.col("x")[i] * F.col("u")[i]))
    kinds = materialize(kinds)
    # Every design row i seen without a patient of design row d.
    out_kind = kinds.select(F.col("row").alias("out"), F.col("u").alias("du"), F.col("h").alias("dh"))
    pairs = complete_grid(kinds, out_kind, "row", "out").join(kinds, "row").join(out_kind, "out")
    dot = total(lambda i: F.col("du")[i] * F.col("x")[i])
    pairs = pairs.withColumn("_d", dot).withColumn("w", F.col("u")[k] + F.col("du")[k] * F.col("_d") / (1 - F.col("dh"))).withColumn(
        "_lev", F.col("h") + F.col("_d") * F.col("_d") / (1 - F.col("dh"))).withColumn("c", F.pow(F.col("w") / (1 - F.col("_lev")), F.lit(2.0)))
    pairs = materialize(pairs.select("row", "out", "x", "n", "c"))
    fixed = pairs.groupBy("out").agg(F.array(*[F.sum(F.col("c") * F.col("n") * F.col("x")[i] * F.col("x")[j]) for i in range(p) for j in range(p)]).alias("cxx"))
    own = pairs.where("row = out").select("out", F.col("c").alias("c_own"))
    sums = y.join(rows.select("patient_id", "row"), "patient_id").groupBy("feature_id", "row").agg(
        F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy"), F.count(F.lit(1)).alias("m"))
    sums = materialize(sums)
    moved = sums.join(pairs, "row").groupBy("feature_id", "out").agg(
        F.sum(F.col("c") * F.col("syy")).alias("cyy"), F.array(*[F.sum(F.col("c") * F.col("x")[i] * F.col("sy")) for i in range(p)]).alias("cxy"))
    fit = sums.join(kinds.select("row", "x"), "row").groupBy("feature_id").agg(
        *_vector_sum(p, F.col("sy")), F.sum("sy").alias("_y"), F.sum("syy").alias("_yy"), F.sum("m").alias("_m"))
    fit = fit.withColumn("_s", F.array(*[F.col(f"s{i}") for i in range(p)])).select(
        "feature_id", F.array(*[_dot(inverse[i], "_s", p) for i in range(p)]).alias("b"), "_y", "_yy", "_m")
    small = rows.join(kinds.select("row", "u", "h"), "row").join(fixed.withColumnRenamed("out", "row"), "row").join(own.withColumnRenamed("out", "row"), "row")
    grid = complete_grid(rows, fit, "patient_id", "feature_id").join(small, "patient_id").join(fit, "feature_id").join(
        y, ["patient_id", "feature_id"], "left").fillna(0.0, ["y"]).join(moved.withColumnRenamed("out", "row"), ["feature_id", "row"])
    residual = F.col("y") - total(lambda i: F.col("x")[i] * F.col("b")[i])
    grid = grid.withColumn("_e", residual / (1 - F.col("h"))).withColumn(
        "bk", F.array(*[F.col("b")[i] - F.col("u")[i] * F.col("_e") for i in range(p)]))
    square = total(lambda i: F.col("bk")[i] * total(lambda j: F.col("cxx")[i * p + j] * F.col("bk")[j]))
    left_out = F.col("y") - total(lambda i: F.col("x")[i] * F.col("bk")[i])
    variance = F.col("cyy") - 2 * total(lambda i: F.col("bk")[i] * F.col("cxy")[i]) + square - F.col("c_own") * left_out * left_out
    nonzero = F.col("_m") - (F.col("y") > 0).cast("long")
    spread = (F.col("_yy") - F.col("y") * F.col("y")) - F.pow(F.col("_y") - F.col("y"), F.lit(2.0)) / (n - 1)
    held = grid.select(
        F.col("patient_id").alias("omitted_patient"), "feature_id", F.col("b")[k].alias("full_estimate"), F.col("bk")[k].alias("estimate"),
        F.sqrt(F.greatest(variance, F.lit(0.0))).alias("std_error"), nonzero.alias("nonzero_patients"), F.sqrt(F.greatest(spread, F.lit(0.0))).alias("_sd"))
    ok = (F.col("nonzero_patients") >= 2) & (F.col("_sd") > 1e-12) & (F.col("std_error") > 0)
    held = held.withColumn("status", F.when(ok, "ok").otherwise("insufficient_support_or_variation")).withColumn(
        "_t", F.when(ok, F.col("estimate") / F.col("std_error")))
    held = held.withColumn("p_value", t_two_sided_tail("_t", F.lit(float(n - 1 - p)))).drop("_t", "_sd")
    return bh_adjust(held, keys=["omitted_patient"])


def omission_hits(tests: DataFrame, full: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Per feature: valid omissions, omissions with a BH hit and the largest q value."""
    hit = F.coalesce(F.col("q_value") < alpha, F.lit(False))
    return tests.groupBy("feature_id").agg(
        F.count("q_value").alias("valid_omissions"), F.count(F.when(hit, 1)).alias("bh_hit_omissions"), F.max("q_value").alias("maximum_q")
    ).join(full.select("feature_id", F.coalesce(F.col("q_value") < alpha, F.lit(False)).alias("full_hit")), "feature_id", "left")


def omission_retention(tests: DataFrame, full: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Per omitted patient: valid features, hits and the share of the full hits that remain."""
    held = tests.join(full.select("feature_id", F.coalesce(F.col("q_value") < alpha, F.lit(False)).alias("_full")), "feature_id")
    hit = F.coalesce(F.col("q_value") < alpha, F.lit(False))
    count = lambda c: F.count(F.when(c, 1))
    return held.groupBy("omitted_patient").agg(
        count(F.col("status") == "ok").alias("valid_features"), count(hit).alias("bh_hits"), count(hit & F.col("_full")).alias("full_hits_retained"),
        (count(hit & F.col("_full")) / F.greatest(F.lit(1), count(F.col("_full")))).alias("full_hit_fraction_retained"))


MARGIN = 1e-12


def agreement(left: str, right: str) -> Column:
    """1.0 where two estimates have one sign. One that is tiny beside the other is rounding and counts as 0."""
    floor = F.lit(MARGIN) * F.greatest(F.abs(F.col(left)), F.abs(F.col(right)))
    sign = lambda c: F.when(F.abs(F.col(c)) <= floor, F.lit(0.0)).otherwise(F.signum(F.col(c)))
    return (sign(left) == sign(right)).cast("double")


def significant(column: str) -> Column:
    """Twelve significant digits, so that ranks tie by a relative margin at any size."""
    return F.format_string("%.11e", F.col(column)).cast("double")


def omission_summary(omissions: DataFrame, by: str = "feature_id") -> DataFrame:
    """Range of the estimates and share of equal direction per feature (or per patient)."""
    sign = agreement("estimate", "full_estimate")
    out = omissions.groupBy(by).agg(
        F.min("estimate").alias("estimate_min"), F.max("estimate").alias("estimate_max"), F.avg(sign).alias("direction_agreement"))
    if by == "feature_id":
        return out
    ranks = spearman(omissions.select(by, significant("estimate").alias("a"), significant("full_estimate").alias("b")), [by], "a", "b", "estimate_spearman")
    return out.join(ranks, by)


def balanced_effects(
    scores: DataFrame, units: DataFrame, design: Design, coefficient: str, replicates: int, seed: int = 1,
    runs: Sequence[str] = (), control: str = "Control", limit: int = ROWS_PER_TASK,
) -> DataFrame:
    """Effects in repeated subsets with all controls and equally many drawn cases, per feature.

    2.5, 50 and 97.5 percentiles, range and direction agreement with the full estimate.
    """
    patients, y = patient_table(units, runs), patient_responses(scores, units)
    names = [n for n, _ in design]
    k, p = names.index(coefficient) + 1, len(names) + 1
    rows = materialize(patients.select("patient_id", "condition", _x(design).alias("x")))
    is_control = F.col("condition") == control
    tally = rows.agg(F.count(F.when(is_control, 1)).alias("c"), F.count(F.when(~is_control, 1)).alias("d")).first()
    copies = rows.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn(
        "_h", hash_order(seed, F.col("b"), F.col("patient_id")))
    drawn = copies.where(~is_control).withColumn("_part", F.substring("_h", 1, 3) if tally["d"] > limit else F.lit(""))
    drawn = running(drawn, ["b"], [F.col("_h"), F.col("patient_id")], F.lit(1), "_rank", "_part").where(F.col("_rank") <= tally["c"])
    chosen = copies.where(is_control).select("b", "patient_id", "x").unionByName(drawn.select("b", "patient_id", "x"))
    full = _invert(_moments(rows, p))
    if full is None:
        raise ValueError("the patient design is not identifiable")
    moments = chosen.groupBy("b").agg(F.array(*[F.sum(F.col("x")[i] * F.col("x")[j]) for i in range(p) for j in range(p)]).alias("m"))

    @F.pandas_udf("array<double>")
    def weights(m: pd.Series) -> pd.Series:
        return m.map(lambda v: np.linalg.pinv(np.asarray(v, dtype=float).reshape(p, p))[k])

    row = moments.select("b", weights("m").alias("_r"))
    sums = chosen.join(y, "patient_id").groupBy("b", "feature_id").agg(*_vector_sum(p, F.col("y")))
    effect = reduce(lambda a, b: a + b, [F.col("_r")[i] * F.col(f"s{i}") for i in range(p)])
    found = sums.join(row, "b").select("b", "feature_id", effect.alias("effect"))
    whole = y.join(rows, "patient_id").groupBy("feature_id").agg(*_vector_sum(p, F.col("y"))).select(
        "feature_id", reduce(lambda a, b: a + b, [F.lit(float(full[k, i])) * F.col(f"s{i}") for i in range(p)]).alias("full_estimate"))
    grid = whole.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).join(found, ["b", "feature_id"], "left").fillna(0.0, ["effect"])
    sign = agreement("effect", "full_estimate")
    stats = grid.groupBy("feature_id").agg(
        F.min("effect").alias("minimum"), F.max("effect").alias("maximum"), F.avg(sign).alias("direction_agreement"))
    q = quantiles(grid, ["feature_id"], "effect", [0.025, 0.5, 0.975], ["descriptive_p025", "median", "descriptive_p975"])
    return stats.join(q, "feature_id")


# ---- comparison of models ---------------------------------------------------------------------
def _available(prefix: str = "") -> Column:
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    return (F.col(f"{prefix}status") == "ok") & finite(f"{prefix}q_value") & finite(f"{prefix}estimate")


def evidence_labels(primary: DataFrame, run_adjusted: DataFrame, patient: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Five exclusive labels from three model tables (fixed label values)."""
    pick = lambda t, s: t.select("feature_id", *[F.col(c).alias(f"{s}{c}") for c in ("estimate", "q_value", "status")])
    held = pick(primary, "p_").join(pick(run_adjusted, "r_"), "feature_id").join(pick(patient, "h_"), "feature_id")
    ok = {s: F.coalesce(_available(s), F.lit(False)) for s in ("p_", "r_", "h_")}
    hit = {s: ok[s] & (F.col(f"{s}q_value") < alpha) for s in ok}
    same = F.coalesce((F.signum("p_estimate") == F.signum("r_estimate")) & (F.signum("p_estimate") == F.signum("h_estimate")), F.lit(False))
    all_ok = ok["p_"] & ok["r_"] & ok["h_"]
    label = (
        F.when(hit["p_"] & hit["r_"] & hit["h_"] & same, "supported_by_run_and_patient_sensitivity")
        .when(hit["p_"] & all_ok, "primary_hit_sensitivity_dependent").when(hit["p_"], "primary_hit_sensitivity_unavailable")
        .when(~ok["p_"], "primary_fit_unavailable").otherwise("not_primary_hit")
    )
    return held.select("feature_id", F.col("p_q_value").alias("primary_q"), F.col("r_q_value").alias("run_adjusted_q"),
                       F.col("h_q_value").alias("patient_q"), all_ok.alias("all_models_available"),
                       same.alias("same_direction"), label.alias("evidence_label"))


def compare_models(primary: DataFrame, models: dict[str, DataFrame], alpha: float = 0.05) -> DataFrame:
    """Hits, retained hits, common fits, rank correlation and direction agreement of each model."""
    base = primary.select("feature_id", F.col("estimate").alias("_e"), F.col("status").alias("_s"), F.col("q_value").alias("_q"))
    tagged = [m.select("feature_id", "estimate", "status", "q_value", F.lit(name).alias("model")) for name, m in models.items()]
    held = reduce(lambda a, b: a.unionByName(b), tagged).join(base, "feature_id")
    hit = (F.col("status") == "ok") & (F.col("q_value") < alpha)
    first = (F.col("_s") == "ok") & (F.col("_q") < alpha)
    common = (F.col("status") == "ok") & (F.col("_s") == "ok")
    count = lambda c: F.count(F.when(c, 1))
    same = (F.signum("estimate") == F.signum("_e")).cast("double")
    out = held.groupBy("model").agg(
        F.count(F.lit(1)).alias("features"), count(F.col("status") == "ok").alias("valid_features"), count(hit).alias("bh_hits"),
        count(hit & first).alias("primary_hits_retained"), (count(hit & first) / count(first)).alias("primary_hit_retention"),
        count(common).alias("common_valid"), F.avg(F.when(common, same)).alias("direction_agreement"))
    ranks = spearman(held.where(common).select("model", significant("estimate").alias("a"), significant("_e").alias("b")), ["model"], "a", "b", "effect_spearman")
    return out.join(ranks, "model", "left")


def hit_overlap(left: DataFrame, right: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Significant features of two models: counts, Jaccard, rank correlation, direction agreement."""
    pick = lambda t, s: t.select("feature_id", *[F.col(c).alias(f"{s}{c}") for c in ("estimate", "q_value", "status")])
    held = pick(left, "l_").join(pick(right, "r_"), "feature_id")
    hit = {s: F.coalesce((F.col(f"{s}status") == "ok") & (F.col(f"{s}q_value") < alpha), F.lit(False)) for s in ("l_", "r_")}
    common = (F.col("l_status") == "ok") & (F.col("r_status") == "ok")
    count = lambda c: F.count(F.when(c, 1))
    same = (F.signum("l_estimate") == F.signum("r_estimate")).cast("double")
    rank = spearman(held.where(common).select(significant("l_estimate").alias("a"), significant("r_estimate").alias("b")), [], "a", "b", "r")
    return held.agg(
        count(hit["l_"]).alias("left_significant"), count(hit["r_"]).alias("right_significant"),
        count(hit["l_"] & hit["r_"]).alias("overlap"), (count(hit["l_"] & hit["r_"]) / F.nullif(count(hit["l_"] | hit["r_"]), F.lit(0))).alias("significant_jaccard"),
        F.avg(F.when(common, same)).alias("direction_agreement"), count(common).alias("paired_valid"),
    ).withColumn("estimate_spearman", rank.select("r").scalar())


def restricted_bh(model: DataFrame, keep: Column) -> DataFrame:
    """BH within a subset of the fitted features, next to the global q values."""
    inside = F.coalesce((F.col("status") == "ok") & keep, F.lit(False))
    held = model.withColumn("eligible", inside).withColumn("_p", F.when(inside, F.col("p_value")))
    return bh_adjust(held, "_p", "subset_q").select("feature_id", "eligible", F.col("q_value").alias("global_q"), "subset_q")


def status_counts(model: DataFrame, column: str = "status") -> DataFrame:
    return model.groupBy(column).agg(F.count(F.lit(1)).alias("features"))


def classify_messages(messages: DataFrame, column: str) -> DataFrame:
    """Ordered classification of convergence messages (fixed patterns) and their counts."""
    m = F.col(column)
    grad, scale = m.contains("max|grad|"), m.contains("very large eigenvalue")
    kind = (
        F.when(m.contains("negative eigen"), "negative_hessian_eigenvalue")
        .when(m.contains("numerically singular"), "numerically_singular_hessian")
        .when(grad & scale, "gradient_and_scale_warning").when(grad, "gradient_warning").when(scale, "scale_warning").otherwise("other")
    )
    return messages.where(m.isNotNull() & (m != "")).groupBy(kind.alias("convergence_class")).agg(F.count(F.lit(1)).alias("features"))


def status_transitions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Cross table of the statuses of two fits of the same features."""
    return before.select("feature_id", F.col("status").alias("baseline_status")).join(
        after.select("feature_id", F.col("status").alias("robust_status")), "feature_id"
    ).groupBy("baseline_status", "robust_status").agg(F.count(F.lit(1)).alias("features"))
