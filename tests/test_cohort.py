import itertools
import math
import random

import numpy as np
import pytest

from cellwire.functions import tails
from cellwire.operators import analytic as an
from cellwire.operators import cohort as co
from cellwire.operators import ranking
from cellwire.operators import support as su


def cohort(spark, seed=2, patients=14, features=6):
    rng = random.Random(seed)
    units, scores, dense = [], [], {}
    for p in range(patients):
        for k in range(1 + p % 3):
            section, cond = f"p{p}-{k}", "Disease" if p % 2 else "Control"
            units.append((section, f"p{p}", cond, f"run{rng.randrange(3)}"))
            for f in range(features):
                v = rng.uniform(0, 4) + (f if cond == "Disease" else 0) if rng.random() < .3 + .1 * f else 0.0
                dense[(section, f"F{f}")] = v
                if v > 0:
                    scores.append((section, f"F{f}", v))
    u = spark.createDataFrame(units, "section_id string, patient_id string, condition string, run string")
    s = spark.createDataFrame(scores, "section_id string, feature_id string, score double")
    return s, u, units, dense


COND = [("conditionDisease", "condition = 'Disease'")]
RUNS = COND + [(f"run{i}", f"run = 'run{i}'") for i in (1, 2)]


def matrix(units, runs=True):
    return np.array([[1.0, u[2] == "Disease", *([u[3] == "run1", u[3] == "run2"] if runs else [])] for u in units], float)


def test_glm_equals_least_squares(spark):
    s, u, units, dense = cohort(spark)
    x = matrix(units)
    inverse = np.linalg.inv(x.T @ x)
    for r in co.fit_glm(s, u, RUNS, "conditionDisease").collect():
        y = np.log1p([dense[(a[0], r["feature_id"])] for a in units])
        beta = inverse @ x.T @ y
        se = math.sqrt(((y - x @ beta) ** 2).sum() / (len(y) - 4) * inverse[1, 1])
        assert r["status"] == "ok"
        assert (r["estimate"], r["std_error"]) == (pytest.approx(beta[1]), pytest.approx(se))
        assert r["p_value"] == pytest.approx(float(tails.t_two_sided(beta[1] / se, len(y) - 4)))


def test_lmm_equals_direct_likelihood(spark):
    s, u, units, dense = cohort(spark)
    x, n = matrix(units), len(units)
    group = np.array([a[1] for a in units])
    same = (group[:, None] == group[None, :]).astype(float)
    for reml in (False, True):
        for r in co.fit_lmm(s, u, RUNS, "conditionDisease", reml=reml).collect():
            y = np.log1p([dense[(a[0], r["feature_id"])] for a in units])

            def deviance(theta):
                v = np.eye(n) + theta ** 2 * same
                vi = np.linalg.inv(v)
                info = x.T @ vi @ x
                beta = np.linalg.solve(info, x.T @ vi @ y)
                r2 = (y - x @ beta) @ vi @ (y - x @ beta)
                df = n - 4 if reml else n
                out = np.linalg.slogdet(v)[1] + df * (1 + math.log(2 * math.pi * r2 / df)) + (np.linalg.slogdet(info)[1] if reml else 0)
                return out, beta, math.sqrt(r2 / df * np.linalg.inv(info)[1, 1])

            theta = math.sqrt(r["random_effect_variance"] / r["residual_variance"])
            best = min(deviance(t)[0] for t in np.linspace(0, 4, 801))
            value, beta, se = deviance(theta)
            assert value <= best + 1e-7
            assert (r["estimate"], r["std_error"]) == (pytest.approx(beta[1], rel=1e-6), pytest.approx(se, rel=1e-6))
            assert r["singular"] == (theta < 1e-4)


def test_lmm_screens(spark):
    units = [(f"s{i}", f"p{i // 2}", "Disease" if i % 4 < 2 else "Control", "run0") for i in range(8)]
    u = spark.createDataFrame(units, "section_id string, patient_id string, condition string, run string")
    s = spark.createDataFrame([(f"s{i}", "F1", 1.0) for i in range(8)] + [("s0", "F2", 2.0)], "section_id string, feature_id string, score double")
    got = {r["feature_id"]: r["status"] for r in co.fit_lmm(s, u, COND, "conditionDisease", min_nonzero=1, max_zero_fraction=0.8).collect()}
    assert got == {"F1": "insufficient_variation", "F2": "insufficient_zero_support"}


def test_hc3_and_omissions(spark):
    s, u, units, dense = cohort(spark)
    patients = sorted({a[1] for a in units})
    of = {p: [a for a in units if a[1] == p] for p in patients}
    x = np.array([[1.0, of[p][0][2] == "Disease", np.mean([a[3] == "run1" for a in of[p]]), np.mean([a[3] == "run2" for a in of[p]])] for p in patients])
    design = COND + [(f"f{i}", f"fraction_run{i}") for i in (1, 2)]

    def fit(x, y):
        inverse = np.linalg.inv(x.T @ x)
        beta = inverse @ x.T @ y
        h = np.einsum("ij,jk,ik->i", x, inverse, x)
        e = y - x @ beta
        return beta[1], math.sqrt((((inverse @ x.T)[1]) ** 2 * e ** 2 / (1 - h) ** 2).sum())

    omitted = {(r["omitted_patient"], r["feature_id"]): r["estimate"] for r in co.leave_one_out(s, u, design, "conditionDisease", ["run1", "run2"]).collect()}
    tested = {(r["omitted_patient"], r["feature_id"]): r for r in co.leave_one_out_tests(s, u, design, "conditionDisease", ["run1", "run2"]).collect()}
    for r in co.fit_hc3(s, u, design, "conditionDisease", ["run1", "run2"]).collect():
        y = np.array([np.mean([math.log1p(dense[(a[0], r["feature_id"])]) for a in of[p]]) for p in patients])
        estimate, se = fit(x, y)
        assert (r["estimate"], r["std_error"]) == (pytest.approx(estimate), pytest.approx(se))
        for i, p in enumerate(patients):
            keep = np.arange(len(patients)) != i
            one, error = fit(x[keep], y[keep])
            assert omitted[(p, r["feature_id"])] == pytest.approx(one, abs=1e-9)
            t = tested[(p, r["feature_id"])]
            assert (t["estimate"], t["std_error"]) == (pytest.approx(one, abs=1e-9), pytest.approx(error, rel=1e-6))
            assert t["p_value"] == pytest.approx(float(tails.t_two_sided(one / error, len(patients) - 5)), rel=1e-6)


def test_balanced_effects_bounds(spark):
    s, u, _, _ = cohort(spark)
    design = COND + [("f1", "fraction_run1")]
    for r in co.balanced_effects(s, u, design, "conditionDisease", 12, runs=["run1"]).collect():
        assert r["minimum"] <= r["descriptive_p025"] <= r["median"] <= r["descriptive_p975"] <= r["maximum"]


def test_presence_model_with_covariate(spark):
    s, u, units, dense = cohort(spark, patients=30)
    x = matrix(units)
    for r in co.fit_glm(s, u, RUNS, "conditionDisease", family="binomial_presence").where("status = 'ok'").collect():
        y = np.array([dense[(a[0], r["feature_id"])] > 0 for a in units], float)
        beta = np.zeros(4)
        for _ in range(60):
            mu = 1 / (1 + np.exp(-x @ beta))
            info = x.T @ (x * (mu * (1 - mu))[:, None])
            beta = beta + np.linalg.solve(info, x.T @ (y - mu))
        assert r["estimate"] == pytest.approx(beta[1], abs=1e-4)
        assert r["std_error"] == pytest.approx(math.sqrt(np.linalg.inv(info)[1, 1]), rel=1e-3)


def test_support_enumeration_matches_exact(spark):
    s, u, units, dense = cohort(spark, patients=9, features=5)
    npf, nc = su.patient_totals(u)
    base = su.classify_support(su.support_counts(s, u), [40], npf, nc)
    choices = su.enumerate_choices(u)
    total = choices.select("choice").distinct().count()
    assert total == math.prod(1 + p % 3 for p in range(9))
    shares = su.choice_class_shares(su.choice_supports(s, choices), base, total, 40, npf, nc)
    listed = {r["feature_id"]: r for r in shares.collect()}
    exact = {r["feature_id"]: r for r in su.exact_class_probabilities(s, u, 40).collect()}
    assert set(listed) == set(exact)
    for f, r in exact.items():
        for c in su.CLASSES:
            assert r[f"p_{c}"] == pytest.approx(listed[f][f"p_{c}"], abs=1e-10)
    with pytest.raises(ValueError):
        su.enumerate_choices(u, max_choices=10)


def test_support_minima():
    assert [su.minima(p, 26, 9) for p in (40, 50, 60)] == [(11, 4), (13, 5), (16, 6)]


def test_special_functions():
    assert float(tails.t_two_sided(2.0, 10)) == pytest.approx(0.07338803477074039, abs=1e-12)
    assert float(tails.t_quantile(0.975, np.array([31.0]))[0]) == pytest.approx(2.0395134463964, abs=1e-9)
    # Exact limits for 3 of 20 at 99 %.
    assert float(tails.beta_quantile(0.005, 3, 18)) == pytest.approx(0.0176, abs=1e-4)
    x = np.linspace(0.01, 0.99, 25)
    assert tails.incomplete_beta(2.0, 1.0, x) == pytest.approx(x ** 2)


def test_bh_and_ranks_with_ties(spark):
    rng = random.Random(4)
    p = [round(rng.random() ** 2, 2) for _ in range(200)] + [None] * 5
    df = spark.createDataFrame([(i, v) for i, v in enumerate(p)], "id int, p_value double")
    known = sorted((v, i) for i, v in enumerate(p) if v is not None)
    m, q, low = len(known), {}, 1.0
    for rank in range(m, 0, -1):
        low = min(low, known[rank - 1][0] * m / rank)
        q[known[rank - 1][1]] = low
    got = {r["id"]: r["q_value"] for r in ranking.bh_adjust(df).collect()}
    assert all(got[i] == pytest.approx(q[i]) if i in q else got[i] is None for i in got)
    known_df = df.where("p_value IS NOT NULL")
    a = {r["id"]: r["r"] for r in ranking.average_rank(known_df, [], "p_value", "r").collect()}
    b = {r["id"]: r["r"] for r in ranking.average_rank(known_df, [], "p_value", "r", limit=7).collect()}
    assert a == b and sum(a.values()) == 200 * 201 / 2


@pytest.mark.parametrize("limit", [10_000, 5])
def test_quantile_paths(spark, limit):
    rng = random.Random(9)
    values = [round(rng.gauss(0, 3), 1) for _ in range(157)]
    df = spark.createDataFrame([("ab"[i % 2], v) for i, v in enumerate(values)], "k string, v double")
    for r in ranking.quantiles(df, ["k"], "v", [0, .05, .5, .97, 1], list("vwxyz"), limit).collect():
        part = [v for i, v in enumerate(values) if "ab"[i % 2] == r["k"]]
        assert [r[c] for c in "vwxyz"] == pytest.approx(list(np.quantile(part, [0, .05, .5, .97, 1])))
    whole = ranking.quantiles(df, [], "v", [.25], ["q"], limit).first()["q"]
    assert whole == pytest.approx(np.quantile(values, .25))


@pytest.mark.parametrize("limit", [10_000, 3])
def test_weighted_quantile(spark, limit):
    rows = [("u", float(v), 1.0) for v in (0, 0, 1, 3, 3, 7)] + [("w", float(v), float(w)) for v, w in zip((0, 1, 2, 3, 5, 8), (1, 1, 2, 3, 5, 8))]
    df = spark.createDataFrame(rows, "k string, v double, w double")
    probs = [0, .1, .25, .5, .75, .9, 1]
    got = {r["k"]: [r[f"q{i}"] for i in range(7)] for r in an.weighted_quantiles(df, ["k"], "v", "w", probs, [f"q{i}" for i in range(7)], limit).collect()}
    assert got["u"] == pytest.approx(list(np.quantile([0, 0, 1, 3, 3, 7], probs)))
    assert got["w"][0] == 0 and got["w"][-1] == 8 and got["w"] == sorted(got["w"])
    w = np.array([1, 1, 2, 3, 5, 8]) / 20
    x = np.concatenate([[0], np.cumsum(w)[:-1]]) / (1 - w)
    assert got["w"] == pytest.approx(list(np.interp(probs, x, [0, 1, 2, 3, 5, 8])))
