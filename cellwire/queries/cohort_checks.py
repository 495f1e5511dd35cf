"""SQL of distribution tails, adjusted tests and cohort models, for the checks.

Tails are integrals, taken by Simpson's rule over ``range``; quantiles come bit by bit from the tail. With run
indicators in the design, a covariate is what is left of it after its mean within the run.
"""
from __future__ import annotations

from cellwire.queries.registry import q6

STEPS = 4000


def _simpson(low: str, high: str, value: str) -> str:
    """Integral of ``value`` (of ``u``) from ``low`` to ``high``."""
    weight = f"(CASE WHEN i = 0 OR i = {STEPS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    at = f"(({low}) + i * (({high}) - ({low})) / {STEPS}.0)"
    return f"((({high}) - ({low})) / {STEPS}.0 / 3 * list_sum(list_transform(range({STEPS + 1}), lambda i: {weight} * {value.replace('@', at)})))"


def t_tail(statistic: str, df: str) -> str:
    """Two-sided tail of the t distribution: t = sqrt(df) * tan(u). Beyond nine widths of the integrand nothing is left."""
    low = f"atan(abs({statistic}) / sqrt({df}))"
    high = f"least(pi() / 2, {low} + 9 / sqrt(({df}) - 1))"
    scale = f"exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(pi())"
    return f"least(1.0, 2 * {scale} * {_simpson(low, high, f'pow(greatest(cos(@), 0), ({df}) - 1)')})"


def normal_tail(z: str) -> str:
    """Two-sided tail of the normal distribution."""
    return f"(2 / sqrt(2 * pi()) * {_simpson(f'abs({z})', f'abs({z}) + 10', 'exp(-(@) * (@) / 2)')})"


def t_critical(df: str) -> str:
    """The largest t, in steps down to 2^-40, whose two-sided tail is above 0.05."""
    steps = ", ".join(f"CAST({2.0 ** k!r} AS DOUBLE)" for k in range(4, -41, -1))
    return f"list_reduce([CAST(0 AS DOUBLE), {steps}], lambda t, s: CASE WHEN {t_tail('t + s', df)} > 0.05 THEN t + s ELSE t END)"


def adjusted(source: str, name: str, part: str = "") -> str:
    """Benjamini-Hochberg q values of ``source``, per ``part``, as the table ``name``."""
    over = f"PARTITION BY {part} " if part else ""
    return f"""{name}_ranked AS (SELECT *, row_number() OVER ({over}ORDER BY p_value) AS rk, count(p_value) OVER ({over}) AS m FROM {source}),
{name} AS (SELECT *, least(1.0, min(p_value * m / rk) OVER ({over}ORDER BY p_value DESC, rk DESC ROWS UNBOUNDED PRECEDING)) AS q_value FROM {name}_ranked)"""


# ---- least squares ----------------------------------------------------------------------------
GLM_TESTED = f"tested AS (SELECT *, estimate / std_error AS statistic, {t_tail('estimate / std_error', 'total_units - 2')} AS p_value FROM o)"
RUN_GLM = f"""left_ AS (SELECT feature_id, run, score, ln(1 + score) AS y, CASE WHEN condition = 'Disease' THEN 1.0::DOUBLE ELSE 0.0 END AS x FROM dense),
resid AS (SELECT feature_id, score, y - avg(y) OVER w AS e, x - avg(x) OVER w AS r FROM left_ WINDOW w AS (PARTITION BY feature_id, run)),
slope AS (SELECT feature_id, sum(r * e) / sum(r * r) AS estimate, sum(r * r) AS rr, count(*) AS n, count(*) FILTER (score > 0) AS k FROM resid GROUP BY 1),
fitted AS (SELECT s.feature_id, any_value(estimate) AS estimate, sqrt(sum(pow(e - estimate * r, 2)) / (any_value(n) - 4) / any_value(rr)) AS std_error, any_value(k) AS nonzero_units,
  CAST(any_value(n) AS INTEGER) AS total_units FROM resid JOIN slope s USING (feature_id) GROUP BY 1),
tested AS (SELECT *, estimate / std_error AS statistic, {t_tail('estimate / std_error', 'total_units - 4')} AS p_value FROM fitted)"""
GLM_COLUMNS = f"""feature_id, 'conditionDisease' AS coefficient, {q6('estimate')} AS estimate, {q6('std_error')} AS std_error, {q6('statistic')} AS statistic,
  {q6('p_value')} AS p_value, nonzero_units, CAST(total_units AS INTEGER) AS total_units, 'ok' AS status, {q6('q_value')} AS q_value"""

# ---- patient-level models -----------------------------------------------------------------------
T_COLUMNS = f"""feature_id, {q6('estimate')} AS estimate, {q6('std_error')} AS std_error, {q6('estimate - c * std_error')} AS ci_lower, {q6('estimate + c * std_error')} AS ci_upper,
  {q6('p_value')} AS p_value, {q6('residual_df')} AS residual_df, CAST(total_patients AS BIGINT) AS total_patients, nonzero_patients, 'ok' AS status, {q6('q_value')} AS q_value"""


def t_tested(source: str) -> str:
    return f"tested AS (SELECT *, {t_tail('estimate / std_error', 'residual_df')} AS p_value, {t_critical('residual_df')} AS c FROM ({source}))"


HC3_PLAIN = t_tested("""SELECT feature_id, md - mc AS estimate, sqrt(vd / (nd - 1) + vc / (nc - 1)) AS std_error, CAST(nd + nc - 2 AS DOUBLE) AS residual_df,
  nd + nc AS total_patients, k AS nonzero_patients FROM g""")
WELCH = t_tested("""SELECT feature_id, md - mc AS estimate, sqrt(vd / nd + vc / nc) AS std_error,
  pow(vd / nd + vc / nc, 2) / (pow(vd / nd, 2) / (nd - 1) + pow(vc / nc, 2) / (nc - 1)) AS residual_df, nd + nc AS total_patients, k AS nonzero_patients FROM g""")
HC3_RUNS = f"""px AS (SELECT patient_id, feature_id, run, y, CASE WHEN condition = 'Disease' THEN 1.0::DOUBLE ELSE 0.0 END AS x FROM py),
presid AS (SELECT feature_id, y, y - avg(y) OVER w AS e, x - avg(x) OVER w AS r, count(*) OVER w AS nr FROM px WINDOW w AS (PARTITION BY feature_id, run)),
pslope AS (SELECT feature_id, sum(r * e) / sum(r * r) AS estimate, sum(r * r) AS rr, count(*) AS n, count(*) FILTER (y > 0) AS k FROM presid GROUP BY 1),
runs_fit AS (SELECT s.feature_id, any_value(estimate) AS estimate, sqrt(sum(pow(r * (e - estimate * r) / (1 - 1.0 / nr - r * r / rr), 2))) / any_value(rr) AS std_error,
  CAST(any_value(n) - 4 AS DOUBLE) AS residual_df, any_value(n) AS total_patients, any_value(k) AS nonzero_patients FROM presid JOIN pslope s USING (feature_id) GROUP BY 1),
{t_tested('SELECT * FROM runs_fit')},
{adjusted('tested', 'full_tests')}"""
# Refits without each patient: means of the runs, then slope and errors over all the others.
OMITTED = f"""sums AS (SELECT feature_id, run, count(*) AS n, sum(x) AS sx, sum(y) AS sy FROM px GROUP BY 1, 2),
others AS (SELECT o.patient_id AS omitted_patient, i.feature_id, i.y, s.n - same AS nr, i.x - (s.sx - same * o.x) / (s.n - same) AS r, i.y - (s.sy - same * o.y) / (s.n - same) AS e
  FROM (SELECT a.*, b.run AS other, CASE WHEN a.run = b.run THEN 1 ELSE 0 END AS same FROM px a JOIN (SELECT DISTINCT run FROM px) b ON true) o
  JOIN px i ON i.feature_id = o.feature_id AND i.run = o.other AND i.patient_id <> o.patient_id JOIN sums s ON s.feature_id = i.feature_id AND s.run = i.run),
oslope AS (SELECT omitted_patient, feature_id, sum(r * e) / sum(r * r) AS estimate, sum(r * r) AS rr, count(*) AS n, count(*) FILTER (y > 0) AS nonzero_patients FROM others GROUP BY 1, 2),
ofit AS (SELECT s.omitted_patient, s.feature_id, any_value(s.estimate) AS estimate, sqrt(sum(pow(r * (e - s.estimate * r) / (1 - 1.0 / nr - r * r / rr), 2))) / any_value(rr) AS std_error,
  any_value(n) AS n, any_value(nonzero_patients) AS nonzero_patients FROM others JOIN oslope s USING (omitted_patient, feature_id) GROUP BY 1, 2),
otested AS (SELECT *, {t_tail('estimate / std_error', 'n - 4')} AS p_value FROM ofit),
{adjusted('otested', 'omission_tests', 'omitted_patient')},
omissions AS (SELECT t.*, f.estimate AS full_estimate, f.q_value < 0.05 AS full_hit, t.q_value < 0.05 AS hit FROM omission_tests t JOIN full_tests f USING (feature_id))"""

# ---- random patient intercept -------------------------------------------------------------------
ZOOMS = 7


def mixed_model(reml: bool, by_run: bool) -> str:
    """The profiled deviance over a grid of variance ratios, narrowed around its minimum again and again.

    Covariates are constant within a patient, so a patient with m sections counts with weight m / (1 + m * theta^2)
    through its mean, and the spread inside patients is a constant.
    """
    group = "run" if by_run else "'all'"
    terms = 4 if by_run else 2
    df = f"(n - {terms})" if reml else "n"
    information = "+ slog + ln(a)" if reml else ""

    def deviance(name: str, grid: str) -> str:
        return f"""{name}_g AS (SELECT feature_id, theta, grp, sum(w * cnt) AS ww, sum(w * cnt * x) AS wx, sum(w * sy) AS wy, sum(w * x * sy) AS wxy, sum(w * syy) AS wyy, sum(cnt * ln(1 + m * theta * theta)) AS ld
  FROM (SELECT c.*, theta, m / (1 + m * theta * theta) AS w FROM {grid} JOIN classes c USING (feature_id)) GROUP BY 1, 2, 3),
{name}_s AS (SELECT feature_id, theta, sum(ld) AS ld, sum(wx - wx * wx / ww) AS a, sum(wxy - wx * wy / ww) AS b, sum(wyy - wy * wy / ww) AS c, sum(ln(ww)) AS slog FROM {name}_g GROUP BY 1, 2),
{name} AS (SELECT s.feature_id, theta, a, b / a AS beta, (within + c - b * b / a) / {df} AS sigma2, ld + {df} * (1 + ln(2 * pi() * (within + c - b * b / a) / {df})) {information} AS dev FROM {name}_s s JOIN spread USING (feature_id))"""

    parts = [f"""per AS (SELECT feature_id, patient_id, {group} AS grp, CASE WHEN condition = 'Disease' THEN 1.0::DOUBLE ELSE 0.0 END AS x, count(*) AS m, avg(ln(1 + score)) AS mean,
  sum(pow(ln(1 + score), 2)) - pow(sum(ln(1 + score)), 2) / count(*) AS ss FROM dense GROUP BY 1, 2, 3, 4)""",
             "classes AS (SELECT feature_id, grp, x, m, count(*) AS cnt, sum(mean) AS sy, sum(mean * mean) AS syy FROM per GROUP BY 1, 2, 3, 4)",
             """spread AS (SELECT feature_id, within, n, k, sd, patients FROM (SELECT feature_id, sum(ss) AS within, count(*) AS patients FROM per GROUP BY 1)
  JOIN (SELECT feature_id, count(*) AS n, count(*) FILTER (score > 0) AS k, stddev_samp(ln(1 + score)) AS sd FROM dense GROUP BY 1) USING (feature_id))""",
             "grid0 AS (SELECT feature_id, theta FROM spread, (SELECT 0.0::DOUBLE AS theta UNION ALL SELECT pow(10.0::DOUBLE, -3 + i * 0.1::DOUBLE) FROM range(61) AS t(i)))"]
    for k in range(ZOOMS + 1):
        parts.append(deviance(f"dev{k}", f"grid{k}"))
        parts.append(f"""best{k} AS (SELECT feature_id, coalesce(lo, theta) AS lo, coalesce(hi, theta) AS hi, theta, dev FROM (SELECT *, lag(theta) OVER o AS lo, lead(theta) OVER o AS hi,
  row_number() OVER (PARTITION BY feature_id ORDER BY dev, theta) AS r FROM dev{k} WINDOW o AS (PARTITION BY feature_id ORDER BY theta)) WHERE r = 1)""")
        parts.append(f"grid{k + 1} AS (SELECT DISTINCT feature_id, lo + (hi - lo) * i / 40.0 AS theta FROM best{k}, range(41) AS t(i))")
    parts.append(f"""chosen AS (SELECT z.feature_id, CASE WHEN z.dev <= b.dev THEN 0.0 ELSE b.theta END AS theta FROM dev0 z JOIN best{ZOOMS} b USING (feature_id) WHERE z.theta = 0),
{deviance('final', 'chosen')},
fitted AS (SELECT f.feature_id, 'conditionDisease' AS coefficient, beta AS estimate, sqrt(sigma2 / a) AS std_error, beta / sqrt(sigma2 / a) AS statistic, {normal_tail('beta / sqrt(sigma2 / a)')} AS p_value,
  theta < 1e-4 AS singular, theta * theta * sigma2 AS random_effect_variance, sigma2 AS residual_variance, k AS nonzero_units, n AS total_units, patients AS patient_count,
  1 - k / n AS zero_fraction, sd AS response_sd FROM final f JOIN spread USING (feature_id)),
{adjusted('fitted', 'tested')}""")
    return ",\n".join(parts)


MIXED_COLUMNS = f"""feature_id, nonzero_units, total_units, patient_count, {q6('zero_fraction')} AS zero_fraction, {q6('response_sd')} AS response_sd, {q6('estimate')} AS estimate,
  {q6('std_error')} AS std_error, {q6('statistic')} AS statistic, singular, {q6('random_effect_variance')} AS random_effect_variance, {q6('residual_variance')} AS residual_variance,
  'ok' AS status, coefficient, {q6('p_value')} AS p_value, {q6('q_value')} AS q_value"""

# ---- support under one random section per patient -----------------------------------------------
# The distribution of the number of supporting patients, one patient after the other; the last entry is "or more".
SUPPORTED = """chance AS (SELECT patient_id, condition, feature_id, (count(*) FILTER (score > 0)) / count(*) AS p FROM dense GROUP BY 1, 2, 3),
need AS (SELECT condition, CAST((50 * count(*) + 99) // 100 AS BIGINT) AS t FROM patients GROUP BY 1),
folded AS (SELECT feature_id, condition, list_reduce(list_prepend(list_prepend(1.0::DOUBLE, list_transform(range(any_value(t)), lambda i: 0.0::DOUBLE)), list(CAST([p] AS DOUBLE[]))),
  lambda acc, x: list_transform(range(1, len(acc) + 1), lambda j: CASE WHEN j = len(acc) THEN acc[j] ELSE acc[j] * (1 - x[1]) END + CASE WHEN j > 1 THEN acc[j - 1] * x[1] ELSE 0 END)) AS dist,
  any_value(t) AS t FROM chance JOIN need USING (condition) GROUP BY 1, 2),
sides AS (SELECT feature_id, max(dist[t + 1]) FILTER (condition = 'Disease') AS pt, max(dist[1]) FILTER (condition = 'Disease') AS p0,
  max(dist[t + 1]) FILTER (condition = 'Control') AS ct, max(dist[1]) FILTER (condition = 'Control') AS c0 FROM folded GROUP BY 1)"""
