"""Cohort models and support analyses on the derived sections and patients."""
from __future__ import annotations

from pyspark.sql import functions as F

from cellwire.operators import cohort as co
from cellwire.operators import support as su
from cellwire.operators.ranking import bh_adjust
from cellwire.operators.validation import varying_within
from cellwire.queries import cohort_checks as ck
from cellwire.queries import domain as d
from cellwire.queries.registry import q6, query, r6, with_

BASE = (d.COHORT,)
DENSE = (d.COHORT, d.DENSE)
REPS = 40


CONDITION = [("conditionDisease", "condition = 'Disease'")]
# Run of the section, for section-level models.
BY_RUN = CONDITION + [(f"run{i}", f"run = 'run{i}'") for i in (1, 2)]
# Share of sections per run, for patient-level models.
BY_FRACTION = CONDITION + [(f"f{i}", f"fraction_run{i}") for i in (1, 2)]


# ---- tables -----------------------------------------------------------------------------------
@query("a17_score_matrix", with_(*DENSE) + f"SELECT section_id, feature_id, {q6('score')} AS score FROM dense")
def a17(spark, folder):
    scores, units = d.cohort(spark, folder)
    return r6(co.score_matrix(scores, units), "score")


@query("a17_feature_key", """WITH r AS (SELECT l_shipdate, p_brand, p_type, p_name FROM lineitem JOIN part ON p_partkey = l_partkey)
  SELECT length(p_brand) || ':' || p_brand || ':' || length(p_type) || ':' || p_type || ':' || length(p_name) || ':' || p_name AS feature_id, count(*) AS records FROM r GROUP BY 1""")
def a17_key(spark, folder):
    from cellwire.functions import feature_key
    line, part = d.table(spark, folder, "lineitem"), d.table(spark, folder, "part")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(
        feature_key("p_brand", "p_type", "p_name").alias("feature_id")).agg(F.count("*").alias("records"))


@query("a18_replicate_mean", with_(*DENSE) + f"SELECT patient_id, feature_id, {q6('avg(score)')} AS score FROM dense GROUP BY 1, 2 HAVING avg(score) > 0")
def a18(spark, folder):
    return r6(co.patient_scores(*d.cohort(spark, folder)), "score")


@query("a18_replicate_median", with_(*DENSE) + f"SELECT patient_id, feature_id, {q6('quantile_cont(score, 0.5)')} AS score FROM dense GROUP BY 1, 2 HAVING quantile_cont(score, 0.5) > 0")
def a18_median(spark, folder):
    return r6(co.patient_scores(*d.cohort(spark, folder), how="median"), "score")


CONSERVED = ["prevalence_Control", "mean_Control", "prevalence_Disease", "mean_Disease", "minimum_group_prevalence"]


@query("a19_conserved_programs", with_(*DENSE, """c AS (SELECT feature_id, avg(CASE WHEN score > 0.1 THEN 1.0 ELSE 0.0 END) FILTER (condition = 'Control') AS pc, avg(score) FILTER (condition = 'Control') AS mc,
  avg(CASE WHEN score > 0.1 THEN 1.0 ELSE 0.0 END) FILTER (condition = 'Disease') AS pd, avg(score) FILTER (condition = 'Disease') AS md FROM dense GROUP BY 1)""") + f"""
  SELECT feature_id, {q6('pc')} AS "prevalence_Control", {q6('mc')} AS "mean_Control", {q6('pd')} AS "prevalence_Disease", {q6('md')} AS "mean_Disease",
  {q6('least(pc, pd)')} AS minimum_group_prevalence, least(pc, pd) >= 0.19 AS conserved FROM c""")
def a19(spark, folder):
    return r6(co.conserved_programs(*d.cohort(spark, folder), ["Control", "Disease"], threshold=0.1, min_prevalence=0.19), *CONSERVED)


SUPPORT = """pat AS (SELECT patient_id, any_value(condition) AS condition, feature_id, count(*) AS n, count(*) FILTER (score > 0) AS k FROM dense GROUP BY 1, 3),
sup AS (SELECT feature_id, CAST(coalesce(sum(k) FILTER (condition = 'Disease'), 0) AS BIGINT) AS pf_nonzero_sections, count(*) FILTER (condition = 'Disease' AND k > 0) AS pf_nonzero_patients,
  count(*) FILTER (condition = 'Disease' AND k = n) AS pf_all_sections_patients, CAST(coalesce(sum(k) FILTER (condition = 'Control'), 0) AS BIGINT) AS control_nonzero_sections,
  count(*) FILTER (condition = 'Control' AND k > 0) AS control_nonzero_patients, count(*) FILTER (condition = 'Control' AND k = n) AS control_all_sections_patients FROM pat GROUP BY 1)"""


@query("a32_support_counts", with_(*DENSE, SUPPORT) + "SELECT * FROM sup")
def a32(spark, folder):
    return su.support_counts(*d.cohort(spark, folder))


@query("a32_single_sections", with_(*BASE) + """SELECT condition, count(*) AS patients, count(*) FILTER (n = 1) AS single_section_patients
  FROM (SELECT patient_id, condition, count(*) AS n FROM units GROUP BY 1, 2) GROUP BY 1""")
def a32_single(spark, folder):
    return su.single_section_patients(d.cohort(spark, folder)[1])


@query("p14_constant_metadata", """SELECT o_custkey, 'o_orderpriority' AS "column", count(DISTINCT o_orderpriority) AS distinct_values FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1
  UNION ALL SELECT o_custkey, 'o_orderstatus', count(DISTINCT o_orderstatus) FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1""")
def p14(spark, folder):
    return varying_within(d.table(spark, folder, "orders"), "o_custkey", ["o_orderpriority", "o_orderstatus"])


@query("u4_missing_metadata", with_(*BASE) + "SELECT DISTINCT section_id FROM scores WHERE section_id NOT IN (SELECT section_id FROM units WHERE run <> 'run0')")
def u4(spark, folder):
    scores, units = d.cohort(spark, folder)
    return co.missing_metadata(scores, units.where("run <> 'run0'"))


@query("c21_example_tables", with_(*DENSE) + f"""SELECT patient_id, any_value(condition) AS condition, feature_id, count(*) AS sections, count(*) FILTER (score > 0) AS nonzero_sections,
  {q6('avg(ln(1 + score))')} AS mean_log1p FROM dense WHERE feature_id IN ('1-URGENT/F', '2-HIGH/O') GROUP BY 1, 3""")
def c21(spark, folder):
    scores, units = d.cohort(spark, folder)
    chosen = scores.select("feature_id").where("feature_id IN ('1-URGENT/F', '2-HIGH/O')")
    return r6(co.example_tables(scores, units, chosen), "mean_log1p")


@query("c22_section_metadata", with_(*BASE) + "SELECT section_id, any_value(patient_id) AS patient_id, any_value(condition) AS condition, any_value(run) AS run, count(*) AS cells FROM sections GROUP BY 1")
def c22(spark, folder):
    return co.section_metadata(d.sections(spark, folder), "section_id", ["patient_id", "condition", "run"])


# ---- multiple testing -------------------------------------------------------------------------
TESTS = """tests AS (SELECT l_orderkey AS feature_id, l_returnflag AS family, min(l_extendedprice) / 1e5 * 0.9 AS raw,
  CASE WHEN count(*) >= 2 THEN least(min(l_extendedprice) / 1e5 * 0.9, 1.0) END AS p_value FROM lineitem GROUP BY 1, 2)"""


def tests(spark, folder):
    p = F.min("l_extendedprice") / 1e5 * 0.9
    return d.table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("feature_id"), F.col("l_returnflag").alias("family")).agg(
        F.when(F.count("*") >= 2, F.least(p, F.lit(1.0))).alias("p_value"))


def bh_sql(over=""):
    part = f"PARTITION BY {over}" if over else ""
    return f"""ranked AS (SELECT *, p_value * count(*) OVER ({part}) / max(rk) OVER (PARTITION BY {over + ',' if over else ''} p_value) AS v FROM
  (SELECT *, row_number() OVER ({part} ORDER BY p_value) AS rk FROM tests WHERE p_value IS NOT NULL)),
adj AS (SELECT feature_id, family, least(1.0, min(v) OVER ({part} ORDER BY p_value DESC)) AS q_value FROM ranked)"""


@query("w1_benjamini_hochberg", with_(TESTS, bh_sql()) + f"SELECT t.feature_id, t.family, {q6('p_value')} AS p_value, {q6('q_value')} AS q_value FROM tests t LEFT JOIN adj a ON a.feature_id = t.feature_id AND a.family = t.family")
def w1(spark, folder):
    return r6(bh_adjust(tests(spark, folder)), "p_value", "q_value")


@query("w1_families", with_(TESTS, bh_sql("family")) + f"SELECT t.feature_id, t.family, {q6('p_value')} AS p_value, {q6('q_value')} AS q_value FROM tests t LEFT JOIN adj a ON a.feature_id = t.feature_id AND a.family = t.family")
def w1_families(spark, folder):
    return r6(bh_adjust(tests(spark, folder), keys=["family"]), "p_value", "q_value")


# ---- models -----------------------------------------------------------------------------------
OLS = """o AS (SELECT feature_id, avg(ln(1 + score)) FILTER (condition = 'Disease') - avg(ln(1 + score)) FILTER (condition = 'Control') AS estimate,
  sqrt((var_samp(ln(1 + score)) FILTER (condition = 'Disease') * (count(*) FILTER (condition = 'Disease') - 1) + var_samp(ln(1 + score)) FILTER (condition = 'Control') * (count(*) FILTER (condition = 'Control') - 1))
  / (count(*) - 2) * (1.0 / count(*) FILTER (condition = 'Disease') + 1.0 / count(*) FILTER (condition = 'Control'))) AS std_error,
  count(*) FILTER (score > 0) AS nonzero_units, count(*) AS total_units FROM dense GROUP BY 1)"""


@query("c1_glm", with_(*DENSE, OLS, ck.GLM_TESTED, ck.adjusted("tested", "done")) + f"SELECT {ck.GLM_COLUMNS} FROM done")
def c1(spark, folder):
    return r6(glm(spark, folder), *MODEL)


def glm(spark, folder, **options):
    return co.fit_glm(*d.cohort(spark, folder), CONDITION, "conditionDisease", **options)


MODEL = ["estimate", "std_error", "statistic", "p_value", "q_value"]
INTERVAL = ["estimate", "std_error", "ci_lower", "ci_upper", "p_value", "residual_df", "q_value"]


@query("c1_glm_tests", with_(*DENSE, ck.RUN_GLM, ck.adjusted("tested", "done")) + f"SELECT {ck.GLM_COLUMNS} FROM done")
def c1_tests(spark, folder):
    return r6(co.fit_glm(*d.cohort(spark, folder), BY_RUN, "conditionDisease"), *MODEL)


@query("c1_presence", with_(*DENSE, """b AS (SELECT feature_id, avg(CASE WHEN score > 0 THEN 1.0 ELSE 0.0 END) FILTER (condition = 'Disease') AS a, count(*) FILTER (condition = 'Disease') AS na,
  avg(CASE WHEN score > 0 THEN 1.0 ELSE 0.0 END) FILTER (condition = 'Control') AS c, count(*) FILTER (condition = 'Control') AS nc, count(*) FILTER (score > 0) AS k, count(*) AS n FROM dense GROUP BY 1)""") + f"""
  , tested AS (SELECT *, estimate / std_error AS statistic, {ck.normal_tail('estimate / std_error')} AS p_value FROM (SELECT feature_id, ln(a / (1 - a)) - ln(c / (1 - c)) AS estimate,
    sqrt(1 / (na * a * (1 - a)) + 1 / (nc * c * (1 - c))) AS std_error, k AS nonzero_units, n AS total_units FROM b)), {ck.adjusted("tested", "done")}
  SELECT {ck.GLM_COLUMNS} FROM done""")
def c1_presence(spark, folder):
    return r6(glm(spark, folder, family="binomial_presence"), *MODEL)


def lmm(spark, folder, design=None, **options):
    return co.fit_lmm(*d.cohort(spark, folder), design or CONDITION, "conditionDisease", **options)


@query("c2_lmm", with_(*DENSE, ck.mixed_model(reml=False, by_run=False)) + f"SELECT {ck.MIXED_COLUMNS} FROM tested")
def c2(spark, folder):
    return r6(lmm(spark, folder), *MODEL, "response_sd", "zero_fraction", "random_effect_variance", "residual_variance")


@query("c2_lmm_reml_run", with_(*DENSE, ck.mixed_model(reml=True, by_run=True)) + f"SELECT {ck.MIXED_COLUMNS} FROM tested")
def c2_reml(spark, folder):
    return r6(lmm(spark, folder, BY_RUN, reml=True), *MODEL, "response_sd", "zero_fraction", "random_effect_variance", "residual_variance")


def hc3(spark, folder):
    return co.fit_hc3(*d.cohort(spark, folder), BY_FRACTION, "conditionDisease", ["run1", "run2"])


HC3 = """g AS (SELECT feature_id, avg(y) FILTER (condition = 'Disease') AS md, avg(y) FILTER (condition = 'Control') AS mc, var_samp(y) FILTER (condition = 'Disease') AS vd,
  var_samp(y) FILTER (condition = 'Control') AS vc, count(*) FILTER (condition = 'Disease') AS nd, count(*) FILTER (condition = 'Control') AS nc, count(*) FILTER (y > 0) AS k FROM py GROUP BY 1)"""


def intervals(out):
    return r6(out.withColumn("total_patients", F.col("total_patients").cast("long")), *INTERVAL)


@query("c4_patient_hc3", with_(*DENSE, HC3, ck.HC3_PLAIN, ck.adjusted("tested", "done")) + f"SELECT {ck.T_COLUMNS} FROM done")
def c4(spark, folder):
    return intervals(co.fit_hc3(*d.cohort(spark, folder), CONDITION, "conditionDisease"))


@query("c4_run_adjusted_hc3", with_(*DENSE, ck.HC3_RUNS) + f"SELECT {ck.T_COLUMNS} FROM full_tests")
def c4_runs(spark, folder):
    return intervals(hc3(spark, folder))


@query("c5_welch", with_(*DENSE, HC3, ck.WELCH, ck.adjusted("tested", "done")) + f"SELECT {ck.T_COLUMNS} FROM done")
def c5(spark, folder):
    return intervals(co.welch_contrast(*d.cohort(spark, folder)))


LOPO = """t AS (SELECT feature_id, sum(y) FILTER (condition = 'Disease') AS sd, sum(y) FILTER (condition = 'Control') AS sc, count(*) FILTER (condition = 'Disease') AS nd, count(*) FILTER (condition = 'Control') AS nc FROM py GROUP BY 1),
lo AS (SELECT patient_id AS omitted_patient, p.feature_id, sd / nd - sc / nc AS full_estimate, CASE WHEN condition = 'Disease' THEN (sd - y) / (nd - 1) - sc / nc ELSE sd / nd - (sc - y) / (nc - 1) END AS estimate
  FROM py p JOIN t USING (feature_id))"""


def omissions(spark, folder):
    return co.leave_one_out(*d.cohort(spark, folder), CONDITION, "conditionDisease")


@query("c6_leave_one_out", with_(*DENSE, LOPO) + f"SELECT omitted_patient, feature_id, {q6('full_estimate')} AS full_estimate, {q6('estimate')} AS estimate FROM lo")
def c6(spark, folder):
    return r6(omissions(spark, folder), "full_estimate", "estimate")


@query("c6_omission_summary", with_(*DENSE, LOPO) + f"""SELECT feature_id, {q6('min(estimate)')} AS estimate_min, {q6('max(estimate)')} AS estimate_max,
  {q6('avg(CASE WHEN CASE WHEN abs(estimate) <= 1e-12 * greatest(abs(estimate), abs(full_estimate)) THEN 0 ELSE sign(estimate) END = CASE WHEN abs(full_estimate) <= 1e-12 * greatest(abs(full_estimate), abs(estimate)) THEN 0 ELSE sign(full_estimate) END THEN 1.0 ELSE 0.0 END)')} AS direction_agreement FROM lo GROUP BY 1""")
def c6_summary(spark, folder):
    return r6(co.omission_summary(omissions(spark, folder)), "estimate_min", "estimate_max", "direction_agreement")


SPEARMAN = """rk AS (SELECT omitted_patient, rank() OVER (PARTITION BY omitted_patient ORDER BY CAST(printf('%.11e', estimate) AS DOUBLE)) + (count(*) OVER (PARTITION BY omitted_patient, CAST(printf('%.11e', estimate) AS DOUBLE)) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY omitted_patient ORDER BY CAST(printf('%.11e', full_estimate) AS DOUBLE)) + (count(*) OVER (PARTITION BY omitted_patient, CAST(printf('%.11e', full_estimate) AS DOUBLE)) - 1) / 2.0 AS b FROM lo),
sp AS (SELECT omitted_patient, corr(a, b) AS r FROM rk GROUP BY 1)"""


@query("c6_patient_influence", with_(*DENSE, LOPO, SPEARMAN) + f"""SELECT omitted_patient, {q6('min(estimate)')} AS estimate_min, {q6('max(estimate)')} AS estimate_max,
  {q6('avg(CASE WHEN CASE WHEN abs(estimate) <= 1e-12 * greatest(abs(estimate), abs(full_estimate)) THEN 0 ELSE sign(estimate) END = CASE WHEN abs(full_estimate) <= 1e-12 * greatest(abs(full_estimate), abs(estimate)) THEN 0 ELSE sign(full_estimate) END THEN 1.0 ELSE 0.0 END)')} AS direction_agreement, {q6('any_value(r)')} AS estimate_spearman FROM lo JOIN sp USING (omitted_patient) GROUP BY 1""")
def c6_influence(spark, folder):
    return r6(co.omission_summary(omissions(spark, folder), "omitted_patient"), "estimate_min", "estimate_max", "direction_agreement", "estimate_spearman")


@query("c6_omission_tests", with_(*DENSE, ck.HC3_RUNS, ck.OMITTED) + f"""SELECT omitted_patient, feature_id, {q6('full_estimate')} AS full_estimate, {q6('estimate')} AS estimate,
  {q6('std_error')} AS std_error, nonzero_patients, 'ok' AS status, {q6('p_value')} AS p_value, {q6('q_value')} AS q_value FROM omissions""")
def c6_tests(spark, folder):
    out = co.leave_one_out_tests(*d.cohort(spark, folder), BY_FRACTION, "conditionDisease", ["run1", "run2"])
    return r6(out, "full_estimate", "estimate", "std_error", "p_value", "q_value")


@query("c6_omission_hits", with_(*DENSE, ck.HC3_RUNS, ck.OMITTED) + f"""SELECT feature_id, count(*) AS valid_omissions, count(*) FILTER (hit) AS bh_hit_omissions,
  {q6('max(q_value)')} AS maximum_q, any_value(full_hit) AS full_hit FROM omissions GROUP BY 1""")
def c6_hits(spark, folder):
    scores, units = d.cohort(spark, folder)
    tests_ = co.leave_one_out_tests(scores, units, BY_FRACTION, "conditionDisease", ["run1", "run2"])
    return r6(co.omission_hits(tests_, hc3(spark, folder)), "maximum_q")


@query("c6_omission_retention", with_(*DENSE, ck.HC3_RUNS, ck.OMITTED) + f"""SELECT omitted_patient, count(*) AS valid_features, count(*) FILTER (hit) AS bh_hits,
  count(*) FILTER (hit AND full_hit) AS full_hits_retained, {q6('count(*) FILTER (hit AND full_hit) / greatest(1, count(*) FILTER (full_hit))')} AS full_hit_fraction_retained FROM omissions GROUP BY 1""")
def c6_retention(spark, folder):
    scores, units = d.cohort(spark, folder)
    tests_ = co.leave_one_out_tests(scores, units, BY_FRACTION, "conditionDisease", ["run1", "run2"])
    return r6(co.omission_retention(tests_, hc3(spark, folder)), "full_hit_fraction_retained")


@query("c6_omission_standard_errors", with_(*DENSE, """s AS (SELECT feature_id, condition, sum(y) AS s, sum(y * y) AS q, count(*) AS n FROM py GROUP BY 1, 2),
  pairs AS (SELECT p.patient_id, p.feature_id, p.condition, p.y, a.s AS sd, a.q AS qd, a.n AS nd, b.s AS sc, b.q AS qc, b.n AS nc FROM py p JOIN s a ON a.feature_id = p.feature_id AND a.condition = 'Disease'
  JOIN s b ON b.feature_id = p.feature_id AND b.condition = 'Control'),
  cut AS (SELECT patient_id, feature_id, CASE WHEN condition = 'Disease' THEN sd - y ELSE sd END AS sd, CASE WHEN condition = 'Disease' THEN qd - y * y ELSE qd END AS qd, CASE WHEN condition = 'Disease' THEN nd - 1 ELSE nd END AS nd,
  CASE WHEN condition = 'Control' THEN sc - y ELSE sc END AS sc, CASE WHEN condition = 'Control' THEN qc - y * y ELSE qc END AS qc, CASE WHEN condition = 'Control' THEN nc - 1 ELSE nc END AS nc FROM pairs)""") + f"""
  SELECT patient_id AS omitted_patient, feature_id, {q6('sd / nd - sc / nc')} AS estimate, {q6('sqrt((qd - sd * sd / nd) / ((nd - 1) * (nd - 1)) + (qc - sc * sc / nc) / ((nc - 1) * (nc - 1)))')} AS std_error, 'ok' AS status FROM cut""")
def c6_errors(spark, folder):
    out = co.leave_one_out_tests(*d.cohort(spark, folder), CONDITION, "conditionDisease")
    return r6(out.select("omitted_patient", "feature_id", "estimate", "std_error", "status"), "estimate", "std_error")


BALANCED = f"""drawn AS (SELECT b, patient_id, row_number() OVER (PARTITION BY b ORDER BY md5('1|' || CAST(b AS VARCHAR) || '|' || CAST(patient_id AS VARCHAR)), patient_id) AS k
  FROM patients, range(1, {REPS + 1}) AS t(b) WHERE condition = 'Disease'),
chosen AS (SELECT b, patient_id FROM drawn WHERE k <= (SELECT count(*) FROM patients WHERE condition = 'Control') UNION ALL SELECT b, patient_id FROM patients, range(1, {REPS + 1}) AS t(b) WHERE condition = 'Control'),
eff AS (SELECT b, feature_id, avg(y) FILTER (condition = 'Disease') - avg(y) FILTER (condition = 'Control') AS e FROM chosen JOIN py USING (patient_id) GROUP BY 1, 2),
fullest AS (SELECT feature_id, avg(y) FILTER (condition = 'Disease') - avg(y) FILTER (condition = 'Control') AS f FROM py GROUP BY 1)"""


@query("c7_balanced_subsets", with_(*DENSE, BALANCED) + f"""SELECT feature_id, {q6('min(e)')} AS minimum, {q6('max(e)')} AS maximum,
  {q6('avg(CASE WHEN CASE WHEN abs(e) <= 1e-12 * greatest(abs(e), abs(f)) THEN 0 ELSE sign(e) END = CASE WHEN abs(f) <= 1e-12 * greatest(abs(f), abs(e)) THEN 0 ELSE sign(f) END THEN 1.0 ELSE 0.0 END)')} AS direction_agreement, {q6('quantile_cont(e, 0.025)')} AS descriptive_p025,
  {q6('quantile_cont(e, 0.5)')} AS median, {q6('quantile_cont(e, 0.975)')} AS descriptive_p975 FROM eff JOIN fullest USING (feature_id) GROUP BY 1""")
def c7(spark, folder):
    out = co.balanced_effects(*d.cohort(spark, folder), CONDITION, "conditionDisease", REPS)
    return r6(out, "minimum", "maximum", "direction_agreement", "descriptive_p025", "median", "descriptive_p975")


# ---- comparison -------------------------------------------------------------------------------
# Three model tables per part: estimates and q values from order lines.
def model_sql(tag, flag, low):
    return f"""m{tag} AS (SELECT l_partkey AS feature_id, round(avg(l_discount) - 0.05, 9) AS estimate, round(avg(l_tax) / {low}, 9) AS q_value, round(avg(l_tax) / {low * 2}, 9) AS p_value,
  CASE WHEN count(*) >= 4 THEN 'ok' ELSE 'fit_failed' END AS status, max(l_quantity) > 49 AS singular FROM lineitem WHERE l_returnflag = '{flag}' GROUP BY 1)"""


MODELS = (model_sql("p", "A", 0.8), model_sql("r", "R", 0.7), model_sql("h", "N", 0.9))


def models(spark, folder):
    out = []
    for flag, low in (("A", 0.8), ("R", 0.7), ("N", 0.9)):
        out.append(d.table(spark, folder, "lineitem").where(F.col("l_returnflag") == flag).groupBy(F.col("l_partkey").alias("feature_id")).agg(
            F.round(F.avg("l_discount") - 0.05, 9).alias("estimate"), F.round(F.avg("l_tax") / low, 9).alias("q_value"),
            F.round(F.avg("l_tax") / (low * 2), 9).alias("p_value"),
            F.when(F.count("*") >= 4, "ok").otherwise("fit_failed").alias("status"), (F.max("l_quantity") > 49).alias("singular")))
    return out


@query("c8_evidence_labels", with_(*MODELS) + f"""SELECT p.feature_id, {q6('p.q_value')} AS primary_q, {q6('r.q_value')} AS run_adjusted_q, {q6('h.q_value')} AS patient_q,
  p.status = 'ok' AND r.status = 'ok' AND h.status = 'ok' AS all_models_available, sign(p.estimate) = sign(r.estimate) AND sign(p.estimate) = sign(h.estimate) AS same_direction,
  CASE WHEN p.status <> 'ok' THEN 'primary_fit_unavailable' WHEN p.q_value >= 0.05 THEN 'not_primary_hit' WHEN r.status <> 'ok' OR h.status <> 'ok' THEN 'primary_hit_sensitivity_unavailable'
  WHEN r.q_value < 0.05 AND h.q_value < 0.05 AND sign(p.estimate) = sign(r.estimate) AND sign(p.estimate) = sign(h.estimate) THEN 'supported_by_run_and_patient_sensitivity'
  ELSE 'primary_hit_sensitivity_dependent' END AS evidence_label FROM mp p JOIN mr r USING (feature_id) JOIN mh h USING (feature_id)""")
def c8(spark, folder):
    return r6(co.evidence_labels(*models(spark, folder)), "primary_q", "run_adjusted_q", "patient_q")


COMPARED = """cm AS (SELECT 'run' AS model, r.*, p.estimate AS pe, p.status AS ps, p.q_value AS pq FROM mr r JOIN mp p USING (feature_id)
  UNION ALL SELECT 'patient', h.*, p.estimate, p.status, p.q_value FROM mh h JOIN mp p USING (feature_id)),
crk AS (SELECT model, rank() OVER (PARTITION BY model ORDER BY estimate) + (count(*) OVER (PARTITION BY model, estimate) - 1) / 2.0 AS a, rank() OVER (PARTITION BY model ORDER BY pe) + (count(*) OVER (PARTITION BY model, pe) - 1) / 2.0 AS b
  FROM cm WHERE status = 'ok' AND ps = 'ok'), csp AS (SELECT model, corr(a, b) AS r FROM crk GROUP BY 1)"""


@query("c13_model_comparison", with_(*MODELS, COMPARED) + f"""SELECT model, count(*) AS features, count(*) FILTER (status = 'ok') AS valid_features, count(*) FILTER (status = 'ok' AND q_value < 0.05) AS bh_hits,
  count(*) FILTER (status = 'ok' AND q_value < 0.05 AND ps = 'ok' AND pq < 0.05) AS primary_hits_retained,
  {q6("count(*) FILTER (status = 'ok' AND q_value < 0.05 AND ps = 'ok' AND pq < 0.05) / count(*) FILTER (ps = 'ok' AND pq < 0.05)")} AS primary_hit_retention,
  count(*) FILTER (status = 'ok' AND ps = 'ok') AS common_valid, {q6("avg(CASE WHEN sign(estimate) = sign(pe) THEN 1.0 ELSE 0.0 END) FILTER (status = 'ok' AND ps = 'ok')")} AS direction_agreement,
  {q6('any_value(r)')} AS effect_spearman FROM cm JOIN csp USING (model) GROUP BY 1""")
def c13(spark, folder):
    p, r, h = models(spark, folder)
    return r6(co.compare_models(p, {"run": r, "patient": h}), "primary_hit_retention", "direction_agreement", "effect_spearman")


@query("c14_restricted_bh", with_(*MODELS, "tests AS (SELECT feature_id, 'x' AS family, p_value FROM mp WHERE status = 'ok' AND NOT singular)", bh_sql()) + f"""
  SELECT m.feature_id, m.status = 'ok' AND NOT m.singular AS eligible, {q6('m.q_value')} AS global_q, {q6('a.q_value')} AS subset_q FROM mp m LEFT JOIN adj a USING (feature_id)""")
def c14(spark, folder):
    p, _, _ = models(spark, folder)
    return r6(co.restricted_bh(p, ~F.col("singular")), "global_q", "subset_q")


@query("c15_status_transitions", with_(*MODELS) + "SELECT p.status AS baseline_status, r.status AS robust_status, count(*) AS features FROM mp p JOIN mr r USING (feature_id) GROUP BY 1, 2")
def c15(spark, folder):
    p, r, _ = models(spark, folder)
    return co.status_transitions(p, r)


@query("c15_fit_states", with_(*MODELS) + "SELECT status, count(*) AS features FROM mp GROUP BY 1")
def c15_states(spark, folder):
    return co.status_counts(models(spark, folder)[0])


MESSAGES = """msg AS (SELECT CASE l_linenumber WHEN 1 THEN 'Hessian: 1 negative eigenvalues' WHEN 2 THEN 'Hessian is numerically singular' WHEN 3 THEN 'max|grad| = 0.01; very large eigenvalue'
  WHEN 4 THEN 'max|grad| = 0.02' WHEN 5 THEN 'very large eigenvalue ratio' WHEN 6 THEN 'unknown' ELSE '' END AS message FROM lineitem)"""


@query("c15_message_classes", with_(MESSAGES) + """SELECT CASE WHEN contains(message, 'negative eigen') THEN 'negative_hessian_eigenvalue' WHEN contains(message, 'numerically singular') THEN 'numerically_singular_hessian'
  WHEN contains(message, 'max|grad|') AND contains(message, 'very large eigenvalue') THEN 'gradient_and_scale_warning' WHEN contains(message, 'max|grad|') THEN 'gradient_warning'
  WHEN contains(message, 'very large eigenvalue') THEN 'scale_warning' ELSE 'other' END AS convergence_class, count(*) AS features FROM msg WHERE message <> '' GROUP BY 1""")
def c15_messages(spark, folder):
    expr = MESSAGES.replace("msg AS (", "").rsplit(")", 1)[0].replace("FROM lineitem", "FROM {lines}")
    return co.classify_messages(spark.sql(expr, lines=d.table(spark, folder, "lineitem")), "message")


@query("c16_hit_overlap", with_(*MODELS, """j AS (SELECT p.status AS ps, r.status AS rs, p.estimate AS pe, r.estimate AS re, p.status = 'ok' AND p.q_value < 0.05 AS hp, r.status = 'ok' AND r.q_value < 0.05 AS hr FROM mp p JOIN mr r USING (feature_id)),
  jr AS (SELECT rank() OVER (ORDER BY pe) + (count(*) OVER (PARTITION BY pe) - 1) / 2.0 AS a, rank() OVER (ORDER BY re) + (count(*) OVER (PARTITION BY re) - 1) / 2.0 AS b FROM j WHERE ps = 'ok' AND rs = 'ok')""") + f"""
  SELECT count(*) FILTER (hp) AS left_significant, count(*) FILTER (hr) AS right_significant, count(*) FILTER (hp AND hr) AS overlap, {q6('count(*) FILTER (hp AND hr) / count(*) FILTER (hp OR hr)')} AS significant_jaccard,
  {q6("avg(CASE WHEN sign(pe) = sign(re) THEN 1.0 ELSE 0.0 END) FILTER (ps = 'ok' AND rs = 'ok')")} AS direction_agreement, count(*) FILTER (ps = 'ok' AND rs = 'ok') AS paired_valid, {q6('(SELECT corr(a, b) FROM jr)')} AS estimate_spearman FROM j""")
def c16(spark, folder):
    p, r, _ = models(spark, folder)
    return r6(co.hit_overlap(p, r), "significant_jaccard", "direction_agreement", "estimate_spearman")


# ---- support ----------------------------------------------------------------------------------
PERCENTS = (40, 50, 60)
CLASSES = """tot AS (SELECT count(*) FILTER (condition = 'Disease') AS npf, count(*) FILTER (condition = 'Control') AS nc FROM patients),
cls AS (SELECT feature_id, CAST(p AS INTEGER) AS threshold_percent, CASE WHEN pf_nonzero_patients >= (p * npf + 99) // 100 AND control_nonzero_patients >= (p * nc + 99) // 100 THEN 'shared'
  WHEN control_nonzero_patients >= (p * nc + 99) // 100 AND pf_nonzero_patients = 0 THEN 'control_restricted' WHEN pf_nonzero_patients >= (p * npf + 99) // 100 AND control_nonzero_patients = 0 THEN 'pf_restricted'
  ELSE 'other' END AS support_class FROM sup, tot, (VALUES (40), (50), (60)) AS v(p))"""


def classes(spark, folder):
    scores, units = d.cohort(spark, folder)
    return su.classify_support(su.support_counts(scores, units), PERCENTS, *su.patient_totals(units))


@query("c9_support_classes", with_(*DENSE, SUPPORT, CLASSES) + "SELECT * FROM cls")
def c9(spark, folder):
    return classes(spark, folder)


@query("c10_threshold_counts", with_(*DENSE, SUPPORT, CLASSES) + "SELECT threshold_percent, support_class, count(*) AS features FROM cls GROUP BY 1, 2")
def c10(spark, folder):
    return su.threshold_counts(classes(spark, folder))


@query("c10_threshold_transitions", with_(*DENSE, SUPPORT, CLASSES) + """SELECT a.support_class AS from_class, b.threshold_percent AS to_threshold, b.support_class AS to_class, count(*) AS features
  FROM cls a JOIN cls b USING (feature_id) WHERE a.threshold_percent = 50 GROUP BY 1, 2, 3""")
def c10_transitions(spark, folder):
    return su.threshold_transitions(classes(spark, folder), 50)


DRAW = f"""sec AS (SELECT patient_id, section_id, condition, row_number() OVER (PARTITION BY patient_id ORDER BY md5(section_id), section_id) - 1 AS i, count(*) OVER (PARTITION BY patient_id) AS n FROM units),
drawn AS (SELECT DISTINCT patient_id, b, CAST('0x' || substr(md5('1|' || CAST(b AS VARCHAR) || '|' || CAST(patient_id AS VARCHAR)), 1, 8) AS BIGINT) % n AS i FROM sec, range(1, {REPS + 1}) AS t(b)),
pick AS (SELECT b, s.section_id, s.condition FROM drawn JOIN sec s USING (patient_id, i)),
hit AS (SELECT b, feature_id, count(*) FILTER (condition = 'Disease') AS pf, count(*) FILTER (condition = 'Control') AS ct FROM pick JOIN (SELECT section_id, feature_id FROM scores WHERE score > 0) USING (section_id) GROUP BY 1, 2),
lab AS (SELECT b, feature_id, pf, ct, CASE WHEN pf >= (50 * npf + 99) // 100 AND ct >= (50 * nc + 99) // 100 THEN 'shared' WHEN ct >= (50 * nc + 99) // 100 AND pf = 0 THEN 'control_restricted'
  WHEN pf >= (50 * npf + 99) // 100 AND ct = 0 THEN 'pf_restricted' ELSE 'other' END AS c FROM (SELECT t.b, f.feature_id, coalesce(pf, 0) AS pf, coalesce(ct, 0) AS ct FROM features f CROSS JOIN range(1, {REPS + 1}) AS t(b) LEFT JOIN hit h ON h.b = t.b AND h.feature_id = f.feature_id), tot),
share AS (SELECT feature_id, count(*) FILTER (c = 'pf_restricted') AS a1, count(*) FILTER (c = 'control_restricted') AS a2, count(*) FILTER (c = 'shared') AS a3, count(*) FILTER (c = 'other') AS a4,
  min(pf) AS pf_min, max(pf) AS pf_max, avg(pf) AS pf_mean, min(ct) AS control_min, max(ct) AS control_max, avg(ct) AS control_mean FROM lab GROUP BY 1)"""


@query("c11_section_choices", with_(*DENSE, SUPPORT, CLASSES, DRAW) + f"""SELECT s.feature_id, k.support_class, {q6(f'a1 / {REPS}')} AS p_pf_restricted, {q6(f'a2 / {REPS}')} AS p_control_restricted, {q6(f'a3 / {REPS}')} AS p_shared,
  {q6(f'a4 / {REPS}')} AS p_other, {q6(f"CASE k.support_class WHEN 'pf_restricted' THEN a1 WHEN 'control_restricted' THEN a2 WHEN 'shared' THEN a3 ELSE a4 END / {REPS}")} AS retention,
  CASE greatest(a1, a2, a3, a4) WHEN a1 THEN 'pf_restricted' WHEN a2 THEN 'control_restricted' WHEN a3 THEN 'shared' ELSE 'other' END AS modal_class,
  CAST(a1 = greatest(a1, a2, a3, a4) AS INTEGER) + CAST(a2 = greatest(a1, a2, a3, a4) AS INTEGER) + CAST(a3 = greatest(a1, a2, a3, a4) AS INTEGER) + CAST(a4 = greatest(a1, a2, a3, a4) AS INTEGER) > 1 AS modal_tie,
  pf_min, pf_max, {q6('pf_mean')} AS pf_mean, control_min, control_max, {q6('control_mean')} AS control_mean FROM share s JOIN cls k ON k.feature_id = s.feature_id AND threshold_percent = 50""")
def c11(spark, folder):
    scores, units = d.cohort(spark, folder)
    supports = su.choice_supports(scores, su.random_choices(units, REPS))
    base = classes(spark, folder).where("threshold_percent = 50")
    out = su.choice_class_shares(supports, base, REPS, 50, *su.patient_totals(units))
    return r6(out, *[f"p_{c}" for c in su.CLASSES], "retention", "pf_mean", "control_mean")


@query("c12_support_distribution", with_(*DENSE, ck.SUPPORTED) + f"""SELECT feature_id, {q6('pt * c0')} AS p_pf_restricted, {q6('ct * p0')} AS p_control_restricted, {q6('pt * ct')} AS p_shared,
  {q6('1 - pt * c0 - ct * p0 - pt * ct')} AS p_other FROM sides""")
def c12(spark, folder):
    out = su.exact_class_probabilities(*d.cohort(spark, folder), 50)
    return r6(out, *[f"p_{c}" for c in su.CLASSES])
