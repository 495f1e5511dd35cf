"""Record comparison, sampling and run summaries on the derived tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from cellwire.operators import agreement as ag
from cellwire.operators import sampling as sp
from cellwire.operators import validation as va
from cellwire.queries import domain as d
from cellwire.queries.registry import q6, query, r6, with_

# Two record sets per (brand, type, line): scores of the two halves of all order lines, by order.
SIDE = """side_{flag} AS (SELECT p_brand AS sender_group, p_type AS receiver_group, 'I' || CAST(l_suppkey % 40 AS VARCHAR) AS interaction_name,
  round(avg(l_extendedprice) / 1e5, 9) AS probability, round((count(*) % 12) / 100.0, 9) AS pvalue FROM lineitem JOIN part ON p_partkey = l_partkey
  WHERE l_orderkey % 2 = {half} GROUP BY 1, 2, 3 HAVING count(*) > {least})"""
LEFT, RIGHT = SIDE.format(flag="A", half=0, least=1), SIDE.format(flag="R", half=1, least=2)
PAIRS = """pairs AS (SELECT coalesce(a.sender_group, b.sender_group) AS sender_group, coalesce(a.receiver_group, b.receiver_group) AS receiver_group,
  coalesce(a.interaction_name, b.interaction_name) AS interaction_name, a.probability AS pl, b.probability AS pr, a.pvalue AS vl, b.pvalue AS vr,
  CASE WHEN a.sender_group IS NULL THEN 'right_only' WHEN b.sender_group IS NULL THEN 'left_only' ELSE 'both' END AS side
  FROM side_A a FULL JOIN side_R b ON a.sender_group = b.sender_group AND a.receiver_group = b.receiver_group AND a.interaction_name = b.interaction_name)"""
BASE = (LEFT, RIGHT, PAIRS)


def side(spark, folder, half, least):
    line, part = d.table(spark, folder, "lineitem"), d.table(spark, folder, "part")
    return line.where(F.col("l_orderkey") % 2 == half).join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(
        F.col("p_brand").alias("sender_group"), F.col("p_type").alias("receiver_group"),
        F.concat(F.lit("I"), (F.col("l_suppkey") % 40).cast("string")).alias("interaction_name"),
    ).agg(F.round(F.avg("l_extendedprice") / 1e5, 9).alias("probability"),
          F.round((F.count("*") % 12) / 100.0, 9).alias("pvalue"), F.count("*").alias("_n")).where(F.col("_n") > least).drop("_n")


def sides(spark, folder):
    return side(spark, folder, 0, 1), side(spark, folder, 1, 2)


def pairs(spark, folder):
    return ag.pair_records(*sides(spark, folder))


@query("j12_record_pairing", with_(*BASE) + f"""SELECT sender_group, receiver_group, interaction_name, {q6('pl')} AS probability_left,
  {q6('pr')} AS probability_right, {q6('vl')} AS pvalue_left, {q6('vr')} AS pvalue_right, side FROM pairs""")
def j12(spark, folder):
    return r6(pairs(spark, folder), "probability_left", "probability_right", "pvalue_left", "pvalue_right")


REPORT = ["active_jaccard", "max_probability_error", "max_pvalue_error", "exact_pvalue_fraction", "probability_pearson"]


@query("c17_agreement_report", with_(*BASE) + f"""SELECT count(*) FILTER (side = 'both') AS matched, count(*) FILTER (side = 'left_only') AS left_only,
  count(*) FILTER (side = 'right_only') AS right_only, {q6("count(*) FILTER (side = 'both') / count(*)")} AS active_jaccard,
  {q6('max(abs(pl - pr))')} AS max_probability_error, {q6('max(abs(vl - vr))')} AS max_pvalue_error,
  {q6("avg(CASE WHEN vl = vr THEN 1.0 ELSE 0.0 END) FILTER (side = 'both')")} AS exact_pvalue_fraction,
  count(*) FILTER (side = 'both' AND (vl < 0.05) <> (vr < 0.05)) AS decision_changes, {q6('corr(pl, pr)')} AS probability_pearson, false AS strict_pass FROM pairs""")
def c17(spark, folder):
    return r6(ag.agreement_report(pairs(spark, folder)), *REPORT)


@query("c18_zero_inclusive", with_(*BASE, "f AS (SELECT side, coalesce(pl, 0) AS pl, coalesce(pr, 0) AS pr, coalesce(vl, 1) AS vl, coalesce(vr, 1) AS vr FROM pairs)") + f"""
  SELECT count(*) FILTER (side <> 'right_only') AS left_records, count(*) FILTER (side <> 'left_only') AS right_records,
  count(*) FILTER (side = 'both') AS shared_records, {q6("count(*) FILTER (side = 'both') / count(*)")} AS active_jaccard,
  {q6('max(abs(pl - pr))')} AS max_probability_difference, {q6('avg(CASE WHEN pl = pr THEN 1.0 ELSE 0.0 END)')} AS exact_probability_fraction,
  {q6('max(abs(vl - vr))')} AS max_pvalue_difference, {q6('avg(CASE WHEN vl = vr THEN 1.0 ELSE 0.0 END)')} AS exact_pvalue_fraction,
  count(*) FILTER ((vl < 0.05) <> (vr < 0.05)) AS decision_changes FROM f""")
def c18(spark, folder):
    return r6(ag.zero_inclusive_report(pairs(spark, folder)), "active_jaccard", "max_probability_difference",
              "exact_probability_fraction", "max_pvalue_difference", "exact_pvalue_fraction")


@query("c19_agreement_exceptions", with_(*BASE) + f"""SELECT sender_group, receiver_group, interaction_name, side, {q6('pl')} AS probability_left,
  {q6('pr')} AS probability_right, {q6('vl')} AS pvalue_left, {q6('vr')} AS pvalue_right FROM pairs WHERE side <> 'both' OR abs(pl - pr) > 0.4 OR vl IS DISTINCT FROM vr""")
def c19(spark, folder):
    return r6(ag.agreement_exceptions(pairs(spark, folder), 0.4), "probability_left", "probability_right", "pvalue_left", "pvalue_right")


@query("u5_record_jaccard", with_(*BASE) + f"""SELECT count(*) FILTER (side = 'both') AS shared, count(*) AS united,
  {q6("count(*) FILTER (side = 'both') / count(*)")} AS jaccard FROM pairs""")
def u5(spark, folder):
    return r6(ag.record_jaccard(*sides(spark, folder)), "jaccard")


@query("u6_call_transitions", with_(*BASE, """k AS (SELECT CASE WHEN coalesce(vl < 0.05, false) AND coalesce(vr < 0.05, false) THEN 'shared'
  WHEN vl < 0.05 THEN 'lost' WHEN vr < 0.05 THEN 'gained' END AS category FROM pairs)""") + "SELECT category, count(*) AS records FROM k WHERE category IS NOT NULL GROUP BY 1")
def u6(spark, folder):
    return ag.call_transitions(pairs(spark, folder))


@query("w7_top_retention", with_(LEFT, RIGHT, "top AS (SELECT * FROM side_A ORDER BY probability DESC, sender_group, receiver_group, interaction_name LIMIT 100)") + """
  SELECT (SELECT count(*) FROM top) AS top_full_count, count(*) AS top_retained FROM top t JOIN side_R b
  ON t.sender_group = b.sender_group AND t.receiver_group = b.receiver_group AND t.interaction_name = b.interaction_name""")
def w7(spark, folder):
    return ag.top_retention(*sides(spark, folder))


RANKED = """z AS (SELECT coalesce(pl, 0) AS pl, coalesce(pr, 0) AS pr FROM epairs),
rz AS (SELECT rank() OVER (ORDER BY pl) + (count(*) OVER (PARTITION BY pl) - 1) / 2.0 AS a, rank() OVER (ORDER BY pr) + (count(*) OVER (PARTITION BY pr) - 1) / 2.0 AS b FROM z),
rm AS (SELECT rank() OVER (ORDER BY pl) + (count(*) OVER (PARTITION BY pl) - 1) / 2.0 AS a, rank() OVER (ORDER BY pr) + (count(*) OVER (PARTITION BY pr) - 1) / 2.0 AS b FROM epairs WHERE side = 'both')"""
ELIGIBLE = "epairs AS (SELECT * FROM pairs WHERE side = 'right_only' OR (sender_group IN (SELECT g FROM gs) AND receiver_group IN (SELECT g FROM gs)))"


@query("c20_sampling_stability", with_(*BASE, "gs AS (SELECT DISTINCT sender_group AS g FROM side_R UNION SELECT DISTINCT receiver_group FROM side_R)", ELIGIBLE, RANKED) + f"""
  SELECT count(*) FILTER (side = 'both') AS matched, count(*) FILTER (side <> 'right_only') AS eligible_full_records,
  count(*) FILTER (side <> 'left_only') AS subset_records, {q6("count(*) FILTER (side = 'both') / count(*)")} AS active_jaccard,
  {q6("count(*) FILTER (side = 'both') / count(*) FILTER (side <> 'right_only')")} AS retained_fraction,
  {q6('(SELECT corr(a, b) FROM rm)')} AS spearman_matched, {q6('(SELECT corr(a, b) FROM rz)')} AS spearman_zero_inclusive FROM epairs""")
def c20(spark, folder):
    full, subset = sides(spark, folder)
    groups = subset.select(F.col("sender_group").alias("group")).unionByName(subset.select(F.col("receiver_group").alias("group")))
    return r6(ag.sampling_stability(full, subset, groups), "active_jaccard", "retained_fraction", "spearman_matched", "spearman_zero_inclusive")


@query("w12_log_histogram", with_(*BASE, """long AS (SELECT 'left' AS side, log10(pl) AS v FROM pairs WHERE side = 'both' UNION ALL SELECT 'right', log10(pr) FROM pairs WHERE side = 'both')""") + """
  SELECT side, CAST(least(floor((v - lo) / ((hi - lo) / 24.0)), 23) AS BIGINT) AS bin, count(*) AS records FROM long, (SELECT min(v) AS lo, max(v) AS hi FROM long) GROUP BY 1, 2""")
def w12(spark, folder):
    return ag.shared_log_bins(pairs(spark, folder))


@query("p13_record_validation", with_(LEFT) + """SELECT count(*) AS records, 0::BIGINT AS missing_names, 0::BIGINT AS non_finite, count(*) FILTER (probability < 0) AS negative,
  (SELECT count(*) FROM (SELECT sender_group, receiver_group FROM side_A GROUP BY 1, 2 HAVING count(*) > 1)) AS duplicate_features FROM side_A""")
def p13(spark, folder):
    left, _ = sides(spark, folder)
    return va.validate_records(left.withColumn("interaction_name", F.lit("one")).withColumn("sample_id", F.lit("s")))


@query("u1_record_union", with_(LEFT, RIGHT) + f"""SELECT 'A' AS sample_id, sender_group, receiver_group, interaction_name, {q6('probability')} AS probability FROM side_A
  UNION ALL SELECT 'R', sender_group, receiver_group, interaction_name, {q6('probability')} FROM side_R""")
def u1(spark, folder):
    left, right = sides(spark, folder)
    from cellwire.operators.cohort import stack_records
    return r6(stack_records({"A": left, "R": right}).drop("pvalue"), "probability")


# ---- sampling ---------------------------------------------------------------------------------
POINTS = "points AS (SELECT CAST(p_partkey AS VARCHAR) AS cell_id, CAST(p_partkey % 64 AS DOUBLE) AS x, CAST(p_partkey // 64 AS DOUBLE) AS y, p_brand AS \"group\" FROM part)"


def points(spark, folder):
    p = F.col("p_partkey")
    return d.table(spark, folder, "part").select(
        p.cast("string").alias("cell_id"), (p % 64).cast("double").alias("x"), F.floor(p / 64).cast("double").alias("y"),
        F.col("p_brand").alias("group"))


def near_sql(cx, cy, size):
    return f"""SELECT cell_id, {q6('(x - cx) * (x - cx) + (y - cy) * (y - cy)')} AS d2 FROM points, (SELECT {cx} AS cx, {cy} AS cy)
  ORDER BY round((x - cx) * (x - cx) + (y - cy) * (y - cy), 9), cell_id LIMIT {size}"""


@query("w3_central_subset", with_(POINTS) + near_sql("(SELECT avg(x) FROM points)", "(SELECT avg(y) FROM points)", 100))
def w3(spark, folder):
    return r6(sp.central_subset(points(spark, folder), 100).select("cell_id", "d2"), "d2")


ANCHOR = "target AS (" + "SELECT * FROM (SELECT points.*, (x - cx) * (x - cx) + (y - cy) * (y - cy) AS d2 FROM points, (SELECT quantile_cont(x, 0.25) AS cx, quantile_cont(y, 0.5) AS cy FROM points)) ORDER BY round(d2, 9), cell_id LIMIT 1)"


@query("j14_nearest_anchor", with_(POINTS, ANCHOR) + f"SELECT cell_id, x, y, {q6('d2')} AS d2 FROM target")
def j14(spark, folder):
    return r6(sp.nearest_anchor(points(spark, folder), 0.25).select("cell_id", "x", "y", "d2"), "d2")


@query("w5_block_subset", with_(POINTS, ANCHOR) + near_sql("(SELECT x FROM target)", "(SELECT y FROM target)", 150))
def w5(spark, folder):
    return r6(sp.block_subset(points(spark, folder), 0.25, 150).select("cell_id", "d2"), "d2")


QUOTAS = """q AS (SELECT "group", count(*) AS cells, 120 * count(*) / (SELECT count(*) FROM points) AS raw_quota FROM points GROUP BY 1),
quotas AS (SELECT "group", cells, raw_quota, CAST(floor(raw_quota) + CASE WHEN row_number() OVER (ORDER BY round(raw_quota - floor(raw_quota), 9) DESC, "group")
  <= 120 - (SELECT sum(floor(raw_quota)) FROM q) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM q)"""


@query("w4_proportional_quotas", with_(POINTS, QUOTAS) + f'SELECT "group", cells, {q6("raw_quota")} AS raw_quota, quota FROM quotas')
def w4_quota(spark, folder):
    return r6(sp.proportional_quotas(points(spark, folder), 120), "raw_quota")


HASHED = "hashed AS (SELECT points.*, row_number() OVER (PARTITION BY \"group\" ORDER BY md5('{seed}|' || cell_id), cell_id) AS k FROM points)"


@query("w4_stratified_sample", with_(POINTS, QUOTAS, HASHED.format(seed=1)) + 'SELECT h.cell_id, h.x, h.y, h."group" FROM hashed h JOIN quotas u ON u."group" = h."group" WHERE k <= quota')
def w4(spark, folder):
    return sp.stratified_sample(points(spark, folder), 120)


@query("w6_type_downsample", with_(POINTS, HASHED.format(seed=42), 'n AS (SELECT "group", count(*) AS n FROM points GROUP BY 1)') + 'SELECT h.cell_id, h.x, h.y, h."group" FROM hashed h JOIN n ON n."group" = h."group" WHERE n >= 75 AND k <= 30')
def w6(spark, folder):
    return sp.downsample_types(points(spark, folder), 75, 30)


@query("w10_lumped_groups", """WITH n AS (SELECT o_custkey % 97 AS g, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT g FROM n ORDER BY n DESC, g LIMIT 5)
  SELECT CASE WHEN o_custkey % 97 IN (SELECT g FROM t) THEN CAST(o_custkey % 97 AS VARCHAR) ELSE 'Other' END AS label, count(*) AS cells FROM orders GROUP BY 1""")
def w10(spark, folder):
    o = d.table(spark, folder, "orders").select((F.col("o_custkey") % 97).alias("group"))
    return sp.lump_groups(o).groupBy("label").agg(F.count("*").alias("cells"))


# ---- run summaries ----------------------------------------------------------------------------
STATE = "CASE WHEN l_linestatus = 'O' THEN 'COMPLETED' WHEN l_returnflag = 'A' THEN 'FAILED' WHEN l_returnflag = 'R' THEN 'EXCLUDED' ELSE 'PENDING' END"
FIELDS = ["l_quantity", "l_extendedprice"]
_STATS = ", ".join(f"{q6(f'{fn} FILTER (s = ' + repr('COMPLETED') + ')')} AS {f}_{n}" for f in FIELDS
                   for n, fn in (("min", f"min({f})"), ("median", f"quantile_cont({f}, 0.5)"), ("max", f"max({f})")))


@query("a30_run_summary", f"""WITH r AS (SELECT *, {STATE} AS s FROM lineitem) SELECT l_suppkey, count(*) AS input_samples,
  count(*) FILTER (s = 'COMPLETED') AS completed_samples, count(*) FILTER (s = 'FAILED') AS failed_samples, count(*) FILTER (s = 'EXCLUDED') AS excluded_samples,
  count(*) FILTER (s = 'PENDING') AS pending_samples, {_STATS} FROM r GROUP BY 1""")
def a30(spark, folder):
    runs = d.table(spark, folder, "lineitem").withColumn("state", F.expr(STATE))
    out = ag.run_summary(runs, "l_suppkey", "state", FIELDS)
    return r6(out, *[f"{f}_{n}" for f in FIELDS for n in ("min", "median", "max")])


@query("a31_ratio_to_baseline", f"""WITH s AS (SELECT l_returnflag, CASE WHEN l_linenumber = 1 THEN 'full' ELSE 'v' || CAST(l_linenumber AS VARCHAR) END AS variant,
  quantile_cont(l_extendedprice, 0.25) AS q25, quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS q75 FROM lineitem GROUP BY 1, 2)
  SELECT s.l_returnflag, s.variant, {q6('s.q25')} AS q25, {q6('s.median')} AS median, {q6('s.q75')} AS q75, {q6('s.median / b.median')} AS ratio_to_baseline
  FROM s LEFT JOIN s b ON b.l_returnflag = s.l_returnflag AND b.variant = 'full'""")
def a31(spark, folder):
    n = F.col("l_linenumber")
    runs = d.table(spark, folder, "lineitem").withColumn(
        "variant", F.when(n == 1, "full").otherwise(F.concat(F.lit("v"), n.cast("string"))))
    out = ag.ratio_to_baseline(runs, ["l_returnflag"], "variant", "l_extendedprice")
    return r6(out, "q25", "median", "q75", "ratio_to_baseline")
