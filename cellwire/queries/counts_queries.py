"""Count tables, binned grids, mixtures and file formats on the derived counts."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cellwire import sources
from cellwire.sources import readers  # noqa: F401
from cellwire.operators import counts as ct
from cellwire.operators import mixtures as mx
from cellwire.operators import validation as va
from cellwire.operators.expression import log_cp10k
from cellwire.operators.session import shared_folder
from cellwire.plans import communication as comm
from cellwire.plans.bins import bin_communication
from cellwire.queries import domain as d
from cellwire.queries.registry import q6, query, r6, with_

LIB = "lib AS (SELECT barcode, CAST(sum(n) AS BIGINT) AS umi, count(DISTINCT gene) AS n_genes FROM counts GROUP BY 1)"
CC = (d.COUNTS, LIB)


def new_path(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("p2_log_cp10k", with_(*CC) + f"""SELECT barcode, feature_id, gene, n, {q6('ln(1 + 10000.0 * n / umi)')} AS value
  FROM counts JOIN lib USING (barcode)""")
def p2(spark, folder):
    return r6(log_cp10k(d.counts(spark, folder), ["barcode"]), "value")


@query("p3_cell_quality", with_(*CC) + """SELECT p_partkey AS barcode, CASE WHEN p_size > 5 THEN p_type END AS "group", coalesce(umi, 0) AS umi,
  coalesce(n_genes, 0) AS n_genes, concat_ws(';', CASE WHEN p_size <= 5 THEN 'missing_official_annotation' END,
  CASE WHEN coalesce(umi, 0) < 700 THEN 'counts_below_threshold' END, CASE WHEN coalesce(n_genes, 0) < 22 THEN 'features_below_threshold' END)
  AS exclusion_reason FROM part LEFT JOIN lib ON barcode = p_partkey""")
def p3(spark, folder):
    cells = d.table(spark, folder, "part").select(
        F.col("p_partkey").alias("barcode"), F.when(F.col("p_size") > 5, F.col("p_type")).alias("group"))
    return ct.cell_quality(d.counts(spark, folder), cells, 700, 22)


@query("p4_library_filter", with_(*CC) + "SELECT c.* FROM counts c JOIN lib USING (barcode) WHERE umi > 750")
def p4(spark, folder):
    return ct.filter_library(d.counts(spark, folder), 750)


@query("p5_bin_eligibility", with_(*CC, d.POSITIONS) + """SELECT barcode, coalesce(umi, 0) AS umi, coalesce(n_genes, 0) AS n_genes,
  CASE WHEN coalesce(umi, 0) <= 0 THEN 'zero_counts' WHEN umi < 700 THEN 'low_umi' WHEN n_genes < 24 THEN 'low_genes' END AS filter_reason,
  coalesce(umi >= 700 AND n_genes >= 24, false) AS eligible FROM positions LEFT JOIN lib USING (barcode)""")
def p5(spark, folder):
    return ct.bin_eligibility(d.counts(spark, folder), d.positions(spark, folder), 700, 24)


@query("p6_in_tissue", with_(d.COUNTS, d.POSITIONS) + "SELECT c.* FROM counts c JOIN positions USING (barcode) WHERE in_tissue = 1")
def p6(spark, folder):
    return ct.in_tissue(d.counts(spark, folder), d.positions(spark, folder))


ALLOWED = "allowed AS (SELECT s_suppkey AS feature_id FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT -n_nationkey - 1 FROM nation)"


def allowed(spark, folder):
    extra = d.table(spark, folder, "nation").select((-F.col("n_nationkey") - 1).cast("long").alias("feature_id"))
    return d.table(spark, folder, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("feature_id")).unionByName(extra)


@query("p7_feature_policy", with_(d.COUNTS, ALLOWED) + """SELECT barcode, gene, CAST(sum(n) AS BIGINT) AS n FROM counts
  WHERE feature_id IN (SELECT feature_id FROM allowed) GROUP BY 1, 2""")
def p7(spark, folder):
    return ct.collapse_genes(ct.keep_features(d.counts(spark, folder), allowed(spark, folder)))


@query("p7_unknown_features", with_(d.COUNTS, ALLOWED) + "SELECT DISTINCT feature_id FROM allowed WHERE feature_id NOT IN (SELECT feature_id FROM counts)")
def p7_unknown(spark, folder):
    return ct.unknown_features(allowed(spark, folder), d.counts(spark, folder))


@query("p8_count_validation", """SELECT count(*) AS rows, count(*) FILTER (l_discount IS NULL OR isnan(l_discount) OR isinf(l_discount)) AS non_finite,
  count(*) FILTER (l_discount < 0) AS negative, count(*) FILTER (l_discount <> floor(l_discount)) AS non_integer, 0::BIGINT AS empty_names,
  (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_partkey, l_suppkey HAVING count(*) > 1)) AS duplicate_keys FROM lineitem""")
def p8(spark, folder):
    raw = d.table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("barcode"), F.col("l_suppkey").alias("feature_id"), F.col("l_discount").alias("n"))
    return va.validate_counts(raw)


@query("p9_position_validation", """WITH p AS (SELECT *, 's_008um_' || lpad(CAST(p_partkey // 64 AS VARCHAR), 5, '0') || '_' ||
  lpad(CAST(p_partkey % 64 + CASE WHEN p_size > 45 THEN 1 ELSE 0 END AS VARCHAR), 5, '0') || '-1' AS barcode FROM part)
  SELECT count(*) AS positions, 0::BIGINT AS missing_barcodes, 0::BIGINT AS bad_grid, 0::BIGINT AS bad_tissue, 0::BIGINT AS size_mismatch,
  count(*) FILTER (p_size > 45) AS grid_mismatch, (SELECT count(*) FROM (SELECT barcode FROM p GROUP BY 1 HAVING count(*) > 1)) AS duplicate_barcodes,
  0::BIGINT AS duplicate_places FROM p""")
def p9(spark, folder):
    p = d.positions(spark, folder).join(
        d.table(spark, folder, "part").select(F.col("p_partkey").alias("barcode"), "p_size"), "barcode")
    shift = F.when(F.col("p_size") > 45, 1).otherwise(0)
    named = p.withColumn("barcode", F.format_string("s_008um_%05d_%05d-1", "array_row", F.col("array_col") + shift))
    return va.validate_positions(named, 8)


@query("a13_gene_collapse", with_(d.COUNTS) + "SELECT barcode, gene, CAST(sum(n) AS BIGINT) AS n FROM counts GROUP BY 1, 2")
def a13(spark, folder):
    return ct.collapse_genes(d.counts(spark, folder))


def coarse_sql(size, factor):
    return f"""'s_{size:03d}um_' || lpad(CAST(array_row // {factor} AS VARCHAR), 5, '0') || '_' || lpad(CAST(array_col // {factor} AS VARCHAR), 5, '0') || '-1'"""


@query("a14_coarse_counts", with_(d.COUNTS, d.POSITIONS) + f"""SELECT {coarse_sql(16, 2)} AS barcode, gene, CAST(sum(n) AS BIGINT) AS n
  FROM counts JOIN positions USING (barcode) GROUP BY 1, 2""")
def a14(spark, folder):
    return ct.coarsen(d.counts(spark, folder), d.positions(spark, folder), 8, 16)[0]


@query("a14_coarse_positions", with_(d.COUNTS, d.POSITIONS) + f"""SELECT {coarse_sql(32, 4)} AS barcode, any_value(array_row // 4) AS array_row,
  any_value(array_col // 4) AS array_col, max(in_tissue) AS in_tissue, count(*) FILTER (barcode IN (SELECT barcode FROM counts)) AS source_bin_count,
  count(*) AS source_position_count, count(*) = 16 AS source_positions_complete FROM positions GROUP BY {coarse_sql(32, 4)}""")
def a14_positions(spark, folder):
    return ct.coarsen(d.counts(spark, folder), d.positions(spark, folder), 8, 32)[1]


@query("a15_bin_preparation", with_(d.COUNTS, d.POSITIONS) + """SELECT *, (array_col + 0.5) * 8.0 AS x, (array_row + 0.5) * 8.0 AS y FROM positions
  WHERE in_tissue = 1 AND barcode IN (SELECT barcode FROM counts)""")
def a15(spark, folder):
    return ct.prepare_bins(d.counts(spark, folder), d.positions(spark, folder), 8)[1]


@query("a16_bin_equivalence", with_(d.COUNTS, d.POSITIONS) + f"""SELECT 0::BIGINT AS max_count_difference, 0::BIGINT AS different_entries,
  0::BIGINT AS unmatched_genes, 0::BIGINT AS unmatched_barcodes, count(DISTINCT barcode) * 0 AS mask_differences FROM counts""")
def a16(spark, folder):
    counts, positions = d.counts(spark, folder), d.positions(spark, folder)
    direct = ct.coarsen(counts, positions, 8, 32)
    step = ct.coarsen(counts, positions, 8, 16)
    return ct.bin_equivalence(direct, ct.coarsen(*step, 16, 32))


WINDOWS = """blocks AS (SELECT array_row // 4 AS r, array_col // 4 AS c, count(*) AS p, sum(in_tissue) AS t, count(umi) AS o,
  count(*) FILTER (umi >= 700 AND n_genes >= 20) AS dp FROM positions LEFT JOIN lib USING (barcode) GROUP BY 1, 2),
win AS (SELECT r - i AS row_start, c - j AS col_start, CAST(sum(p) AS BIGINT) AS position_count, sum(t) / 96.0 AS tissue_fraction,
  sum(o) / 96.0 AS observed_fraction, sum(dp) / 96.0 AS depth_fraction FROM blocks, range(0, 2) AS a(i), range(0, 3) AS b(j)
  WHERE r - i >= 0 AND c - j >= 0 AND r - i <= (SELECT max(r) FROM blocks) - 1 AND c - j <= (SELECT max(c) FROM blocks) - 2 GROUP BY 1, 2)"""
FRACTIONS = ["tissue_fraction", "observed_fraction", "depth_fraction"]


def windows(spark, folder):
    return ct.region_windows(d.counts(spark, folder), d.positions(spark, folder), 4, 2, 3, 700, 20)


@query("w8_region_windows", with_(*CC, d.POSITIONS, WINDOWS) + "SELECT row_start, col_start, position_count, "
       + ", ".join(f"{q6(c)} AS {c}" for c in FRACTIONS) + " FROM win")
def w8(spark, folder):
    return r6(windows(spark, folder), *FRACTIONS)


BEST = """mid AS (SELECT quantile_cont(array_row / 4, 0.5) AS mr, quantile_cont(array_col / 4, 0.5) AS mc FROM positions WHERE in_tissue = 1),
scored AS (SELECT *, position_count = 96 AND tissue_fraction >= 0.7 AND observed_fraction >= 0.9 AND depth_fraction >= 0.3 AS eligible,
  32 * sqrt((row_start + 1.0 - mr) * (row_start + 1.0 - mr) + (col_start + 1.5 - mc) * (col_start + 1.5 - mc)) AS distance_um FROM win, mid),
best AS (SELECT *, CAST(row_number() OVER (ORDER BY eligible DESC, round(distance_um, 9), depth_fraction DESC, tissue_fraction DESC, row_start, col_start)
  AS INTEGER) AS rank FROM scored)"""


def regions(spark, folder):
    return ct.best_regions(windows(spark, folder), d.positions(spark, folder), 4, 2, 3, 32, 0.7, 0.9, 0.3, top=100)


@query("w8_best_regions", with_(*CC, d.POSITIONS, WINDOWS, BEST) + "SELECT row_start, col_start, position_count, eligible, rank, "
       + ", ".join(f"{q6(c)} AS {c}" for c in [*FRACTIONS, "distance_um"]) + " FROM best WHERE rank <= 100")
def w8_best(spark, folder):
    return r6(regions(spark, folder), *FRACTIONS, "distance_um")


@query("w9_region_crop", with_(*CC, d.POSITIONS, WINDOWS, BEST) + """SELECT p.* FROM positions p, best b WHERE rank = 1
  AND array_row BETWEEN row_start * 4 AND row_start * 4 + 7 AND array_col BETWEEN col_start * 4 AND col_start * 4 + 11""")
def w9(spark, folder):
    best = regions(spark, folder).where("rank = 1")
    start = [best.select(c).scalar() for c in ("row_start", "col_start")]
    return ct.crop_region(d.positions(spark, folder), *start, 2, 3, 4)


# ---- mixtures ---------------------------------------------------------------------------------
STATES = """states AS (SELECT p.barcode, CASE WHEN in_tissue = 0 THEN 'filtered' ELSE 'ok' END AS prior, m.top, m.ties, m.best FROM positions p LEFT JOIN
  (SELECT barcode, max(w) AS top, any_value(ties) AS ties, max_by(cell_type, w) AS best FROM (SELECT w.*, count(*) FILTER (abs(w.w - t.top) <= 1e-10) OVER (PARTITION BY w.barcode) AS ties
   FROM weights w JOIN (SELECT barcode, max(w) AS top FROM weights GROUP BY 1) t USING (barcode)) GROUP BY 1) m USING (barcode)),
ann AS (SELECT barcode, CASE WHEN prior <> 'ok' THEN prior WHEN top IS NULL THEN 'not_fit' WHEN ties > 1 THEN 'ambiguous' ELSE 'ok' END AS status,
  coalesce(top, 0) AS max_weight, CASE WHEN prior = 'ok' AND ties = 1 THEN best END AS dominant_type FROM states)"""
MIX = (d.WEIGHTS, d.POSITIONS, STATES)


def weights(spark, folder):
    return mx.normalize_weights(d.raw_weights(spark, folder))


def annotations(spark, folder):
    prior = F.when(F.col("in_tissue") == 0, "filtered").otherwise("ok").alias("status")
    return mx.annotate_bins(d.positions(spark, folder).select("barcode", prior), weights(spark, folder))


@query("a21_weight_normalisation", with_(d.WEIGHTS) + f"SELECT barcode, cell_type, {q6('w')} AS w FROM weights")
def a21(spark, folder):
    return r6(weights(spark, folder), "w")


@query("a22_weight_annotation", with_(*MIX) + f"SELECT barcode, status, dominant_type, {q6('max_weight')} AS max_weight FROM ann")
def a22(spark, folder):
    return r6(annotations(spark, folder), "max_weight")


PAIR = """pairs AS (SELECT l_orderkey AS barcode, CASE WHEN l_returnflag = 'R' THEN 'reject' WHEN l_returnflag = 'N' THEN 'singlet' WHEN l_linestatus = 'F'
  THEN 'doublet_certain' ELSE 'doublet_uncertain' END AS spot_class, 'T' || CAST(l_suppkey % 6 AS VARCHAR) AS first_type,
  'T' || CAST((l_suppkey + 1 + l_linenumber % 5) % 6 AS VARCHAR) AS second_type, l_quantity AS w_first, l_discount * 100 AS w_second,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS k FROM lineitem),
pr AS (SELECT * FROM pairs WHERE k = 1),
pw AS (SELECT barcode, first_type AS cell_type, CASE WHEN spot_class = 'singlet' THEN 1.0 ELSE w_first END AS w FROM pr WHERE spot_class <> 'reject'
  UNION ALL SELECT barcode, second_type, CASE WHEN spot_class = 'singlet' THEN 0.0 ELSE w_second END FROM pr WHERE spot_class <> 'reject'),
pn AS (SELECT barcode, cell_type, w / sum(w) OVER (PARTITION BY barcode) AS w FROM pw WHERE w > 0)"""


def pair_results(spark, folder):
    """One two-type fit per order: the first line of each order."""
    flag, s = F.col("l_returnflag"), F.col("l_suppkey")
    kind = F.when(flag == "R", "reject").when(flag == "N", "singlet").when(
        F.col("l_linestatus") == "F", "doublet_certain").otherwise("doublet_uncertain")
    text = lambda c: F.concat(F.lit("T"), (c % 6).cast("string"))
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    fields = F.struct(kind.alias("spot_class"), text(s).alias("first_type"),
                      text(s + 1 + F.col("l_linenumber") % 5).alias("second_type"),
                      F.col("l_quantity").alias("w_first"), (F.col("l_discount") * 100).alias("w_second"))
    return d.table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("barcode")).agg(
        F.min_by(fields, order).alias("_f")).select("barcode", "_f.*")


@query("a22_pair_annotation", with_(PAIR, """pm AS (SELECT barcode, max(w) AS top, count(*) AS n, max(w) - min(w) AS gap, max_by(cell_type, w) AS best FROM pn GROUP BY 1)""") + f"""
  SELECT pr.barcode, spot_class, CASE WHEN spot_class <> 'reject' THEN first_type END AS first_type,
  CASE WHEN spot_class NOT IN ('reject', 'singlet') THEN second_type END AS second_type,
  CASE WHEN spot_class = 'reject' THEN 'reject' WHEN spot_class = 'doublet_uncertain' THEN 'ambiguous' WHEN n = 2 AND gap <= 1e-10 THEN 'ambiguous' ELSE 'ok' END AS status,
  {q6('coalesce(top, 0)')} AS max_weight, CASE WHEN spot_class IN ('singlet', 'doublet_certain') AND NOT (n = 2 AND gap <= 1e-10) THEN best END AS dominant_type
  FROM pr LEFT JOIN pm USING (barcode)""")
def a22_pair(spark, folder):
    bins, pair = mx.pair_weights(pair_results(spark, folder))
    return r6(mx.annotate_bins(bins, pair), "max_weight")


@query("a22_multi_annotation", with_(d.WEIGHTS, d.COUNTS, """conf AS (SELECT l_partkey AS barcode, 'T' || CAST(l_suppkey % 6 AS VARCHAR) AS cell_type, bool_and(l_discount < 0.095) AS c
  FROM lineitem GROUP BY 1, 2), mb AS (SELECT barcode, bool_and(c) AS c FROM conf GROUP BY 1),
  mt AS (SELECT w.barcode, max(w) AS top, max_by(cell_type, w) AS best FROM weights w GROUP BY 1),
  tie AS (SELECT w.barcode, count(*) AS ties FROM weights w JOIN mt USING (barcode) WHERE abs(w.w - top) <= 1e-10 GROUP BY 1)""") + f"""
  SELECT barcode, CASE WHEN NOT c OR ties > 1 THEN 'ambiguous' ELSE 'ok' END AS status, {q6('top')} AS max_weight,
  CASE WHEN c AND ties = 1 THEN best END AS dominant_type FROM mb JOIN mt USING (barcode) JOIN tie USING (barcode)""")
def a22_multi(spark, folder):
    results = d.table(spark, folder, "lineitem").groupBy(
        F.col("l_partkey").alias("barcode"), F.concat(F.lit("T"), (F.col("l_suppkey") % 6).cast("string")).alias("cell_type")
    ).agg(F.sum("l_quantity").alias("w"), F.min(F.col("l_discount") < 0.095).alias("confident"))
    return r6(mx.annotate_bins(*mx.multi_weights(results)), "max_weight")


@query("a23_dominant_bins", with_(*MIX) + f"""SELECT barcode, status, dominant_type, {q6('max_weight')} AS max_weight,
  CASE WHEN status <> 'ok' THEN 'rctd_not_accepted' WHEN max_weight < 0.3 THEN 'below_min_weight' ELSE 'retained' END AS exclusion_reason,
  status = 'ok' AND max_weight >= 0.3 AS included FROM ann""")
def a23(spark, folder):
    return r6(mx.dominant_bins(annotations(spark, folder), weights(spark, folder), 0.3), "max_weight")


@query("a23_bin_expression", with_(*MIX, *CC) + f"""SELECT 'sample_1' AS sample_id, CAST(c.barcode AS VARCHAR) AS cell_id, gene, {q6('ln(1 + 10000.0 * sum(n) / any_value(umi))')} AS value
  FROM counts c JOIN lib USING (barcode) JOIN ann a USING (barcode) WHERE status = 'ok' AND a.max_weight >= 0.3 GROUP BY c.barcode, gene""")
def a23_expression(spark, folder):
    return r6(hd_cells(spark, folder)[0], "value")


def hd_cells(spark, folder):
    genes = ct.collapse_genes(d.counts(spark, folder))
    bins = ct.with_coordinates(d.positions(spark, folder), 8)
    return mx.bins_as_cells(genes, bins, annotations(spark, folder), weights(spark, folder), 0.3)


HD_LR = "VALUES (1, 'f0', 'f1', 'Secreted Signaling'), (2, 'f2', 'f3', 'Cell-Cell Contact'), (3, 'f4', 'f5', 'Secreted Signaling')"
HD = (*MIX, *CC, """kept AS (SELECT a.barcode, dominant_type AS g, (array_col + 0.5) * 8 AS x, (array_row + 0.5) * 8 AS y FROM ann a JOIN positions p USING (barcode)
  WHERE status = 'ok' AND max_weight >= 0.3),
hexpr AS (SELECT c.barcode, gene, ln(1 + 10000.0 * sum(n) / any_value(umi)) AS v FROM counts c JOIN lib USING (barcode) JOIN kept USING (barcode) GROUP BY 1, 2),
hval AS (SELECT barcode, gene, v / (SELECT max(v) FROM hexpr) AS v FROM hexpr),
hgraph AS (SELECT a.barcode AS s, b.barcode AS r, a.g AS sg, b.g AS rg, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist
  FROM kept a JOIN kept b ON a.barcode <> b.barcode AND abs(a.x - b.x) <= 24 AND abs(a.y - b.y) <= 24),
hnear AS (SELECT * FROM hgraph WHERE dist > 0 AND dist <= 24), hmin AS (SELECT min(dist) AS m FROM hnear)""",
      f"hlr AS (SELECT * FROM ({HD_LR}) AS t(lr_index, ligand, receptor, annotation))",
      """hterm AS (SELECT lr_index, sg, rg, l.v * r.v / (0.5 + l.v * r.v) / (dist * 0.01) AS p FROM hnear JOIN hval l ON l.barcode = s JOIN hval r ON r.barcode = r
  JOIN hlr ON l.gene = ligand AND r.gene = receptor WHERE annotation <> 'Cell-Cell Contact' OR dist <= 8
  UNION ALL SELECT lr_index, g, g, l.v * r.v / (0.5 + l.v * r.v) / (m * 0.01) FROM hmin, hval l JOIN hval r ON l.barcode = r.barcode
  JOIN hlr ON l.gene = ligand AND r.gene = receptor JOIN kept k ON k.barcode = l.barcode)""")


@query("a24_bin_communication", with_(*HD).replace("JOIN hval r ON r.barcode = r\n", "JOIN hval r ON r.barcode = hnear.r\n") + f"""SELECT lr_index, sg AS sender_group, rg AS receiver_group,
  {q6('avg(p)')} AS probability, count(*) AS active_edges FROM hterm GROUP BY 1, 2, 3""")
def a24(spark, folder):
    genes = ct.collapse_genes(d.counts(spark, folder))
    places = ct.with_coordinates(d.positions(spark, folder), 8)
    lr = spark.sql(f"SELECT lr_index, concat(ligand, '_', receptor) AS interaction_name, ligand, receptor, annotation "
                   f"FROM ({HD_LR}) AS t(lr_index, ligand, receptor, annotation)")
    settings = comm.Settings(tol=0.0, interaction_range=24.0, contact_range=8.0, min_percent=0.0, min_cells=1)
    out = bin_communication(genes, places, annotations(spark, folder), weights(spark, folder), lr, min_weight=0.3, settings=settings)
    return r6(out.select("lr_index", "sender_group", "receiver_group", "probability", "active_edges"), "probability")


METRICS = ["pct_singlet", "pct_doublet", "pct_doublet_certain", "pct_doublet_uncertain", "mean_max_weight", "mean_top2_gap",
           "mean_entropy", "singlet_purity", "doublet_balance"]


@query("a25_mixture_metrics", with_(PAIR, """per AS (SELECT barcode, max(w) AS t1, coalesce(max(w) FILTER (k = 2), 0) AS t2, sum(-w * log2(w + 1e-12)) AS e
  FROM (SELECT *, row_number() OVER (PARTITION BY barcode ORDER BY w DESC, cell_type) AS k FROM pn) GROUP BY 1)""") + f"""SELECT count(*) AS n_cells,
  {q6("100.0 * count(*) FILTER (spot_class = 'singlet') / count(*)")} AS pct_singlet,
  {q6("100.0 * count(*) FILTER (spot_class LIKE 'doublet%') / count(*)")} AS pct_doublet,
  {q6("100.0 * count(*) FILTER (spot_class = 'doublet_certain') / count(*)")} AS pct_doublet_certain,
  {q6("100.0 * count(*) FILTER (spot_class = 'doublet_uncertain') / count(*)")} AS pct_doublet_uncertain, {q6('avg(t1)')} AS mean_max_weight,
  {q6('avg(t1 - t2)')} AS mean_top2_gap, {q6('avg(e)')} AS mean_entropy, {q6("avg(t1) FILTER (spot_class = 'singlet')")} AS singlet_purity,
  {q6("avg(t2 / t1) FILTER (spot_class <> 'singlet')")} AS doublet_balance FROM pr LEFT JOIN per USING (barcode)""")
def a25(spark, folder):
    results = pair_results(spark, folder)
    bins, pair = mx.pair_weights(results)
    return r6(mx.mixture_metrics(bins, pair), *METRICS)


@query("a26_umi_contribution", with_(d.WEIGHTS, *CC, "fit AS (SELECT sum(umi) AS t FROM lib WHERE barcode IN (SELECT barcode FROM weights))") + f"""SELECT cell_type,
  {q6('sum(w * umi) / any_value(t)')} AS umi_weighted_contribution, CAST(any_value(t) AS BIGINT) AS fitted_umi,
  {q6('any_value(t) / (SELECT sum(umi) FROM lib)')} AS fitted_umi_fraction FROM weights JOIN lib USING (barcode), fit GROUP BY 1""")
def a26(spark, folder):
    umi = ct.library_sizes(d.counts(spark, folder)).select("barcode", "umi")
    return r6(mx.contribution(weights(spark, folder), umi), "umi_weighted_contribution", "fitted_umi_fraction")


PROFILE = [("min", 0), ("p05", 0.05), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p95", 0.95), ("max", 1)]


@query("a27_quality_profile", with_(*CC, "long AS (SELECT 'umi' AS metric, CAST(umi AS DOUBLE) AS v FROM lib UNION ALL SELECT 'n_genes', n_genes FROM lib)")
       + "SELECT metric, " + ", ".join(q6(f"quantile_cont(v, {p})") + f" AS {n}" for n, p in PROFILE) + " FROM long GROUP BY 1")
def a27(spark, folder):
    return r6(ct.quality_profile(ct.library_sizes(d.counts(spark, folder)), ["umi", "n_genes"]), *[n for n, _ in PROFILE])


@query("a27_status_counts", with_(*MIX) + "SELECT status, dominant_type IS NOT NULL AS labelled, count(*) AS bins FROM ann GROUP BY 1, 2")
def a27_status(spark, folder):
    return annotations(spark, folder).groupBy(
        "status", F.col("dominant_type").isNotNull().alias("labelled")).agg(F.count("*").alias("bins"))


HALVES = """ga AS (SELECT 'f' || CAST(l_suppkey % 60 AS VARCHAR) AS gene, CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1),
gb AS (SELECT 'f' || CAST(l_suppkey % 70 AS VARCHAR) AS gene, CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem WHERE l_orderkey % 2 = 1 GROUP BY 1)"""


def halves(spark, folder):
    out = []
    for half, m in ((0, 60), (1, 70)):
        out.append(d.table(spark, folder, "lineitem").where(F.col("l_orderkey") % 2 == half).select(
            F.concat(F.lit("f"), (F.col("l_suppkey") % m).cast("string")).alias("gene"), F.col("l_quantity").cast("long").alias("n")))
    return out


@query("a28_shared_gene_audit", with_(HALVES, "both_ AS (SELECT gene FROM ga INTERSECT SELECT gene FROM gb)") + f"""SELECT (SELECT count(*) FROM both_) AS shared_genes,
  CAST((SELECT sum(n) FROM ga) AS BIGINT) AS left_umi, CAST((SELECT sum(n) FROM ga WHERE gene IN (SELECT gene FROM both_)) AS BIGINT) AS left_shared_umi,
  {q6('(SELECT 1 - sum(n) FILTER (gene IN (SELECT gene FROM both_)) / sum(n) FROM ga)')} AS left_nonshared_fraction,
  CAST((SELECT sum(n) FROM gb) AS BIGINT) AS right_umi, CAST((SELECT sum(n) FROM gb WHERE gene IN (SELECT gene FROM both_)) AS BIGINT) AS right_shared_umi,
  {q6('(SELECT 1 - sum(n) FILTER (gene IN (SELECT gene FROM both_)) / sum(n) FROM gb)')} AS right_nonshared_fraction""")
def a28(spark, folder):
    return r6(ct.shared_gene_audit(*halves(spark, folder)), "left_nonshared_fraction", "right_nonshared_fraction")


@query("u2_shared_genes", with_(HALVES) + "SELECT gene FROM ga INTERSECT SELECT gene FROM gb")
def u2(spark, folder):
    return ct.shared_genes(*halves(spark, folder), at_least=10)


@query("u3_one_sided_ids", with_(HALVES) + """SELECT gene, 'left_only' AS side FROM ga WHERE gene NOT IN (SELECT gene FROM gb)
  UNION ALL SELECT gene, 'right_only' FROM gb WHERE gene NOT IN (SELECT gene FROM ga)""")
def u3(spark, folder):
    left, right = (t.select("gene").distinct() for t in halves(spark, folder))
    return ct.one_sided(left, right)


# ---- segmentation and labels ------------------------------------------------------------------
PIXELS = """grid AS (SELECT p_partkey // 64 // 4 AS grid_row, p_partkey % 64 // 4 AS grid_col, max(p_size) % 5 AS cluster FROM part GROUP BY 1, 2),
pix AS (SELECT l_suppkey AS label, l_partkey // 64 AS row, l_partkey % 64 AS col FROM lineitem),
looked AS (SELECT pix.*, row // 4 AS grid_row, col // 4 AS grid_col, coalesce(cluster, 0) AS cluster FROM pix LEFT JOIN grid ON grid_row = row // 4 AND grid_col = col // 4)"""


def pixels(spark, folder):
    p = F.col("p_partkey")
    grid = d.table(spark, folder, "part").groupBy(
        F.floor(F.floor(p / 64) / 4).alias("grid_row"), F.floor((p % 64) / 4).alias("grid_col")
    ).agg((F.max("p_size") % 5).alias("cluster"))
    pix = d.table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("label"), F.floor(F.col("l_partkey") / 64).alias("row"), (F.col("l_partkey") % 64).alias("col"))
    return mx.lookup_grid(pix, grid, 4)


@query("j11_grid_lookup", with_(PIXELS) + "SELECT grid_row, grid_col, cluster, count(*) AS pixels FROM looked GROUP BY 1, 2, 3")
def j11(spark, folder):
    return pixels(spark, folder).groupBy("grid_row", "grid_col", "cluster").agg(F.count("*").alias("pixels"))


@query("a20_segmentation_roll_up", with_(PIXELS, """vote AS (SELECT label, cluster, count(*) AS n, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, cluster) AS k
  FROM looked WHERE cluster > 0 GROUP BY 1, 2), cen AS (SELECT label, avg(col * 2.0 + 1) AS x, avg(row * 2.0 + 1) AS y, count(*) AS s FROM looked GROUP BY 1)""") + f"""
  SELECT c.label, {q6('x')} AS x, {q6('y')} AS y, s AS segmentation_pixels, CASE WHEN n IS NULL THEN 'Unknown' ELSE 'RAW_cluster_' || lpad(CAST(cluster AS VARCHAR), 2, '0') END AS "group",
  coalesce(n, 0) AS cluster_vote_pixels, {q6('coalesce(n, 0) / s')} AS cluster_vote_fraction FROM cen c LEFT JOIN vote v ON v.label = c.label AND k = 1""")
def a20(spark, folder):
    return r6(mx.roll_up_cells(pixels(spark, folder)), "x", "y", "cluster_vote_fraction")


@query("j10_label_transfer", """SELECT o_orderkey, o_custkey, coalesce(c_mktsegment, 'Unknown') AS c_mktsegment FROM orders
  LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey""")
def j10(spark, folder):
    cells = d.table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    labels = d.table(spark, folder, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return mx.transfer_labels(cells, labels, "o_custkey", "c_mktsegment")


# ---- formats ----------------------------------------------------------------------------------
FEATURE_NAMES = "'f' || CAST(s_suppkey % 60 AS VARCHAR)"


@query("s1_matrix_folder", with_(d.COUNTS) + """SELECT CAST(barcode AS VARCHAR) AS barcode, CAST(feature_id AS VARCHAR) AS feature_id, gene, n FROM counts""")
def s1(spark, folder):
    """Write the counts as a sparse matrix folder and read them back."""
    path = new_path(spark, "mex")
    features = d.table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("feature_id"), F.concat(F.lit("f"), (F.col("s_suppkey") % 60).cast("string")).alias("feature_name"),
        F.lit("Gene Expression").alias("feature_type"))
    barcodes = d.table(spark, folder, "part").select(F.col("p_partkey").alias("barcode"))
    sources.write_mex(d.counts(spark, folder), features, barcodes, path)
    return sources.read_mex(spark, path)


@query("s2_positions", with_(d.POSITIONS) + """SELECT CAST(barcode AS VARCHAR) AS barcode, in_tissue, array_row, array_col,
  CAST(array_row AS DOUBLE) AS pxl_row_in_fullres, CAST(array_col AS DOUBLE) AS pxl_col_in_fullres FROM positions""")
def s2(spark, folder):
    path = new_path(spark, "positions")
    d.positions(spark, folder).select(
        "barcode", "in_tissue", "array_row", "array_col", "array_row", "array_col"
    ).toDF(*sources.readers.POSITION_COLUMNS).write.option("header", False).csv(path)
    return sources.read_positions(spark, path)


@query("s3_features", """SELECT row_number() OVER (ORDER BY s_suppkey) AS row, CAST(s_suppkey AS VARCHAR) AS feature_id,
  CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE CAST(s_suppkey AS VARCHAR) END AS feature_name, 'Gene Expression' AS feature_type FROM supplier""")
def s3(spark, folder):
    path = new_path(spark, "features")
    key = F.col("s_suppkey").cast("string")
    d.table(spark, folder, "supplier").orderBy("s_suppkey").select(
        F.when(F.col("s_suppkey") % 2 == 0, F.concat_ws("\t", key, "s_name")).otherwise(key)).write.text(path)
    return sources.read_features(spark, path)


WIDE = """wide AS (SELECT CAST(s_nationkey AS VARCHAR) || 'x' || CAST(s_nationkey % 2 AS VARCHAR) AS spot_id, 'f' || CAST(l_suppkey % 60 AS VARCHAR) AS gene,
  CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2)"""


@query("s5_wide_counts", with_(WIDE) + "SELECT spot_id, gene, n FROM wide")
def s5(spark, folder):
    """Write a gene by spot text table and read it back as long counts."""
    path = new_path(spark, "wide")
    sources.write_wide_counts(spot_counts(spark, folder), path)
    return sources.read_wide_counts(spark, path)


def spot_name():
    n = F.col("s_nationkey")
    return F.concat_ws("x", n.cast("string"), (n % 2).cast("string")).alias("spot_id")


def spot_counts(spark, folder):
    line, sup = d.table(spark, folder, "lineitem"), d.table(spark, folder, "supplier")
    return line.join(sup, F.col("l_suppkey") == F.col("s_suppkey")).select(
        spot_name(), F.concat(F.lit("f"), (F.col("l_suppkey") % 60).cast("string")).alias("gene"), F.col("l_quantity").cast("long").alias("n"))


@query("s6_array_coordinates", with_(WIDE) + f"""SELECT DISTINCT spot_id, {q6("CAST(split_part(spot_id, 'x', 1) AS DOUBLE) * 0.5 * sqrt(3) * 100")} AS x,
  {q6("CAST(split_part(spot_id, 'x', 2) AS DOUBLE) * 50")} AS y FROM wide""")
def s6(spark, folder):
    return r6(ct.array_coordinates(spot_counts(spark, folder).select("spot_id").distinct()), "x", "y")


@query("s8_control_features", """SELECT doc_id, text FROM documents WHERE NOT regexp_matches(text, 'NegControl|Unassigned|Deprecated')""")
def s8(spark, folder):
    return ct.drop_control_features(d.table(spark, folder, "documents").select("doc_id", "text"), "text")


@query("s9_record_sink", with_(d.COUNTS) + "SELECT barcode, feature_id, gene, n FROM counts")
def s9(spark, folder):
    path = new_path(spark, "records")
    counts = d.counts(spark, folder)
    sources.write_records(counts, path, ["barcode", "feature_id"])
    return spark.read.csv(path, sep="\t", header=True, schema=counts.schema)


@query("s10_zero_filled", with_(d.COUNTS, "bs AS (SELECT DISTINCT barcode FROM counts)", "gs AS (SELECT DISTINCT feature_id FROM counts)") + """
  SELECT bs.barcode, gs.feature_id, CAST(coalesce(c.n, 0) AS DOUBLE) AS score FROM bs CROSS JOIN gs LEFT JOIN counts c ON c.barcode = bs.barcode AND c.feature_id = gs.feature_id""")
def s10(spark, folder):
    path = new_path(spark, "nonzero")
    counts = d.counts(spark, folder).select("barcode", "feature_id", F.col("n").cast("double").alias("score"))
    sources.write_nonzero(counts, path)
    stored = spark.read.parquet(path)
    return sources.rebuild_zero_filled(
        stored, stored.select("barcode").distinct(), stored.select("feature_id").distinct(), "barcode", "feature_id")
