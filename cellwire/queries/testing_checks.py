"""SQL of the analytic, hybrid and adaptive tests, for the checks."""
from __future__ import annotations

from cellwire.queries import scoring_queries as sq
from cellwire.queries.cohort_checks import normal_tail
from cellwire.queries.registry import q6

EPS = "2.220446049250313e-16"
# Group scores of the dense expression.
DENSE_SCORES = ("tri_obs AS (SELECT grp, gene, (quantile_cont(v, 0.25) + 2 * quantile_cont(v, 0.5) + quantile_cont(v, 0.75)) / 4 AS t, count(*) AS n FROM dval GROUP BY 1, 2)",
                "dgval AS (SELECT grp, gene, t AS value FROM tri_obs WHERE t > 0)", "dlev AS (" + sq.levels_sql("dgval", "grp") + ")",
                sq.GROUP_SCORES.replace("glev", "dlev").replace("gscore", "dscore"))


def upper_tail(z: str) -> str:
    return f"CASE WHEN {z} >= 0 THEN {normal_tail(z)} / 2 ELSE 1 - {normal_tail(z)} / 2 END"


# ---- one exchangeable population ----------------------------------------------------------------
ALL_PAIRS = f"""judged AS (SELECT d.lr_index, d.sender_group, d.receiver_group, d.supported_edges, d.probability, l.n AS nl, r.n AS nr, cr,
  (ln(l.t) + ln(r.t) - ln(ca) - ln(cb)) AS shift, (1.0 / l.n - 1.0 / nn) * va / (ca * ca) + (1.0 / r.n - 1.0 / nn) * vb / (cb * cb) - 2 * cv / nn / (ca * cb) AS lv,
  CASE WHEN lg IS NULL THEN 'non_simple_lr' WHEN d.sender_group = d.receiver_group THEN 'autocrine_pair' WHEN l.n < 30 OR r.n < 30 THEN 'small_group' END AS screen
  FROM dscore d LEFT JOIN slr USING (lr_index) LEFT JOIN pair USING (lr_index) LEFT JOIN tri_obs l ON l.grp = d.sender_group AND l.gene = lg
  LEFT JOIN tri_obs r ON r.grp = d.receiver_group AND r.gene = rg),
tested AS (SELECT *, coalesce(screen, CASE WHEN cr IS NULL OR isnan(cr) OR abs(cr) > 0.8 THEN 'strong_ligand_receptor_dependence' WHEN lv <= 1e-12 THEN 'degenerate_delta_variance' END) AS why FROM judged)"""


def inferred(mode: str, extra: str = "") -> str:
    """The common output columns from ``tested(shift, lv, cr, screen, why)``."""
    z = "shift / sqrt(lv)"
    return f"""SELECT t.lr_index, sender_group, receiver_group, lr.interaction_name, supported_edges, {q6('probability')} AS probability,
  CASE WHEN why IS NULL THEN {q6(upper_tail(z))} END AS pvalue, CASE WHEN why IS NULL THEN {q6(z)} END AS analytic_z, CASE WHEN why IS NULL THEN {q6('sqrt(lv)')} END AS analytic_log_sd,
  CASE WHEN screen IS NULL THEN {q6('cr')} END AS influence_correlation, {extra}
  CASE WHEN why IS NULL THEN '{mode}' ELSE 'permutation_fallback_required' END AS inference_mode, why AS fallback_reason FROM tested t JOIN lr ON lr.lr_index = t.lr_index"""


# The sparse expression: genes with too many zeros.
SPARSE = """share AS (SELECT gene, 1 - count(*) / (SELECT count(*) FROM cells) AS zero FROM scaled GROUP BY 1),
gsize AS (SELECT "group" AS g, count(*) AS n FROM cells GROUP BY 1),
judged AS (SELECT s.*, CASE WHEN lg IS NULL THEN 'non_simple_lr' WHEN sender_group = receiver_group THEN 'autocrine_pair' WHEN a.n < 30 OR b.n < 30 THEN 'small_group'
  WHEN l.zero > 0.1 THEN 'ligand_excessive_zero_fraction' WHEN r.zero > 0.1 THEN 'receptor_excessive_zero_fraction' END AS screen
  FROM gscore s LEFT JOIN slr USING (lr_index) JOIN gsize a ON a.g = sender_group JOIN gsize b ON b.g = receiver_group LEFT JOIN share l ON l.gene = lg LEFT JOIN share r ON r.gene = rg),
tested AS (SELECT *, screen AS why, NULL::DOUBLE AS shift, NULL::DOUBLE AS lv, NULL::DOUBLE AS cr FROM judged)"""

# ---- permutation inside blocks, approximated ------------------------------------------------------
_PROBS = [0.25, 0.5, 0.75, 0.2, 0.45, 0.7, 0.3, 0.55, 0.8]


def _quantile(p: float) -> str:
    """Interpolated weighted quantile; the ordinary one where all weights are equal."""
    rank = f"((any_value(n) - 1) * {p}::DOUBLE + 1)"
    inside = lambda r: f"max(v) FILTER (first <= {r} AND last >= {r})"
    low, high = f"floor((n - 1) * {p}::DOUBLE + 1)", f"least(floor((n - 1) * {p}::DOUBLE + 1) + 1, n)"
    share = f"({rank} - floor({rank}))"
    plain = f"{inside(low)} * (1 - {share}) + {inside(high)} * {share}"
    lo, hi = f"arg_max(v, x) FILTER (x <= {p})", f"arg_min(v, x) FILTER (x > {p})"
    xlo, xhi = f"max(x) FILTER (x <= {p})", f"min(x) FILTER (x > {p})"
    return f"CASE WHEN bool_and(equal) THEN {plain} ELSE coalesce({lo} + ({p} - {xlo}) / ({xhi} - {xlo}) * ({hi} - {lo}), {lo}) END"


_NAMES = [f"{k}{i}" for k in "qlu" for i in range(3)]
_STEP = " + ".join(f"CASE WHEN v > q{i} THEN {s} * (u{i} - l{i}) / 0.1 ELSE 0 END" for i, s in enumerate((0.25, 0.5, 0.25)))
BLOCK_SUMS = f"""sb AS (SELECT cell_id, sample_id || '|' || compartment AS blk, "group" AS grp FROM cells),
nb AS (SELECT blk, count(*) AS nb FROM sb GROUP BY 1),
ng AS (SELECT grp, count(*) AS ng FROM sb GROUP BY 1),
tally AS (SELECT blk, grp, count(*) AS c, any_value(nb) AS nb, any_value(ng) AS ng, count(*) / any_value(nb) / any_value(ng) AS w FROM sb JOIN nb USING (blk) JOIN ng USING (grp) GROUP BY 1, 2),
used AS (SELECT lg AS gene FROM slr UNION SELECT rg FROM slr),
dcell AS (SELECT cell_id, blk, gene, v FROM dval JOIN sb USING (cell_id) WHERE gene IN (SELECT gene FROM used)),
equal AS (SELECT grp, max(w) - min(w) <= max(w) * {EPS} AS equal, sum(nb) AS n FROM tally GROUP BY 1),
pv AS (SELECT gene, t.grp, v, sum(w) AS w, count(*) AS cnt FROM dcell JOIN tally t USING (blk) GROUP BY 1, 2, 3),
rk AS (SELECT gene, grp, v, w, cnt, sum(w) OVER o AS mass, sum(cnt) OVER o AS last, sum(cnt) OVER o - cnt + 1 AS first, n, equal FROM pv JOIN equal USING (grp) WINDOW o AS (PARTITION BY gene, grp ORDER BY v)),
xk AS (SELECT *, CASE WHEN last = cnt THEN 0 WHEN last = n THEN 1 ELSE greatest(mass - w, 0) / greatest({EPS}, 1 - w) END AS x FROM rk),
wq AS (SELECT gene, grp, {', '.join(f'{_quantile(p)} AS {a}' for p, a in zip(_PROBS, _NAMES))} FROM xk GROUP BY 1, 2),
jumps AS (SELECT gene, wq.grp, cell_id, blk, {_STEP} AS j FROM dcell JOIN wq USING (gene)),
pb AS (SELECT gene, grp, blk, sum(j) AS sj, sum(j * j) AS sjj FROM jumps GROUP BY 1, 2, 3),
spread AS (SELECT gene, p.grp, sum(sjj - sj * sj / nb.nb) AS resid,
  coalesce(sum(c * (1 - c / nb.nb) * (sjj - sj * sj / nb.nb) / (nb.nb - 1) / (ng.ng * ng.ng)) FILTER (nb.nb > 1 AND c > 0 AND c < nb.nb), 0) AS var
  FROM pb p JOIN nb USING (blk) JOIN ng ON ng.grp = p.grp LEFT JOIN tally t ON t.blk = p.blk AND t.grp = p.grp GROUP BY 1, 2),
center AS (SELECT gene, grp, 0.25 * q0 + 0.5 * q1 + 0.25 * q2 AS center FROM wq),
slrb AS (SELECT lr_index, a.grp AS s, b.grp AS r, a.blk, sum(a.j * b.j) AS slr FROM slr JOIN jumps a ON a.gene = lg JOIN jumps b ON b.gene = rg AND b.cell_id = a.cell_id GROUP BY 1, 2, 3, 4),
moved AS (SELECT x.lr_index, x.s, x.r, x.blk, slr - a.sj * b.sj / nb AS m, nb FROM slrb x JOIN slr l ON l.lr_index = x.lr_index JOIN pb a ON a.gene = lg AND a.grp = x.s AND a.blk = x.blk
  JOIN pb b ON b.gene = rg AND b.grp = x.r AND b.blk = x.blk JOIN nb ON nb.blk = x.blk),
crossed AS (SELECT m.lr_index, m.s, m.r, sum(m.m) AS resid, coalesce(sum(-a.c * b.c / m.nb * m.m / (m.nb - 1) / (a.ng * b.ng)) FILTER (m.nb > 1), 0) AS vx
  FROM moved m LEFT JOIN tally a ON a.blk = m.blk AND a.grp = m.s LEFT JOIN tally b ON b.blk = m.blk AND b.grp = m.r GROUP BY 1, 2, 3),
shared AS (SELECT a.grp AS s, b.grp AS r, count(*) AS shared_blocks FROM tally a JOIN tally b ON a.blk = b.blk WHERE a.nb > 1 GROUP BY 1, 2),
judged AS (SELECT d.lr_index, d.sender_group, d.receiver_group, d.supported_edges, d.probability, coalesce(h.shared_blocks, 0) AS shared_blocks,
  x.resid / sqrt(vl.resid * vr.resid) AS cr, ln(l.t) + ln(r.t) - ln(cl.center) - ln(cc.center) AS shift,
  vl.var / (cl.center * cl.center) + vr.var / (cc.center * cc.center) + 2 * x.vx / (cl.center * cc.center) AS lv,
  CASE WHEN lg IS NULL THEN 'non_simple_lr' WHEN d.sender_group = d.receiver_group THEN 'autocrine_pair' WHEN l.n < 30 OR r.n < 30 THEN 'small_group'
    WHEN coalesce(h.shared_blocks, 0) < 5 THEN 'insufficient_shared_blocks' END AS screen
  FROM dscore d LEFT JOIN slr USING (lr_index) LEFT JOIN shared h ON h.s = d.sender_group AND h.r = d.receiver_group
  LEFT JOIN tri_obs l ON l.grp = d.sender_group AND l.gene = lg LEFT JOIN tri_obs r ON r.grp = d.receiver_group AND r.gene = rg
  LEFT JOIN center cl ON cl.grp = d.sender_group AND cl.gene = lg LEFT JOIN center cc ON cc.grp = d.receiver_group AND cc.gene = rg
  LEFT JOIN spread vl ON vl.grp = d.sender_group AND vl.gene = lg LEFT JOIN spread vr ON vr.grp = d.receiver_group AND vr.gene = rg
  LEFT JOIN crossed x ON x.lr_index = d.lr_index AND x.s = d.sender_group AND x.r = d.receiver_group),
tested AS (SELECT *, coalesce(screen, CASE WHEN cr IS NULL OR isnan(cr) OR abs(cr) > 0.8 THEN 'strong_block_residual_ligand_receptor_dependence'
  WHEN lv <= 1e-12 THEN 'degenerate_delta_variance' END) AS why FROM judged)"""
STRATIFIED = inferred("experimental_stratified_analytic", "shared_blocks,")


def hybrid(replicates: int) -> str:
    """Clear results of the analytic screen keep p = 1; all others are counted over the replicates of ``nscore``."""
    return f"""first_pass AS ({STRATIFIED}),
counted AS (SELECT o.lr_index, o.sender_group, o.receiver_group, count(n.b) FILTER (n.probability >= o.probability - 1e-12 * abs(o.probability)) AS n_reject
  FROM (SELECT * FROM nscore WHERE b = 0) o LEFT JOIN nscore n ON n.b > 0 AND n.lr_index = o.lr_index AND n.sender_group = o.sender_group AND n.receiver_group = o.receiver_group GROUP BY 1, 2, 3),
marked AS (SELECT *, fallback_reason IS NULL AS eligible, coalesce(fallback_reason IS NULL AND pvalue > 0.05 + 0.01, false) AS screened FROM first_pass)
SELECT m.lr_index, m.sender_group, m.receiver_group, interaction_name, supported_edges, probability, CASE WHEN screened THEN 1.0 ELSE {q6(f'(n_reject + 1) / {replicates + 1}')} END AS pvalue,
  analytic_z, analytic_log_sd, influence_correlation, shared_blocks, CASE WHEN screened THEN 'experimental_hybrid_screened_nonsignificant'
  WHEN eligible THEN 'experimental_hybrid_permutation_candidate' ELSE 'experimental_hybrid_permutation_fallback' END AS inference_mode, fallback_reason,
  CASE WHEN NOT screened THEN n_reject END AS n_reject, pvalue AS analytic_pvalue, NOT screened AS permutation_confirmed
  FROM marked m LEFT JOIN counted c ON c.lr_index = m.lr_index AND c.sender_group = m.sender_group AND c.receiver_group = m.receiver_group"""


# ---- stopping rule ------------------------------------------------------------------------------------
def _binomial(k: str, n: str, low: str, high: str) -> str:
    """Probability of ``low`` to ``high`` of ``n`` at chance ``p``."""
    term = f"exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln(p + s) + ({n} - i) * ln(1 - p - s))"
    return f"coalesce(list_sum(list_transform(range({low}, {high} + 1), lambda i: {term})), 0)"


_BITS = ", ".join(f"CAST({2.0 ** -k!r} AS DOUBLE)" for k in range(1, 46))


def _bound(test: str) -> str:
    return f"list_reduce([CAST(0 AS DOUBLE), {_BITS}], lambda p, s: CASE WHEN p + s < 1 AND {test} THEN p + s ELSE p END)"


def adaptive(checks: tuple[int, ...], level: float, alpha: float = 0.05) -> str:
    """Every record at every check with its exact interval; the first check that decides is kept."""
    half = (1 - level) / 2
    lower = f"CASE WHEN k = 0 THEN 0 ELSE {_bound(_binomial('k', 'n', 'k', 'n') + f' <= {half!r}')} END"
    upper = f"CASE WHEN k = n THEN 1 ELSE {_bound(_binomial('k', 'n', '0', 'k') + f' > {half!r}')} END"
    return f"""checks AS (SELECT unnest([{', '.join(map(str, checks))}]) AS n),
hits AS (SELECT o.lr_index, o.sender_group, o.receiver_group, o.probability, c.n, count(x.b) FILTER (x.b <= c.n AND x.probability >= o.probability - 1e-12 * abs(o.probability)) AS k
  FROM (SELECT * FROM nscore WHERE b = 0) o CROSS JOIN checks c LEFT JOIN nscore x ON x.b > 0 AND x.lr_index = o.lr_index AND x.sender_group = o.sender_group AND x.receiver_group = o.receiver_group GROUP BY 1, 2, 3, 4, 5),
seen AS (SELECT k, n, ({lower} * n + 1) / (n + 1) AS lo, ({upper} * n + 1) / (n + 1) AS hi FROM (SELECT DISTINCT k, n FROM hits)),
decided AS (SELECT h.*, lo, hi, CASE WHEN hi <= {alpha} THEN 'pvalue_upper_at_or_below_alpha' WHEN lo > {alpha} THEN 'pvalue_lower_above_alpha' WHEN n = {checks[-1]} THEN 'max_permutations' END AS why
  FROM hits h JOIN seen USING (k, n)),
stopped AS (SELECT *, row_number() OVER (PARTITION BY lr_index, sender_group, receiver_group ORDER BY n) AS turn FROM decided WHERE why IS NOT NULL)
SELECT lr_index, sender_group, receiver_group, {q6('probability')} AS probability, k AS n_reject, CAST(n AS INTEGER) AS permutations_used, {q6('lo')} AS pvalue_lower, {q6('hi')} AS pvalue_upper,
  why AS stop_reason, {q6('(k + 1) / (n + 1)')} AS pvalue, CASE WHEN hi <= {alpha} THEN 'significant' ELSE 'not_significant' END AS decision FROM stopped WHERE turn = 1"""
