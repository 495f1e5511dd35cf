"""Permutation tests on the derived cells."""
from __future__ import annotations

from pyspark.sql import functions as F

from cellwire.operators import expression as ex
from cellwire.operators import graph
from cellwire.operators import permutation as pm
from cellwire.queries import domain as d
from cellwire.queries import scoring_queries as sq
from cellwire.queries import testing_checks as tk
from cellwire.queries.registry import q6, query, r6, with_

B, SEED, BLOCK = 20, 1, 12.0

# ---- global label permutation -----------------------------------------------------------------


def _xxhash(*values: str) -> str:
    """The signed 64-bit hash of long columns, by its published definition, in unsigned 128-bit arithmetic."""
    big = "CAST({} AS UHUGEINT)".format
    p1, p2, p3, p4, p5 = (big(f"'{p}'") for p in (
        11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
    word = big("'18446744073709551616'")

    def turned(x: str, r: int) -> str:
        return f"list_transform([{x}], lambda v: (v * {big(2 ** r)}) % {word} + v // {big(2 ** (64 - r))})[1]"

    def mixed(x: str, shift: int, factor: str) -> str:
        return f"list_transform([{x}], lambda v: (xor(v, v // {big(2 ** shift)}) * {factor}) % {word})[1]"

    seed = big(42)
    for value in values:
        unsigned = f"{big(f'(CAST({value} AS HUGEINT) + 18446744073709551616) % 18446744073709551616')}"
        part = f"({turned(f'({unsigned} * {p2}) % {word}', 31)} * {p1}) % {word}"
        start = f"xor(({seed} + {p5} + {big(8)}) % {word}, {part})"
        seed = f"({turned(start, 27)} * {p1} + {p4}) % {word}"
        seed = mixed(mixed(mixed(seed, 33, p2), 29, p3), 32, big(1))
    return f"list_transform([{seed}], lambda v: CAST(v AS HUGEINT) - CASE WHEN v >= {big(2 ** 63)} THEN 18446744073709551616 ELSE 0 END)[1]"


def moved_sql(strata: str, source: str, last: int) -> str:
    """``drawn(st, b, cell_id, k)``: the position from 1 that replicate b gives each cell of its stratum, and ``sized`` before it.

    Strata of at most 64 cells are ordered by hash; larger ones walk through a network of six rounds, one per step.
    """
    drawn = "(key * 4294967296 + b * 64)"
    turn = "CASE WHEN i = 6 THEN 1 ELSE i + 1 END"
    text = " || '|' || ".join(f"length({c}) || ':' || {c}" for c in strata.split(", "))
    return f"""sized AS (SELECT {strata} AS st, sample_id, cell_id, row_number() OVER (PARTITION BY {strata} ORDER BY md5('{SEED}|' || sample_id || '|' || cell_id), sample_id, cell_id) - 1 AS k FROM {source}),
shapes AS (SELECT st, size, key, unnest(range(w0, w0 + least(63, w0 // 4) + 1)) AS wide FROM (
  SELECT {strata} AS st, count(*) AS size, CAST(ceil(sqrt(count(*))) AS BIGINT) AS w0,
    CAST('0x' || substr(md5('{SEED}|' || {text}), 1, 7) AS BIGINT) AS key FROM {source} GROUP BY {strata})),
shape AS (SELECT st, size, key, arg_min(wide, (wide * ((size + wide - 1) // wide), wide)) AS wide FROM shapes GROUP BY 1, 2, 3),
spots AS (SELECT z.st, cell_id, k, b, key, size, wide, (size + wide - 1) // wide AS high FROM sized z JOIN shape USING (st), range(1, {last + 1}) AS t(b)),
placed AS (SELECT st, b, cell_id, row_number() OVER (PARTITION BY st, b ORDER BY {_xxhash(drawn, 'k')}, k) AS k FROM spots WHERE size <= 64),
walk AS (SELECT st, b, cell_id, key, size, high, k // high AS x, k % high AS y, wide AS m, high AS n, 0 AS i FROM spots WHERE size > 64
  UNION ALL SELECT st, b, cell_id, key, size, high, y, CAST((x + ({_xxhash(f'{drawn} + {turn}', 'y')} % m + m) % m) % m AS BIGINT), n, m, {turn}
  FROM walk WHERE i < 6 OR x * high + y >= size),
drawn AS (SELECT * FROM placed UNION ALL SELECT st, b, cell_id, x * high + y + 1 FROM walk WHERE i = 6 AND x * high + y < size)"""


def drawn_sql(strata: str, source: str = "cells", last: int = B) -> str:
    """Permuted labels: replicate b moves every cell's position and takes the label that owns the new one."""
    return f"""slots AS (SELECT {strata} AS st, "group" AS g, row_number() OVER (PARTITION BY {strata} ORDER BY "group", cell_id) AS k FROM {source}),
{moved_sql(strata, source, last)},
labels AS (SELECT d.b, d.cell_id, s.g FROM drawn d JOIN slots s ON s.st = d.st AND s.k = d.k
  UNION ALL SELECT 0, cell_id, "group" FROM {source})"""


NULLS = """nsums AS (SELECT t.sample_id, t.lr_index, a.b, a.g AS sender_group, c.g AS receiver_group, avg(p) AS probability, count(*) AS active_edges
  FROM terms t JOIN labels a ON a.cell_id = t.s JOIN labels c ON c.cell_id = t.r AND c.b = a.b GROUP BY 1, 2, 3, 4, 5),
nlinked AS (SELECT *, sum(active_edges) OVER (PARTITION BY sample_id, lr_index, b, sender_group) AS o,
  sum(active_edges) OVER (PARTITION BY sample_id, lr_index, b, receiver_group) AS i FROM nsums),
nsize AS (SELECT sample_id, "group" AS g, count(*) AS n FROM cells GROUP BY 1, 2),
nshares AS (SELECT v.sample_id, v.lr_index, a.b, a.g, count(*) FILTER (v.l > 0) / any_value(n) AS fl, count(*) FILTER (v.r > 0) / any_value(n) AS fr
  FROM lev v JOIN labels a ON a.cell_id = v.cell_id JOIN nsize z ON z.sample_id = v.sample_id AND z.g = a.g GROUP BY 1, 2, 3, 4),
nrec AS (SELECT k.* FROM nlinked k JOIN nshares a ON a.sample_id = k.sample_id AND a.lr_index = k.lr_index AND a.b = k.b AND a.g = k.sender_group
  JOIN nshares c ON c.sample_id = k.sample_id AND c.lr_index = k.lr_index AND c.b = k.b AND c.g = k.receiver_group
  WHERE o >= 5 AND i >= 5 AND a.fl >= 0.1 AND c.fr >= 0.1)"""


@query("n1_label_permutation", with_(*sq.edge_mean_sql(), drawn_sql("sample_id"), NULLS) + f"""SELECT o.sample_id, o.lr_index, l.interaction_name, l.ligand, l.receptor,
  o.sender_group, o.receiver_group, {q6('o.probability')} AS probability, o.active_edges,
  {q6(f'(SELECT count(*) FROM nrec n WHERE n.b > 0 AND n.sample_id = o.sample_id AND n.lr_index = o.lr_index AND n.sender_group = o.sender_group AND n.receiver_group = o.receiver_group AND n.probability > o.probability + 1e-12 * abs(o.probability)) / {B}')} AS pvalue
  FROM nrec o JOIN lr l ON l.lr_index = o.lr_index WHERE o.b = 0""")
def n1(spark, folder):
    return r6(sq.records(spark, folder, n_perm=B, seed=SEED), "probability", "pvalue")


# ---- permutation inside spatial blocks --------------------------------------------------------
BLOCKS = f"""origin AS (SELECT floor(min(x) / {BLOCK}) * {BLOCK} AS ox, floor(min(y) / {BLOCK}) * {BLOCK} AS oy FROM cells),
blocks AS (SELECT cells.*, length(sample_id) || ':' || sample_id || '|' || length(compartment) || ':' || compartment || '|' || CAST(CAST(floor((x - ox) / {BLOCK}) AS BIGINT) AS VARCHAR) || '|' ||
  CAST(CAST(floor((y - oy) / {BLOCK}) AS BIGINT) AS VARCHAR) AS block_id FROM cells, origin)"""
BLOCK_LABELS = drawn_sql("block_id", "blocks")
NULL_SCORES = f"""sizes AS (SELECT "group" AS g, count(*) AS n FROM cells GROUP BY 1),
held AS (SELECT a.b, a.g, s.gene, list_sort(list(s.value)) AS v, any_value(z.n) AS n FROM scaled s JOIN labels a ON a.cell_id = s.cell_id
  JOIN sizes z ON z.g = a.g WHERE s.gene IN (SELECT gene FROM mem) GROUP BY 1, 2, 3),
padded AS (SELECT b, g, gene, list_concat(list_transform(range(0, n - len(v)), lambda x: 0.0::DOUBLE), v) AS v FROM held),
ntri AS (SELECT b, g, gene, (list_aggregate(v, 'quantile_cont', 0.25) + 2 * list_aggregate(v, 'quantile_cont', 0.5) + list_aggregate(v, 'quantile_cont', 0.75)) / 4 AS value FROM padded),
npos AS (SELECT b, g AS grp, gene, value FROM ntri WHERE value > 0),
nlev AS ({sq.levels_sql('npos', 'b, grp')}),
nscore AS (SELECT a.b, s.sender_group, s.receiver_group, a.lr_index, a.l * c.r / (0.5 + a.l * c.r) * a.m * c.m AS probability FROM support s
  JOIN nlev a ON a.grp = s.sender_group JOIN nlev c ON c.grp = s.receiver_group AND c.b = a.b AND c.lr_index = a.lr_index WHERE a.l > 0 AND c.r > 0)"""
NULL_PATH = (*sq.BASE, d.LR, d.MEMBERS, BLOCKS, sq.EDGES, sq.SUPPORT, BLOCK_LABELS, NULL_SCORES)


def blocks(spark, folder):
    return graph.spatial_blocks(d.cells(spark, folder), BLOCK)


@query("n3_block_permutation", with_(d.CELLS, BLOCKS, moved_sql("block_id", "blocks", 1)) + """SELECT t.st AS block_id, t.cell_id, s.cell_id AS source_id
  FROM drawn t JOIN sized s ON t.st = s.st AND t.k = s.k + 1""")
def n3(spark, folder):
    return pm.permute_within_blocks(blocks(spark, folder), SEED)


@query("n6_exchangeability", with_(d.CELLS, BLOCKS, BLOCK_LABELS, """per AS (SELECT block_id, count(*) AS n, count(DISTINCT "group") AS g FROM blocks GROUP BY 1)""") + f"""
  SELECT count(*) AS block_count, count(*) FILTER (g > 1) AS mixed_blocks, {q6('sum(n) FILTER (g > 1) / sum(n)')} AS exchangeable_fraction,
  {q6('(SELECT avg(CASE WHEN l.g <> c."group" THEN 1.0 ELSE 0.0 END) FROM labels l JOIN cells c ON c.cell_id = l.cell_id WHERE l.b > 0)')} AS moved_fraction FROM per""")
def n6(spark, folder):
    b = blocks(spark, folder)
    return r6(pm.exchangeability(b, pm.permuted_labels(b, ["block_id"], B, SEED)), "exchangeable_fraction", "moved_fraction")


@query("a7_permuted_trimean", with_(*NULL_PATH) + f'SELECT CAST(b AS INTEGER) AS b, grp AS "group", gene, {q6("value")} AS trimean FROM npos')
def a7(spark, folder):
    b = pm.permuted_labels(blocks(spark, folder), ["block_id"], B, SEED)
    members = d.interactions(spark, folder).members
    return r6(pm.null_trimeans(d.expression(spark, folder), b, members).withColumnRenamed("value", "trimean"), "trimean")


def block_test(spark, folder, **options):
    return pm.block_permutation_test(
        d.expression(spark, folder), blocks(spark, folder), sq.support(spark, folder),
        d.interactions(spark, folder), n_perm=B, seed=SEED, **options)


def _test_sql(compare, p, base="(SELECT * FROM nscore WHERE b = 0)", extra=""):
    return f"""SELECT o.lr_index, o.sender_group, o.receiver_group, {q6('o.probability')} AS probability,
  count(n.b) FILTER (n.probability {compare} o.probability {'+' if compare == '>' else '-'} 1e-12 * abs(o.probability)) AS n_reject, {q6(p)} AS pvalue{extra}
  FROM {base} o LEFT JOIN nscore n ON n.b > 0 AND n.lr_index = o.lr_index AND n.sender_group = o.sender_group AND n.receiver_group = o.receiver_group
  GROUP BY 1, 2, 3, o.probability"""


_STRICT = "count(n.b) FILTER (n.probability > o.probability + 1e-12 * abs(o.probability))"
_EQUAL = "count(n.b) FILTER (n.probability >= o.probability - 1e-12 * abs(o.probability))"


@query("n4_block_permutation_test", with_(*NULL_PATH) + _test_sql(">", f"{_STRICT} / {B}"))
def n4(spark, folder):
    return r6(block_test(spark, folder), "probability", "pvalue")


@query("n4_plus_one_tail", with_(*NULL_PATH) + _test_sql(">=", f"({_EQUAL} + 1) / {B + 1}"))
def n4_plus(spark, folder):
    return r6(block_test(spark, folder, tail="greater_equal", finite_correction=True), "probability", "pvalue")


@query("n5_null_moments", with_(*NULL_PATH) + _test_sql(">", f"{_STRICT} / {B}", extra=f""",
  {q6(f'coalesce(sum(n.probability), 0) / {B}')} AS null_mean,
  {q6(f'greatest(0, coalesce(sum(n.probability * n.probability), 0) / {B} - (coalesce(sum(n.probability), 0) / {B}) * (coalesce(sum(n.probability), 0) / {B}))')} AS null_variance"""))
def n5(spark, folder):
    return r6(block_test(spark, folder, moments=True), "probability", "pvalue", "null_mean", "null_variance")


@query("n7_record_permutation", with_(*NULL_PATH, sq.WANTED) + _test_sql(
    ">", f"CASE WHEN o.probability = 0 THEN 1.0 ELSE {_STRICT} / {B} END",
    base="""(SELECT w.*, coalesce(s.probability, 0) AS probability FROM wanted w LEFT JOIN nscore s ON s.b = 0 AND s.lr_index = w.lr_index
    AND s.sender_group = w.sender_group AND s.receiver_group = w.receiver_group)"""))
def n7(spark, folder):
    return r6(block_test(spark, folder, records=sq.wanted_records(spark, folder)), "probability", "pvalue")


# ---- analytic and mixed tests -----------------------------------------------------------------
# Dense expression (all values positive), one stratum or one per sample and compartment.
DENSE_EXPR = """dexpr AS (SELECT cell_id, sample_id, "group" AS grp, 'g' || lpad(CAST(i AS VARCHAR), 2, '0') AS gene, 1.0 + CAST(e.embedding[i + 1] AS DOUBLE) AS v
  FROM cells JOIN embeddings e USING (vec_id), range(2, 64) AS t(i)), dval AS (SELECT cell_id, sample_id, grp, gene, v / (SELECT max(v) FROM dexpr) AS v FROM dexpr)"""


def dense_expression(spark, folder):
    e = d.table(spark, folder, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).where("i >= 2")
    return e.select(
        F.concat(F.lit("S"), (F.col("vec_id") % 4).cast("string")).alias("sample_id"), F.concat(F.lit("c"), F.col("vec_id").cast("string")).alias("cell_id"),
        F.concat(F.lit("g"), F.lpad(F.col("i").cast("string"), 2, "0")).alias("gene"), (F.col("v").cast("double") + 1.0).alias("value"))


def strata(spark, folder):
    return d.cells(spark, folder).withColumn("block_id", F.concat_ws("|", "sample_id", "compartment"))


SIMPLE_LR = "slr AS (SELECT * FROM (VALUES (1, 'g02', 'g03'), (2, 'g04', 'g05'), (5, 'g12', 'g13'), (8, 'g23', 'g26'), (11, 'g30', 'g31'), (14, 'g35', 'g36')) AS t(lr_index, lg, rg))"
ANALYTIC = """gq AS (SELECT gene, quantile_cont(v, 0.25) AS q0, quantile_cont(v, 0.5) AS q1, quantile_cont(v, 0.75) AS q2, quantile_cont(v, 0.30) - quantile_cont(v, 0.20) AS s0,
  quantile_cont(v, 0.55) - quantile_cont(v, 0.45) AS s1, quantile_cont(v, 0.80) - quantile_cont(v, 0.70) AS s2, count(*) AS nn FROM dval GROUP BY 1),
inf AS (SELECT cell_id, gene, 0.25 * (0.25 - CASE WHEN v <= q0 THEN 1 ELSE 0 END) * s0 / 0.1 + 0.5 * (0.5 - CASE WHEN v <= q1 THEN 1 ELSE 0 END) * s1 / 0.1
  + 0.25 * (0.75 - CASE WHEN v <= q2 THEN 1 ELSE 0 END) * s2 / 0.1 AS f, 0.25 * q0 + 0.5 * q1 + 0.25 * q2 AS center, nn FROM dval JOIN gq USING (gene)),
pair AS (SELECT lr_index, var_samp(a.f) AS va, var_samp(b.f) AS vb, covar_samp(a.f, b.f) AS cv, corr(a.f, b.f) AS cr, any_value(a.center) AS ca, any_value(b.center) AS cb, any_value(a.nn) AS nn
  FROM slr JOIN inf a ON a.gene = lg JOIN inf b ON b.gene = rg AND b.cell_id = a.cell_id GROUP BY 1)"""


ANALYTIC_COLUMNS = ["probability", "pvalue", "analytic_z", "analytic_log_sd", "influence_correlation"]
DENSE_PATH = (d.CELLS, DENSE_EXPR, sq.EDGES, sq.SUPPORT, d.LR, d.MEMBERS, SIMPLE_LR)


@query("n9_analytic", with_(*DENSE_PATH, *tk.DENSE_SCORES, ANALYTIC, tk.ALL_PAIRS) + tk.inferred("experimental_analytic"))
def n9(spark, folder):
    from cellwire.operators.analytic import analytic_test
    one = d.cells(spark, folder).withColumn("block_id", F.lit("all"))
    out = analytic_test(dense_expression(spark, folder), one, sq.support(spark, folder), d.interactions(spark, folder))
    return r6(out, *ANALYTIC_COLUMNS)


@query("n9_analytic_reasons", with_(*sq.GROUP_PATH, SIMPLE_LR, tk.SPARSE) + tk.inferred("experimental_analytic"))
def n9_reasons(spark, folder):
    from cellwire.operators.analytic import analytic_test
    out = analytic_test(d.expression(spark, folder), d.cells(spark, folder).withColumn("block_id", F.lit("all")),
                        sq.support(spark, folder), d.interactions(spark, folder))
    return r6(out, *ANALYTIC_COLUMNS)


@query("n10_stratified_analytic", with_(*DENSE_PATH, *tk.DENSE_SCORES, tk.BLOCK_SUMS) + tk.STRATIFIED)
def n10(spark, folder):
    from cellwire.operators.analytic import stratified_analytic_test
    out = stratified_analytic_test(dense_expression(spark, folder), strata(spark, folder), sq.support(spark, folder), d.interactions(spark, folder))
    return r6(out, *ANALYTIC_COLUMNS)


@query("n11_weighted_quantile", f"""WITH m AS (SELECT l_suppkey, l_discount AS v, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2),
  c AS (SELECT *, sum(w) OVER (PARTITION BY l_suppkey) AS t, sum(w) OVER (PARTITION BY l_suppkey ORDER BY v) AS m FROM m),
  x AS (SELECT l_suppkey, v, ((m - w) / t) / (1 - w / t) AS x FROM c),
  n AS (SELECT *, lead(x) OVER (PARTITION BY l_suppkey ORDER BY v) AS nx, lead(v) OVER (PARTITION BY l_suppkey ORDER BY v) AS nv FROM x)
  SELECT l_suppkey, {q6('max(v + (0.25 - x) / (nx - x) * (nv - v)) FILTER (x <= 0.25 AND nx > 0.25)')} AS q25, {q6('max(v + (0.5 - x) / (nx - x) * (nv - v)) FILTER (x <= 0.5 AND nx > 0.5)')} AS q50,
  {q6('max(v + (0.75 - x) / (nx - x) * (nv - v)) FILTER (x <= 0.75 AND nx > 0.75)')} AS q75 FROM n GROUP BY 1""")
def n11(spark, folder):
    from cellwire.operators.analytic import weighted_quantiles
    return r6(weighted_quantiles(d.table(spark, folder, "lineitem"), ["l_suppkey"], "l_discount", "l_quantity", [0.25, 0.5, 0.75], ["q25", "q50", "q75"]), "q25", "q50", "q75")


STRATA = """scaled AS (SELECT cell_id, gene, v AS value FROM dval),
blocks AS (SELECT cells.*, sample_id || '|' || compartment AS block_id FROM cells)"""


@query("n12_hybrid", with_(*DENSE_PATH, *tk.DENSE_SCORES, tk.BLOCK_SUMS, STRATA, BLOCK_LABELS, NULL_SCORES, tk.hybrid(B)))
def n12(spark, folder):
    from cellwire.operators.analytic import hybrid_test
    out = hybrid_test(dense_expression(spark, folder), strata(spark, folder), sq.support(spark, folder), d.interactions(spark, folder), n_perm=B)
    return r6(out, *ANALYTIC_COLUMNS, "analytic_pvalue")


@query("n8_adaptive_permutation", with_(*sq.BASE, d.LR, d.MEMBERS, BLOCKS, sq.EDGES, sq.SUPPORT, drawn_sql("block_id", "blocks", 60), NULL_SCORES, tk.adaptive((20, 40, 60), 1 - 0.01 / 4)))
def n8(spark, folder):
    from cellwire.operators.analytic import adaptive_test
    out = adaptive_test(d.expression(spark, folder), blocks(spark, folder), sq.support(spark, folder), d.interactions(spark, folder),
                        min_permutations=20, batch_size=20, max_permutations=60)
    return r6(out, "probability", "pvalue", "pvalue_lower", "pvalue_upper")
