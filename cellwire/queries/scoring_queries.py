"""Interaction tables, expression summaries and scores on the derived cells."""
from __future__ import annotations

from pyspark.sql import functions as F

from cellwire.operators import expression as ex
from cellwire.operators import graph
from cellwire.operators import interactions as ia
from cellwire.operators import scoring
from cellwire.plans import communication as comm
from cellwire.queries import domain as d
from cellwire.queries.graph_queries import EDGES, RADIUS
from cellwire.queries.registry import q6, query, r6, with_

SETTINGS = dict(ratio=1.0, tol=0.0, interaction_range=5.0, scale_distance=1.0, contact_range=3.0,
                min_percent=0.1, min_cells=5)

# ---- interaction tables -----------------------------------------------------------------------
ROLES = """parts AS (SELECT lr_index, role, component FROM (
  SELECT lr_index, 'ligand' AS role, ligand AS component FROM lr UNION ALL SELECT lr_index, 'receptor', receptor FROM lr
  UNION ALL SELECT lr_index, 'co_A_receptor', co_A_receptor FROM lr UNION ALL SELECT lr_index, 'co_I_receptor', co_I_receptor FROM lr
  UNION ALL SELECT lr_index, 'agonist', agonist FROM lr UNION ALL SELECT lr_index, 'antagonist', antagonist FROM lr) WHERE component <> ''),
resolved AS (SELECT p.lr_index, p.role, p.component,
  CASE WHEN p.role IN ('ligand', 'receptor') AND p.component IN (SELECT gene FROM genes) THEN p.component
       WHEN p.role IN ('ligand', 'receptor') THEN coalesce(c.member, p.component) ELSE coalesce(f.member, p.component) END AS member,
  p.role IN ('ligand', 'receptor') AND p.component IN (SELECT gene FROM genes) AS direct
  FROM parts p LEFT JOIN complexes c ON p.role IN ('ligand', 'receptor') AND p.component NOT IN (SELECT gene FROM genes) AND c.name = p.component
  LEFT JOIN cofactors f ON p.role NOT IN ('ligand', 'receptor') AND f.name = p.component),
members AS (SELECT *, member IN (SELECT gene FROM genes) AS measured FROM resolved WHERE member <> '')"""
AUDIT = """audit AS (SELECT l.lr_index, l.interaction_name, l.ligand, l.receptor,
  coalesce(string_agg(m.member, ';' ORDER BY m.member) FILTER (m.role = 'ligand'), '') AS ligand_genes,
  coalesce(string_agg(m.member, ';' ORDER BY m.member) FILTER (m.role = 'receptor'), '') AS receptor_genes,
  coalesce(string_agg(m.member, ';' ORDER BY m.member) FILTER (m.role = 'ligand' AND NOT measured), '') AS missing_ligand_genes,
  coalesce(string_agg(m.member, ';' ORDER BY m.member) FILTER (m.role = 'receptor' AND NOT measured), '') AS missing_receptor_genes
  FROM lr l LEFT JOIN members m ON l.lr_index = m.lr_index GROUP BY 1, 2, 3, 4),
reasons AS (SELECT *, concat_ws(';', CASE WHEN ligand_genes = '' THEN 'unresolved_ligand_definition' END,
  CASE WHEN receptor_genes = '' THEN 'unresolved_receptor_definition' END,
  CASE WHEN missing_ligand_genes <> '' THEN 'missing_ligand_genes' END,
  CASE WHEN missing_receptor_genes <> '' THEN 'missing_receptor_genes' END) AS why FROM audit)"""
TABLES = (d.EXPR, d.GENES, d.LR, d.COMPLEXES, d.COFACTORS, ROLES)


@query("j6_component_resolution", with_(*TABLES) + "SELECT lr_index, role, component, member, direct, measured FROM members")
def j6(spark, folder):
    lr, complexes, cofactors = d.dictionaries(spark)
    return ia.component_members(lr, d.genes(spark, folder), complexes, cofactors)


@query("j7_coverage_filter", with_(*TABLES, AUDIT) + """SELECT lr_index, interaction_name, ligand, receptor, ligand_genes, receptor_genes,
  missing_ligand_genes, missing_receptor_genes, why = '' AS valid, CASE WHEN why = '' THEN 'complete' ELSE why END AS reason FROM reasons""")
def j7(spark, folder):
    lr, complexes, cofactors = d.dictionaries(spark)
    return ia.coverage_audit(lr, d.genes(spark, folder), complexes, cofactors)


@query("j7_missing_genes", with_(*TABLES) + """SELECT m.lr_index, interaction_name, role, component, member AS gene,
  role IN ('ligand', 'receptor') AS required FROM members m JOIN lr USING (lr_index) WHERE NOT measured""")
def j7_missing(spark, folder):
    lr, complexes, cofactors = d.dictionaries(spark)
    return ia.missing_genes(lr, d.genes(spark, folder), complexes, cofactors)


@query("p20_annotation_order", with_(d.EXPR, d.LR) + """SELECT CAST(row_number() OVER (ORDER BY CASE annotation WHEN 'Secreted Signaling' THEN 1
  WHEN 'ECM-Receptor' THEN 2 WHEN 'Non-protein Signaling' THEN 3 WHEN 'Cell-Cell Contact' THEN 4 ELSE 5 END, lr_index) AS INTEGER) AS lr_index,
  lr_index AS input_index, interaction_name, annotation, coalesce(n, 0) AS ligand_cells
  FROM lr LEFT JOIN (SELECT gene, count(*) AS n FROM expr GROUP BY 1) ON gene = ligand""")
def p20(spark, folder):
    support = d.expression(spark, folder).groupBy(F.col("gene").alias("ligand")).agg(F.count("*").alias("n"))
    ordered = ia.order_interactions(d.lr(spark)).join(support, "ligand", "left")
    return ordered.select("lr_index", "input_index", "interaction_name", "annotation",
                          F.coalesce("n", F.lit(0)).alias("ligand_cells"))


# ---- expression -------------------------------------------------------------------------------
SCALED = "scaled AS (SELECT sample_id, cell_id, gene, value / (SELECT max(value) FROM expr) AS value FROM expr)"
TRIMEAN = """grid AS (SELECT c.cell_id, c.sample_id, c."group" AS grp, g.gene, coalesce(s.value, 0) AS value FROM cells c CROSS JOIN genes g
  LEFT JOIN scaled s ON s.cell_id = c.cell_id AND s.gene = g.gene),
tri AS (SELECT grp, gene, (quantile_cont(value, 0.25) + 2 * quantile_cont(value, 0.5) + quantile_cont(value, 0.75)) / 4 AS value
  FROM grid GROUP BY 1, 2)"""
BASE = (d.CELLS, d.EXPR, d.GENES, SCALED)


@query("p1_max_normalise", with_(d.EXPR, SCALED) + f"SELECT sample_id, cell_id, gene, {q6('value')} AS value FROM scaled")
def p1(spark, folder):
    return r6(ex.scale_by_maximum(d.expression(spark, folder)), "value")


@query("a5_sparse_trimean", with_(*BASE, TRIMEAN) + f'SELECT grp AS "group", gene, {q6("value")} AS trimean FROM tri WHERE value > 0')
def a5(spark, folder):
    scaled = ex.scale_by_maximum(d.expression(spark, folder))
    out = ex.trimean_by_group(scaled, d.cells(spark, folder)).withColumnRenamed("value", "trimean")
    return r6(out, "trimean")


@query("a6_prepared_trimean", with_(*BASE, d.MEMBERS, TRIMEAN) + f"""SELECT grp AS "group", gene, {q6("value")} AS trimean FROM tri
  WHERE value > 0 AND gene IN (SELECT gene FROM mem)""")
def a6(spark, folder):
    inter = d.interactions(spark, folder)
    scaled = ex.scale_by_maximum(d.expression(spark, folder)).join(inter.members.select("gene").distinct(), "gene", "left_semi")
    out = ex.trimean_by_group(scaled, d.cells(spark, folder)).withColumnRenamed("value", "trimean")
    return r6(out, "trimean")


def levels_sql(source: str, keys: str, kh: float = 0.5) -> str:
    """Ligand, receptor and modulator levels from ``source(keys, gene, value)``."""
    def level(role):
        return (f"CASE WHEN count(*) FILTER (role = '{role}') = max(required) FILTER (role = '{role}') THEN "
                f"CASE WHEN bool_or(direct) FILTER (role = '{role}') THEN max(value) FILTER (role = '{role}') ELSE "
                f"exp(sum(ln(value)) FILTER (role = '{role}') / max(required) FILTER (role = '{role}')) END END")

    def prod(role, factor):
        return f"coalesce(product({factor}) FILTER (role = '{role}'), 1.0)"

    return f"""SELECT {keys}, lr_index, {level('ligand')} AS l,
  {level('receptor')} * {prod('co_A_receptor', '1 + value')} / {prod('co_I_receptor', '1 + value')} AS r,
  {prod('agonist', f'1 + value / ({kh} + value)')} * {prod('antagonist', f'{kh} / ({kh} + value)')} AS m
  FROM {source} JOIN mem USING (gene) GROUP BY {keys}, lr_index"""


SAMPLE_SCALED = """sscaled AS (SELECT e.sample_id, e.cell_id, e.gene, e.value / m.top AS value FROM expr e
  JOIN (SELECT sample_id, max(value) AS top FROM expr GROUP BY 1) m USING (sample_id))"""
LEVELS = "lev AS (" + levels_sql("sscaled", "sample_id, cell_id") + ")"
GROUP_VALUES = "gval AS (SELECT grp, gene, value FROM tri WHERE value > 0)"
GROUP_LEVELS = "glev AS (" + levels_sql("gval", "grp") + ")"
SUPPORT = """support AS (SELECT sender_group, receiver_group, count(*) AS supported_edges, sum(weight) AS sum_spatial_weight,
  avg(weight) AS mean_spatial_weight FROM edges GROUP BY 1, 2)"""
GROUP_SCORES = """gscore AS (SELECT s.*, a.lr_index, a.l * b.r / (0.5 + a.l * b.r) * a.m * b.m AS probability
  FROM support s JOIN glev a ON a.grp = s.sender_group JOIN glev b ON b.grp = s.receiver_group AND a.lr_index = b.lr_index
  WHERE a.l > 0 AND b.r > 0)"""
GROUP_PATH = (*BASE, d.LR, d.MEMBERS, TRIMEAN, GROUP_VALUES, GROUP_LEVELS, EDGES, SUPPORT, GROUP_SCORES)


@query("a8_a9_molecule_levels", with_(*BASE, d.MEMBERS, SAMPLE_SCALED, LEVELS) + f"""SELECT sample_id, cell_id, lr_index,
  {q6('l')} AS ligand_level, {q6('r')} AS receptor_level, {q6('m')} AS modulator FROM lev WHERE l > 0 OR r > 0""")
def a8(spark, folder):
    scaled = ex.scale_by_maximum(d.expression(spark, folder), ["sample_id"])
    levels = ex.molecule_levels(scaled, d.interactions(spark, folder).members, ["sample_id", "cell_id"])
    return r6(levels, "ligand_level", "receptor_level", "modulator")


def support(spark, folder):
    return scoring.group_support(d.cells(spark, folder), RADIUS, weight="gaussian", scale=2.5)


def group_scores(spark, folder):
    scaled = ex.scale_by_maximum(d.expression(spark, folder))
    inter = d.interactions(spark, folder)
    needed = scaled.join(inter.members.select("gene").distinct(), "gene", "left_semi")
    values = ex.trimean_by_group(needed, d.cells(spark, folder))
    return scoring.score_groups(values, support(spark, folder), inter)


@query("a10_group_score", with_(*GROUP_PATH) + f"""SELECT lr_index, interaction_name, lr.ligand, lr.receptor, sender_group, receiver_group, supported_edges,
  {q6('sum_spatial_weight')} AS sum_spatial_weight, {q6('mean_spatial_weight')} AS mean_spatial_weight, {q6('probability')} AS probability,
  {q6('probability * mean_spatial_weight')} AS mean_weighted_probability, {q6('probability * sum_spatial_weight')} AS sum_weighted_probability
  FROM gscore JOIN lr USING (lr_index)""")
def a10(spark, folder):
    return r6(group_scores(spark, folder), "sum_spatial_weight", "mean_spatial_weight", "probability",
              "mean_weighted_probability", "sum_weighted_probability")


@query("a11_score_matrix", with_(*GROUP_PATH) + f"""SELECT i.lr_index, s.sender_group, s.receiver_group, {q6('coalesce(g.probability, 0)')} AS probability
  FROM support s CROSS JOIN (SELECT DISTINCT lr_index FROM mem) i LEFT JOIN gscore g ON g.lr_index = i.lr_index
  AND g.sender_group = s.sender_group AND g.receiver_group = s.receiver_group""")
def a11(spark, folder):
    matrix = scoring.score_matrix(group_scores(spark, folder), support(spark, folder), d.interactions(spark, folder))
    return r6(matrix, "probability")


def wanted_records(spark, folder):
    """Between-group records of the single-gene interactions."""
    inter = d.interactions(spark, folder).lr.where("simple").select("lr_index")
    pairs = support(spark, folder).where("sender_group <> receiver_group").withColumn(
        "pair", F.concat_ws(">", "sender_group", "receiver_group"))
    from cellwire.operators.ranking import complete_grid
    return complete_grid(pairs, inter, "pair", "lr_index").join(
        pairs.select("pair", "sender_group", "receiver_group"), "pair").drop("pair")


WANTED = """wanted AS (SELECT i.lr_index, s.sender_group, s.receiver_group FROM support s
  CROSS JOIN (VALUES (1), (2), (5), (8), (11), (14)) AS i(lr_index) WHERE s.sender_group <> s.receiver_group)"""


@query("a12_record_scores", with_(*GROUP_PATH, WANTED) + f"""SELECT w.*, {q6('coalesce(g.probability, 0)')} AS probability FROM wanted w
  LEFT JOIN gscore g ON g.lr_index = w.lr_index AND g.sender_group = w.sender_group AND g.receiver_group = w.receiver_group""")
def a12(spark, folder):
    return r6(scoring.scores_of_records(group_scores(spark, folder), wanted_records(spark, folder)), "probability")


# ---- edge scores ------------------------------------------------------------------------------
SIMPLE = "simple AS (SELECT * FROM lr WHERE ligand IN (SELECT gene FROM genes) AND receptor IN (SELECT gene FROM genes))"
SCORED = """scored AS (SELECT i.lr_index, e.sample_id, e.sender_id, e.receiver_id, e.sender_group, e.receiver_group, e.distance,
  e.weight AS spatial_weight, a.value AS ligand_expression, b.value AS receptor_expression, a.value * b.value AS molecular_product,
  a.value * b.value / (0.5 + a.value * b.value) AS hill FROM edges e JOIN scaled a ON a.cell_id = e.sender_id
  JOIN scaled b ON b.cell_id = e.receiver_id JOIN simple i ON i.ligand = a.gene AND i.receptor = b.gene
  WHERE a.value > {0} AND b.value > {0})"""
EDGE_COLUMNS = ["distance", "spatial_weight", "ligand_expression", "receptor_expression", "molecular_product", "hill", "spatial_score"]


def scored(spark, folder, minimum=0.0):
    lr = scoring.simple_interactions(d.lr(spark), d.genes(spark, folder))
    return scoring.scored_edges(d.expression(spark, folder), d.cells(spark, folder), lr, RADIUS,
                                weight="gaussian", scale=2.5, min_expression=minimum)


def _edge_sql(minimum):
    rounded = ", ".join(f"{q6(c)} AS {c}" for c in EDGE_COLUMNS[:-1])
    return with_(*BASE, d.LR, SIMPLE, EDGES, SCORED.format(minimum)) + f"""SELECT lr_index, sample_id, sender_id, receiver_id,
  sender_group, receiver_group, {rounded}, {q6('hill * spatial_weight')} AS spatial_score FROM scored"""


@query("j8_edge_scoring", _edge_sql(0))
def j8(spark, folder):
    return r6(scored(spark, folder), *EDGE_COLUMNS)


@query("p16_expression_support", _edge_sql(0.2))
def p16(spark, folder):
    return r6(scored(spark, folder, 0.2), *EDGE_COLUMNS)


@query("a2_simple_group_scores", with_(*BASE, d.LR, SIMPLE, EDGES, SCORED.format(0)) + f"""SELECT lr_index, sender_group, receiver_group,
  count(*) AS supported_edges, {q6('sum(hill)')} AS sum_hill, {q6('sum(hill * spatial_weight)')} AS sum_spatial_score,
  {q6('avg(hill * spatial_weight)')} AS mean_spatial_score FROM scored GROUP BY 1, 2, 3""")
def a2(spark, folder):
    return r6(scoring.simple_group_scores(scored(spark, folder)), "sum_hill", "sum_spatial_score", "mean_spatial_score")


@query("a3_interaction_diagnostics", with_(*BASE, d.LR, SIMPLE, EDGES, SCORED.format(0)) + f"""SELECT i.lr_index, i.interaction_name, i.ligand, i.receptor,
  (SELECT count(*) FROM scaled s WHERE s.gene = i.ligand) AS ligand_supported_cells,
  (SELECT count(*) FROM scaled s WHERE s.gene = i.receptor) AS receptor_supported_cells,
  CAST((SELECT count(*) FROM scaled s JOIN edges e ON e.sender_id = s.cell_id WHERE s.gene = i.ligand) AS BIGINT) AS visited_out_edges,
  (SELECT count(*) FROM scored s WHERE s.lr_index = i.lr_index) AS supported_edges, (SELECT count(*) FROM edges) AS graph_edges,
  {q6('(SELECT count(*) FROM scored s WHERE s.lr_index = i.lr_index) / (SELECT count(*) FROM edges)')} AS supported_fraction FROM simple i""")
def a3(spark, folder):
    cells, expr = d.cells(spark, folder), d.expression(spark, folder)
    lr = scoring.simple_interactions(d.lr(spark), d.genes(spark, folder))
    out = scoring.interaction_diagnostics(expr, cells, lr, scored(spark, folder), graph.degrees(cells, RADIUS))
    return r6(out, "supported_fraction")


# ---- edge-mean communication ------------------------------------------------------------------
EPS25 = "25.0"
ALL_EDGES = """near AS (SELECT a.sample_id, a.cell_id AS s, b.cell_id AS r, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist
  FROM cells a JOIN cells b ON a.sample_id = b.sample_id AND a.cell_id <> b.cell_id),
graph AS (SELECT * FROM near WHERE dist > 0 AND dist <= 5.0),
selfw AS (SELECT sample_id, min(dist) AS mind FROM graph GROUP BY 1),
terms AS (SELECT a.sample_id, a.lr_index, a.cell_id AS s, b.cell_id AS r, a.l * b.r / (0.5 + a.l * b.r) / g.dist * a.m * b.m AS p
  FROM graph g JOIN lev a ON a.cell_id = g.s JOIN lev b ON b.cell_id = g.r AND a.lr_index = b.lr_index JOIN lr i ON i.lr_index = a.lr_index
  WHERE a.l > 0 AND b.r > 0 AND {contact}
  UNION ALL SELECT v.sample_id, v.lr_index, v.cell_id, v.cell_id, v.l * v.r / (0.5 + v.l * v.r) / w.mind * v.m * v.m
  FROM lev v JOIN selfw w USING (sample_id) WHERE v.l > 0 AND v.r > 0)"""
CONTACT_DEFAULT = "(i.annotation <> 'Cell-Cell Contact' OR g.dist <= 3.0)"
SUMS = """sums AS (SELECT t.sample_id, t.lr_index, a."group" AS sender_group, b."group" AS receiver_group, avg(p) AS probability, count(*) AS active_edges
  FROM terms t JOIN cells a ON a.cell_id = t.s JOIN cells b ON b.cell_id = t.r GROUP BY 1, 2, 3, 4),
linked AS (SELECT *, sum(active_edges) OVER (PARTITION BY sample_id, lr_index, sender_group) AS o,
  sum(active_edges) OVER (PARTITION BY sample_id, lr_index, receiver_group) AS i FROM sums),
shares AS (SELECT c.sample_id, m.lr_index, c."group" AS grp, count(v.cell_id) FILTER (v.l > 0) / count(*) AS fl,
  count(v.cell_id) FILTER (v.r > 0) / count(*) AS fr FROM cells c CROSS JOIN (SELECT DISTINCT lr_index FROM mem) m
  LEFT JOIN lev v ON v.cell_id = c.cell_id AND v.lr_index = m.lr_index GROUP BY 1, 2, 3)"""
RECORDS = """records AS (SELECT k.sample_id, k.lr_index, k.sender_group, k.receiver_group, k.probability, k.active_edges FROM linked k
  JOIN shares a ON a.sample_id = k.sample_id AND a.lr_index = k.lr_index AND a.grp = k.sender_group
  JOIN shares b ON b.sample_id = k.sample_id AND b.lr_index = k.lr_index AND b.grp = k.receiver_group
  WHERE o >= {min_cells} AND i >= {min_cells} AND a.fl >= {min_percent} AND b.fr >= {min_percent})"""


def edge_mean_sql(contact=CONTACT_DEFAULT, min_cells=5, min_percent=0.1):
    return (d.CELLS, d.EXPR, d.GENES, d.LR, d.MEMBERS, SAMPLE_SCALED, LEVELS, ALL_EDGES.format(contact=contact), SUMS,
            RECORDS.format(min_cells=min_cells, min_percent=min_percent))


def _record_sql(**options):
    return with_(*edge_mean_sql(**options)) + f"""SELECT k.sample_id, k.lr_index, l.interaction_name, l.ligand, l.receptor, sender_group, receiver_group,
  {q6('probability')} AS probability, active_edges FROM records k JOIN lr l ON l.lr_index = k.lr_index"""


def records(spark, folder, **changes):
    settings = comm.Settings(**{**SETTINGS, **changes})
    return comm.communication_records(
        d.expression(spark, folder), d.cells(spark, folder), d.interactions(spark, folder), settings)


@query("a1_edge_mean_communication", _record_sql())
def a1(spark, folder):
    return r6(records(spark, folder).drop("pvalue"), "probability")


@query("a34_sections", with_(*edge_mean_sql(min_cells=1, min_percent=0.0)) + f"""SELECT sample_id, count(*) AS records,
  CAST(sum(active_edges) AS BIGINT) AS active_edges, {q6('max(probability)')} AS max_probability FROM records GROUP BY 1""")
def a34(spark, folder):
    out = records(spark, folder, min_cells=1, min_percent=0.0).groupBy("sample_id").agg(
        F.count("*").alias("records"), F.sum("active_edges").alias("active_edges"),
        F.max("probability").alias("max_probability"))
    return r6(out, "max_probability")


@query("p17_percent_filter", _record_sql(min_percent=0.45, min_cells=1))
def p17(spark, folder):
    return r6(records(spark, folder, min_percent=0.45, min_cells=1).drop("pvalue"), "probability")


@query("p19_contact_forced", _record_sql(contact="g.dist <= 3.0"))
def p19(spark, folder):
    return r6(records(spark, folder, contact_forced=True).drop("pvalue"), "probability")


@query("p19_contact_off", _record_sql(contact="true"))
def p19_off(spark, folder):
    return r6(records(spark, folder, contact_dependent=False).drop("pvalue"), "probability")


def _decimals(column):
    """Decimals that one significant digit of the smallest positive value needs."""
    e = f"floor(log10({column}))"
    shifted = f"({e} + CASE WHEN round({column} / pow(10, {e})) >= 10 THEN 1 ELSE 0 END)"
    return f"max(CASE WHEN {column} > 0 THEN greatest(-{shifted}, 0) ELSE 0 END) OVER (PARTITION BY sample_id, lr_index)"


def _text(column, decimals):
    return "CASE " + " ".join(f"WHEN {decimals} = {i} THEN printf('%.{i}f', {column})" for i in range(4)) + " END"


LEGACY = f"""decimals AS (SELECT *, {_decimals('fl')} AS dl, {_decimals('fr')} AS dr FROM shares),
texts AS (SELECT sample_id, lr_index, grp, {_text('fl', 'dl')} >= '0.1' AS okl, {_text('fr', 'dr')} >= '0.1' AS okr FROM decimals)"""
LEGACY_RECORDS = """records AS (SELECT k.sample_id, k.lr_index, k.sender_group, k.receiver_group, k.probability, k.active_edges FROM linked k
  JOIN texts a ON a.sample_id = k.sample_id AND a.lr_index = k.lr_index AND a.grp = k.sender_group
  JOIN texts b ON b.sample_id = k.sample_id AND b.lr_index = k.lr_index AND b.grp = k.receiver_group WHERE o >= 5 AND i >= 5 AND a.okl AND b.okr)"""


@query("p18_legacy_percent_filter", with_(*edge_mean_sql()[:-1], LEGACY, LEGACY_RECORDS) + f"""SELECT k.sample_id, k.lr_index, l.interaction_name, l.ligand, l.receptor,
  sender_group, receiver_group, {q6('probability')} AS probability, active_edges FROM records k JOIN lr l ON l.lr_index = k.lr_index""")
def p18(spark, folder):
    return r6(records(spark, folder, percent_filter="legacy").drop("pvalue"), "probability")


@query("n13_active_edge_diagnostics", with_(*edge_mean_sql()) + f"""SELECT t.sample_id, lr_index, count(*) AS active_edges,
  {q6('any_value(mind)')} AS min_distance, {q6('1 / any_value(mind)')} AS self_spatial_weight FROM terms t JOIN selfw w ON w.sample_id = t.sample_id GROUP BY 1, 2""")
def n13(spark, folder):
    out = comm.active_edges_per_interaction(
        d.expression(spark, folder), d.cells(spark, folder), d.interactions(spark, folder), comm.Settings(**SETTINGS))
    return r6(out, "min_distance", "self_spatial_weight")
