"""Neighbour graphs on the derived cells."""
from __future__ import annotations

from pyspark.sql import functions as F

from cellwire.operators import graph
from cellwire.queries import domain as d
from cellwire.queries.registry import q6, query, r6, with_

RADIUS, K = 5.0, 6
D2 = "((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"
EDGES = f"""edges AS (SELECT a.sample_id, a.cell_id AS sender_id, b.cell_id AS receiver_id, a."group" AS sender_group,
  b."group" AS receiver_group, a.compartment AS sender_compartment, b.compartment AS receiver_compartment, sqrt({D2}) AS distance,
  exp(-{D2} / (2 * 2.5 * 2.5)) AS weight
  FROM cells a JOIN cells b ON a.sample_id = b.sample_id AND a.cell_id <> b.cell_id WHERE {D2} <= 25.0 + 25.0 * 16 * 2.220446049250313e-16)"""
NEIGHBOURS = f"""ranked AS (SELECT a.sample_id, a.cell_id AS sender_id, b.cell_id AS receiver_id, a.compartment AS sc, b.compartment AS rc,
  sqrt({D2}) AS distance, row_number() OVER (PARTITION BY a.sample_id, a.cell_id ORDER BY {D2}, b.cell_id) AS k
  FROM cells a JOIN cells b ON a.sample_id = b.sample_id AND a.cell_id <> b.cell_id)"""


def edges(spark, folder, **options):
    return graph.radius_edges(d.cells(spark, folder), RADIUS, weight="gaussian", scale=2.5, **options)


@query("j1_radius_join", with_(d.CELLS, EDGES) + f"""SELECT sample_id, sender_id, receiver_id, {q6('distance')} AS distance,
  {q6('weight')} AS weight FROM edges WHERE sender_compartment = receiver_compartment""")
def j1(spark, folder):
    return r6(edges(spark, folder, same_compartment=True), "distance", "weight")


@query("j2_compact_graph", with_(d.CELLS, EDGES) + f"""SELECT c.sample_id, c.cell_id, count(e.sender_id) AS degree,
  {q6('coalesce(sum(e.weight), 0)')} AS weighted_degree FROM cells c LEFT JOIN edges e
  ON e.sample_id = c.sample_id AND e.sender_id = c.cell_id GROUP BY 1, 2""")
def j2(spark, folder):
    return r6(graph.degrees(d.cells(spark, folder), RADIUS, weight="gaussian", scale=2.5), "weighted_degree")


@query("j4_knn_join", with_(d.CELLS, NEIGHBOURS, f"cut AS (SELECT * FROM ranked WHERE k <= {K} AND distance <= 8 AND sc = rc)",
       "m AS (SELECT quantile_cont(distance, 0.5) AS scale FROM cut WHERE distance > 0)") + f"""SELECT sample_id, sender_id, receiver_id,
  {q6('distance')} AS distance, {q6('exp(-distance / scale)')} AS weight FROM cut, m""")
def j4(spark, folder):
    knn = graph.knn_edges(d.cells(spark, folder), K, same_compartment=True, max_radius=8.0, weight="exponential")
    return r6(knn, "distance", "weight")


@query("w2_knn_rank_cut", with_(d.CELLS, NEIGHBOURS) + f"""SELECT sample_id, sender_id, receiver_id, {q6('distance')} AS distance
  FROM ranked WHERE k <= {K}""")
def w2(spark, folder):
    return r6(graph.knn_edges(d.cells(spark, folder), K).drop("weight"), "distance")


@query("j5_edge_table", with_(d.CELLS, EDGES) + f"""SELECT sample_id, sender_id, receiver_id, sender_group, receiver_group,
  sender_compartment, receiver_compartment, {q6('distance')} AS distance, {q6('weight')} AS weight FROM edges""")
def j5(spark, folder):
    return r6(edges(spark, folder, attributes=["group", "compartment"]), "distance", "weight")


@query("j13_nearest_distance", with_(d.CELLS, NEIGHBOURS) + f"""SELECT sample_id, {q6('min(distance)')} AS min_distance,
  {q6('2 / min(distance)')} AS distance_scale FROM ranked WHERE distance > 0 GROUP BY 1""")
def j13(spark, folder):
    nearest = graph.knn_edges(d.cells(spark, folder), 1).where("distance > 0")
    return r6(nearest.groupBy("sample_id").agg(
        F.min("distance").alias("min_distance"), (2 / F.min("distance")).alias("distance_scale")),
        "min_distance", "distance_scale")


@query("p10_edge_validation", with_(d.CELLS, EDGES) + """SELECT true AS ends_known, bool_and(a.sample_id = b.sample_id) AS no_cross_sample_edges,
  bool_and(sender_id <> receiver_id) AS no_self_edges, bool_and(distance >= 0) AS finite_nonnegative_distance,
  bool_and(weight >= -1e-12) AS finite_nonnegative_weight, bool_and(sender_compartment = receiver_compartment) AS no_cross_compartment_edges,
  count(*) = count(DISTINCT sender_id || '>' || receiver_id) AS no_duplicate_edges
  FROM edges e JOIN cells a ON a.cell_id = e.sender_id JOIN cells b ON b.cell_id = e.receiver_id""")
def p10(spark, folder):
    return graph.validate_edges(edges(spark, folder), d.cells(spark, folder))


@query("p11_compact_validation", with_(d.CELLS, EDGES) + """SELECT count(*) > 0 AS degree_sum_matches,
  count(*) > 0 AS degrees_nonnegative, count(*) > 0 AS every_cell_listed,
  bool_and(EXISTS (SELECT 1 FROM edges r WHERE r.sender_id = e.receiver_id AND r.receiver_id = e.sender_id)) AS symmetric FROM edges e""")
def p11(spark, folder):
    cells = d.cells(spark, folder)
    return graph.validate_degrees(edges(spark, folder), graph.degrees(cells, RADIUS), cells)


@query("p15_spatial_weight", with_(d.CELLS, EDGES) + f"""SELECT sample_id, sender_id, receiver_id, 1.0::DOUBLE AS w_binary,
  {q6('exp(-distance * distance / 12.5)')} AS w_gaussian, {q6('exp(-distance / 2.5)')} AS w_exponential FROM edges""")
def p15(spark, folder):
    from cellwire.functions import spatial_weight
    e = graph.radius_edges(d.cells(spark, folder), RADIUS)
    kinds = ("binary", "gaussian", "exponential")
    out = e.select("sample_id", "sender_id", "receiver_id",
                   *[spatial_weight(F.col("distance"), k, 2.5).alias(f"w_{k}") for k in kinds])
    return r6(out, *[f"w_{k}" for k in kinds])


@query("a4_group_support", with_(d.CELLS, EDGES) + f"""SELECT sender_group, receiver_group, count(*) AS supported_edges,
  {q6('sum(weight)')} AS sum_spatial_weight, {q6('avg(weight)')} AS mean_spatial_weight FROM edges GROUP BY 1, 2""")
def a4(spark, folder):
    from cellwire.operators.scoring import group_support
    s = group_support(d.cells(spark, folder), RADIUS, weight="gaussian", scale=2.5)
    return r6(s, "sum_spatial_weight", "mean_spatial_weight")


@query("a29_graph_metrics", with_(d.CELLS, EDGES, """deg AS (SELECT c.sample_id, c.cell_id, count(e.sender_id) AS degree FROM cells c
  LEFT JOIN edges e ON e.sender_id = c.cell_id GROUP BY 1, 2)""") + f"""SELECT sample_id, count(*) AS cells,
  CAST(sum(degree) AS BIGINT) AS directed_edges, {q6('avg(degree)')} AS mean_out_degree, {q6('sum(degree) / (count(*) * count(*))')} AS density,
  CAST(sum(CASE WHEN degree = 0 THEN 1 ELSE 0 END) AS BIGINT) AS isolated_cells FROM deg GROUP BY 1""")
def a29(spark, folder):
    return r6(graph.graph_metrics(d.cells(spark, folder), RADIUS), "mean_out_degree", "density")


@query("a33_weighted_degree", with_(d.CELLS, EDGES) + f"""SELECT sample_id, sender_id, {q6('sum(weight)')} AS weighted_degree
  FROM edges GROUP BY 1, 2""")
def a33(spark, folder):
    return r6(graph.weighted_degree(edges(spark, folder)), "weighted_degree")


@query("w11_canonical_order", with_(d.CELLS, EDGES) + f"""SELECT sample_id, sender_id, receiver_id, {q6('distance')} AS distance
  FROM edges ORDER BY sample_id, sender_id, receiver_id""")
def w11(spark, folder):
    return r6(graph.ordered_edges(d.cells(spark, folder), RADIUS), "distance")


@query("c23_graph_equality", with_(d.CELLS, EDGES, "other AS (SELECT * FROM edges WHERE distance <= 4)") + """SELECT count(e.sender_id) AS left_edges,
  count(o.sender_id) AS right_edges, count(*) FILTER (o.sender_id IS NULL) AS left_only, count(*) FILTER (e.sender_id IS NULL) AS right_only,
  max(abs(e.distance - o.distance)) AS max_distance_error, count(*) FILTER (o.sender_id IS NULL OR e.sender_id IS NULL OR e.distance <> o.distance) = 0 AS graphs_equal
  FROM edges e FULL JOIN other o ON e.sender_id = o.sender_id AND e.receiver_id = o.receiver_id""")
def c23(spark, folder):
    cells = d.cells(spark, folder)
    return graph.radius_graph_differences(cells, cells, RADIUS, 4.0)


@query("n2_spatial_blocks", with_(d.CELLS, "o AS (SELECT floor(min(x) / 8) * 8 AS ox, floor(min(y) / 8) * 8 AS oy FROM cells)") + """
  SELECT cell_id, length(sample_id) || ':' || sample_id || '|' || length(compartment) || ':' || compartment || '|' || CAST(CAST(floor((x - ox) / 8) AS BIGINT) AS VARCHAR) || '|' ||
  CAST(CAST(floor((y - oy) / 8) AS BIGINT) AS VARCHAR) AS block_id FROM cells, o""")
def n2(spark, folder):
    return graph.spatial_blocks(d.cells(spark, folder), 8.0).select("cell_id", "block_id")


@query("p12_group_labels", with_(d.CELLS) + """SELECT count(*) AS cells, count(*) FILTER ("group" IS NULL) AS missing_labels,
  count(DISTINCT "group") AS groups, 10 - count(DISTINCT "group") AS unused_levels FROM cells""")
def p12(spark, folder):
    from cellwire.operators.validation import validate_labels
    levels = spark.range(10).select(F.concat(F.lit("G"), F.col("id").cast("string")).alias("group"))
    return validate_labels(d.cells(spark, folder), levels)


@query("j9_key_alignment", with_(d.CELLS, d.EXPR) + """SELECT count(DISTINCT c.cell_id) AS left_keys, count(DISTINCT e.cell_id) AS right_keys,
  count(DISTINCT c.cell_id) FILTER (e.cell_id IS NULL) AS left_only, count(DISTINCT e.cell_id) FILTER (c.cell_id IS NULL) AS right_only
  FROM cells c FULL JOIN expr e ON c.sample_id = e.sample_id AND c.cell_id = e.cell_id""")
def j9(spark, folder):
    from cellwire.operators.validation import key_alignment
    return key_alignment(d.cells(spark, folder), d.expression(spark, folder), ["sample_id", "cell_id"])
