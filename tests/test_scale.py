"""Plans that must not grow with the product of two inputs: what is broadcast, exchanged or held by one task."""
import pytest
from pyspark.sql import functions as F

from cellwire import sources
from cellwire.operators import cohort as co
from cellwire.operators import graph, ordered, permutation, proximity, ranking, support
from cellwire.queries import QUERIES
from plans import metric, run

UNITS, FEATURES = 3000, 40


def sparse(spark):
    units = spark.range(UNITS).select(F.concat(F.lit("u"), "id").alias("section_id"))
    features = spark.range(FEATURES).select(F.concat(F.lit("f"), "id").alias("feature_id"))
    scores = units.crossJoin(features).where("pmod(xxhash64(section_id, feature_id), 7) = 0").withColumn("score", F.lit(2.5))
    return ranking.materialize(scores), ranking.materialize(units), ranking.materialize(features)


def test_grid_is_never_broadcast(spark):
    _, units, features = sparse(spark)
    # Few rows that a generator makes many look small to the planner.
    count, nodes = run(ranking.complete_grid(units, features.distinct(), "section_id", "feature_id"))
    assert count == UNITS * FEATURES
    assert max(metric(nodes, "BroadcastExchange", "numOutputRows"), default=0) <= UNITS


@pytest.mark.parametrize("fill", ["matrix", "rebuilt"])
def test_zeros_are_neither_broadcast_nor_exchanged(spark, fill):
    scores, units, features = sparse(spark)
    if fill == "matrix":
        out = co.score_matrix(scores, units)
    else:
        out = sources.rebuild_zero_filled(scores, units, features, "section_id", "feature_id")
    count, nodes = run(out)
    assert count == UNITS * FEATURES
    assert max(metric(nodes, "BroadcastExchange", "numOutputRows"), default=0) <= UNITS
    assert sum(metric(nodes, "Exchange", "shuffleRecordsWritten")) < UNITS * FEATURES / 2


def test_zero_filled_in_blocks(spark):
    rows = [("a", 1, 2.0), ("a", 5, 3.0), ("b", 2, 4.0), ("x", 3, 9.0), ("b", 9, 9.0), ("c", 4, None)]
    scores = spark.createDataFrame(rows, "u string, f long, score double")
    units = spark.createDataFrame([("a",), ("b",), ("c",)], "u string")
    got = {(r.u, r.f): r.score for r in ranking.zero_filled(scores, units, spark.range(8).toDF("f"), "u", "f", block=3).collect()}
    want = {(u, f): 0.0 for u in "abc" for f in range(8)} | {("a", 1): 2.0, ("a", 5): 3.0, ("b", 2): 4.0}
    assert got == want


def test_zeros_arise_from_tiles(spark):
    """Neither one row per unit and block is exchanged, nor do listed scores change the order in which a unit's features come."""
    scores, units, features = sparse(spark)
    out = ranking.zero_filled(scores, units, features, "section_id", "feature_id", block=1)
    count, nodes = run(out)
    assert count == UNITS * FEATURES
    assert sum(metric(nodes, "Exchange", "shuffleRecordsWritten")) < 2 * scores.count()
    rows = ranking.zero_filled(scores, units, features, "section_id", "feature_id").collect()
    orders = {tuple(r.feature_id for r in rows[i:i + FEATURES]) for i in range(0, len(rows), FEATURES)}
    assert len(orders) == 1
    assert sorted(r.section_id for r in rows[::FEATURES]) == sorted(r.section_id for r in units.collect())
    assert sum(r.score > 0 for r in rows) == scores.count()


def test_neighbouring_tiles_share_a_task(spark):
    """A task names few units, so that their names stay in the dictionaries of files."""
    scores, units, features = sparse(spark)
    out = ranking.zero_filled(scores, units, features, "section_id", "feature_id", block=4, chunk=50)
    per_task = out.groupBy(F.spark_partition_id()).agg(F.countDistinct("section_id").alias("n"), F.count("*").alias("rows")).collect()
    assert len(per_task) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert max(r.n for r in per_task) < UNITS / 4
    assert max(r["rows"] for r in per_task) < 2 * UNITS * FEATURES / len(per_task)


@pytest.mark.parametrize("block, chunk", [(3, 1), (1, 2), (128, 256)])
def test_zero_filled_equals_the_join(spark, block, chunk):
    rows = [("a", 1, 2.0), ("a", 1, 5.0), ("a", 5, 3.0), ("b", 2, 4.0), ("x", 3, 9.0), (None, 3, 9.0), ("c", None, 9.0), ("c", 4, None)]
    scores = spark.createDataFrame(rows, "u string, f long, score double")
    units = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "u string")
    for listed in (scores, scores.limit(0)):
        got = ranking.zero_filled(listed, units, spark.range(8).toDF("f"), "u", "f", block=block, chunk=chunk)
        want = units.crossJoin(spark.range(8).toDF("f")).join(listed, ["u", "f"], "left").fillna(0.0, ["score"])
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select("u", "f", "score").collect()))
    assert ranking.zero_filled(scores, units.limit(0), spark.range(8).toDF("f"), "u", "f").count() == 0


def test_adjusted_families_without_buckets(spark):
    """Small families take one window, large ones buckets: the same values, and no table of the families is broadcast."""
    tests = spark.range(6000).select(
        (F.col("id") % 900).alias("family"), "id", F.expr("pmod(xxhash64(id), 50) / 50.0").alias("p_value")).withColumn(
        "p_value", F.expr("CASE WHEN id % 11 > 0 THEN CAST(p_value AS DOUBLE) END"))
    small = ranking.bh_adjust(tests, keys=["family"])
    large = ranking.bh_adjust(tests, keys=["family"], limit=1)
    assert sorted(map(repr, small.collect())) == sorted(map(repr, large.select(*small.columns).collect()))
    _, nodes = run(small)
    assert sum(n.nodeName().endswith("Join") for n in nodes) == 1


CELL_SCHEMA = "sample_id string, cell_id string, x double, y double, `group` string, compartment string"


def plane(spark, n=400):
    place = "pmod(xxhash64({}, id), 1000) / 100.0"
    return ranking.materialize(spark.range(n).selectExpr(
        "concat('s', id % 2) AS sample_id", "concat('c', id) AS cell_id", f"CAST({place.format(1)} AS DOUBLE) AS x",
        f"CAST({place.format(2)} AS DOUBLE) AS y", "concat('g', id % 3) AS group", "concat('k', id % 2) AS compartment"))


def test_tiles_keep_all_partitions(spark):
    """Cells are small, their pairs are not: the join of tiles must not shrink to one task."""
    edges = graph.radius_edges(ranking.materialize(plane(spark).coalesce(1)), 1.0)
    assert spark.conf.get("spark.sql.shuffle.partitions") == str(edges.rdd.getNumPartitions())


def test_draws_keep_all_partitions(spark):
    labelled = permutation.permuted_labels(plane(spark), ["sample_id"], 5).select("sample_id", "cell_id", "labels")
    assert spark.conf.get("spark.sql.shuffle.partitions") == str(labelled.rdd.getNumPartitions())


def test_crowded_tiles_are_split_early():
    assert proximity.SENDERS_PER_TILE <= 4096


def test_edges_carry_attributes_without_another_exchange(spark):
    cells = plane(spark)
    out = graph.radius_edges(cells, 1.0, attributes=["group", "compartment"])
    want = graph.edge_table(graph.radius_edges(cells, 1.0), cells).select(*out.columns)
    assert sorted(map(repr, out.collect())) == sorted(map(repr, want.collect()))
    _, nodes = run(out)
    assert max(metric(nodes, "Exchange", "shuffleRecordsWritten")) <= 4 * 400
    within = graph.radius_edges(cells, 1.0, same_compartment=True, attributes=["compartment"]).collect()
    assert within and all(r.sender_compartment == r.receiver_compartment for r in within)


def test_symmetry_is_seen_without_exchanging_edges(spark):
    cells = plane(spark)
    edges = ranking.materialize(graph.radius_edges(cells, 1.0))
    degree = graph.degrees(cells, 1.0)
    frame = graph.validate_degrees(edges, degree, cells)
    frame.collect()
    assert "LeftAnti" not in frame._jdf.queryExecution().executedPlan().toString()
    first = edges.limit(1)
    for frame, symmetric in ((edges, True), (edges.unionByName(first), True), (edges.subtract(first), False)):
        assert graph.validate_degrees(frame, degree, cells).first()["symmetric"] is symmetric


def test_points_of_the_support_tail_are_not_aggregated_by_key(spark):
    """The characteristic function has a point per supporting patient; only its sum is kept."""
    units = ranking.materialize(spark.range(6000).selectExpr(
        "concat('s', id) AS section_id", "concat('p', id div 2) AS patient_id",
        "CASE WHEN id div 2 % 3 = 0 THEN 'Control' ELSE 'Disease' END AS condition"))
    scores = ranking.materialize(units.where("pmod(xxhash64(section_id), 3) > 0").selectExpr("section_id", "'f' AS feature_id", "1.0D AS score"))
    frame = support.exact_class_probabilities(scores, units, 50)
    row = frame.first()
    assert abs(sum(row[f"p_{c}"] for c in support.CLASSES) - 1) < 1e-9
    _, nodes = run(frame)
    assert max(metric(nodes, "HashAggregate", "numOutputRows")) < 1000


def test_buckets_follow_the_cuts(spark):
    rows = ranking.materialize(spark.range(5000).selectExpr("id % 2 AS k", "CAST(pmod(xxhash64(id), 700) AS DOUBLE) AS v"))
    held = ranking.value_bucket(rows, ["k"], "v", "b").collect()
    for k in (0, 1):
        pairs = sorted((r.v, r.b) for r in held if r.k == k)
        assert [b for _, b in pairs] == sorted(b for _, b in pairs)
        assert len({b for _, b in pairs}) > 200 and max(b for _, b in pairs) <= ranking.CUTS


def test_edges_are_dealt_once_to_find_copies(spark):
    cells = plane(spark)
    edges = ranking.materialize(graph.radius_edges(cells, 1.0))
    frame = graph.validate_edges(edges, cells)
    assert frame.first()["no_duplicate_edges"] is True
    assert graph.validate_edges(edges.unionByName(edges.limit(1)), cells).first()["no_duplicate_edges"] is False
    # The copies are counted in a scalar subquery, which is no child of the plan.
    text = frame._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(sample_id" in text
    assert not any("hashpartitioning" in line and "receiver_id" in line for line in text.splitlines())


FOLDER = "/root/testdata/sf0.01"


def test_graphs_are_compared_without_exchanging_edges(spark):
    cells = spark.read.parquet(f"{FOLDER}/embeddings.parquet").count()
    _, nodes = run(QUERIES["c23_graph_equality"](spark, FOLDER))
    # Receivers are copied to four tiles at most; there are ten edges for each.
    assert max(metric(nodes, "Exchange", "shuffleRecordsWritten")) <= 4 * cells


def test_cells_are_sorted_instead_of_edges(spark):
    folder = "/root/testdata/sf0.1"
    cells = spark.read.parquet(f"{folder}/embeddings.parquet").count()
    frame = QUERIES["w11_canonical_order"](spark, folder)
    rows = [tuple(r)[:3] for r in frame.collect()]
    assert rows == sorted(rows) and len(rows) > 19 * cells
    count, nodes = run(QUERIES["w11_canonical_order"](spark, folder))
    assert count == len(rows)
    assert sum(metric(nodes, "Exchange", "shuffleRecordsWritten")) <= 8 * cells


@pytest.mark.parametrize("candidates", [1 << 21, 30])
def test_ordered_edges_equal_the_sorted_list(spark, monkeypatch, candidates):
    monkeypatch.setattr(ordered, "CANDIDATES", candidates)
    cells = plane(spark)
    odd = cells.unionByName(cells.where("cell_id LIKE 'c2%'").withColumn("x", F.col("y"))).unionByName(cells.where("cell_id = 'c7'"))
    odd = odd.withColumn("x", F.expr("CASE cell_id WHEN 'c40' THEN 'NaN' WHEN 'c41' THEN NULL WHEN 'c42' THEN '-Infinity' ELSE x END").cast("double"))
    odd = odd.withColumn("y", F.expr("CASE WHEN cell_id LIKE 'c5%' THEN y + 1e17 WHEN cell_id LIKE 'c6%' THEN 1e300 ELSE y END"))
    odd = odd.withColumn("cell_id", F.expr("CASE WHEN cell_id <> 'c11' THEN cell_id END"))
    grid = cells.selectExpr("sample_id", "CAST(substr(cell_id, 2) AS BIGINT) AS cell_id", "floor(x) AS x", "floor(y) AS y", "floor(x + y) % 3 AS z")
    for frame, radius in ((cells, 1.5), (cells, 1e-3), (odd, 2.0), (grid, 2.0), (cells.where("sample_id = 's0'"), 50.0), (cells.limit(0), 1.0)):
        got = [tuple(r) for r in graph.ordered_edges(frame, radius).collect()]
        want = [tuple(r) for r in graph.radius_edges(frame, radius).drop("weight").collect()]
        assert [r[:3] for r in got] == sorted(r[:3] for r in want)
        assert sorted(got) == sorted(want)


@pytest.mark.parametrize("limit", [4096, 5])
def test_graph_differences_equal_those_of_the_edge_lists(spark, limit):
    cells = plane(spark)
    moved = ranking.materialize(cells.where("cell_id NOT IN ('c3', 'c8')").withColumn(
        "x", F.expr("CASE WHEN cell_id LIKE 'c1%' THEN x + 0.25 WHEN cell_id = 'c40' THEN 'NaN' WHEN cell_id = 'c41' THEN NULL ELSE x END")))
    twice = moved.unionByName(moved.where("cell_id = 'c20'"))
    deep = cells.withColumn("z", F.expr("CAST(pmod(xxhash64(cell_id), 3) AS DOUBLE)"))
    for left, right, a, b in ((cells, cells, 1.5, 1.5), (cells, cells, 2.0, 1.5), (cells, moved, 1.5, 1.5), (moved, cells, 1.0, 2.0),
                              (cells, twice, 1.5, 1.5), (deep, cells, 1.5, 1.5), (cells.limit(0), cells, 1.5, 1.5)):
        want = graph.edge_differences(graph.radius_edges(left, a), graph.radius_edges(right, b)).first()
        assert graph.radius_graph_differences(left, right, a, b, limit).first() == want
