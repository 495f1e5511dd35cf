import math
import random

import pytest
from pyspark.sql import functions as F

from cellwire.operators import graph
from cellwire.operators import permutation as pm
from cellwire.operators.scoring import group_support

SCHEMA = "sample_id string, cell_id string, x double, y double, `group` string, compartment string"


def cloud(spark, n=80, seed=3, copies=0):
    rng = random.Random(seed)
    rows = [(f"s{i % 2}", f"c{i}", rng.uniform(-5, 5), rng.uniform(-5, 5), "AB"[i % 3 % 2], "xy"[i % 4 // 2]) for i in range(n)]
    rows += [("s0", f"d{i}", 1.25, -0.5, "AB"[i % 2], "x") for i in range(copies)]
    return spark.createDataFrame(rows, SCHEMA), rows


def brute(rows, radius, barrier=False):
    out = {}
    for a in rows:
        for b in rows:
            if a[1] != b[1] and a[0] == b[0] and (not barrier or a[5] == b[5]):
                dist = math.dist(a[2:4], b[2:4])
                if dist <= radius:
                    out[(a[1], b[1])] = dist
    return out


@pytest.mark.parametrize("barrier", [False, True])
@pytest.mark.parametrize("limit", [50_000, 4])
def test_radius_edges_equal_brute_force(spark, barrier, limit):
    """The small limit sends every tile through the split of crowded tiles."""
    cells, rows = cloud(spark, copies=12)
    got = graph.radius_edges(cells, 1.7, barrier, "gaussian", 0.8, limit=limit).collect()
    want = brute(rows, 1.7, barrier)
    assert len(got) == len(want)
    for r in got:
        assert r["distance"] == pytest.approx(want[(r["sender_id"], r["receiver_id"])], abs=1e-12)
        assert r["weight"] == pytest.approx(math.exp(-r["distance"] ** 2 / (2 * 0.64)))
    brute_df = graph.radius_edges_bruteforce(cells, 1.7, barrier)
    assert brute_df.count() == len(want)


def test_bruteforce_cap(spark):
    cells, _ = cloud(spark)
    with pytest.raises(ValueError):
        graph.radius_edges_bruteforce(cells, 1.0, max_cells=10)


def test_three_dimensions(spark):
    rng = random.Random(5)
    rows = [("s", f"c{i}", *[rng.uniform(0, 4) for _ in range(3)]) for i in range(60)]
    cells = spark.createDataFrame(rows, "sample_id string, cell_id string, x double, y double, z double")
    want = sum(a[1] != b[1] and math.dist(a[2:], b[2:]) <= 1.3 for a in rows for b in rows)
    assert graph.radius_edges(cells, 1.3).count() == want


@pytest.mark.parametrize("limit", [50_000, 3])
def test_support_and_degrees_count_copies(spark, limit):
    cells, rows = cloud(spark, copies=9)
    edges = brute(rows, 1.7)
    group = {r[1]: r[4] for r in rows}
    want = {}
    for a, b in edges:
        want[(group[a], group[b])] = want.get((group[a], group[b]), 0) + 1
    got = {(r["sender_group"], r["receiver_group"]): r["supported_edges"] for r in group_support(cells, 1.7, limit=limit).collect()}
    assert got == want
    degree = {r["cell_id"]: r["degree"] for r in graph.degrees(cells, 1.7, limit=limit).collect()}
    assert degree == {r[1]: sum(a == r[1] for a, _ in edges) for r in rows}


@pytest.mark.parametrize("reach", [None, 0.2, 50.0])
def test_knn(spark, reach):
    cells, rows = cloud(spark, copies=10)
    want = set()
    for a in rows:
        order = sorted((math.dist(a[2:4], b[2:4]), b[1]) for b in rows if b[0] == a[0] and b[1] != a[1])
        want |= {(a[1], b) for _, b in order[:5]}
    got = {(r["sender_id"], r["receiver_id"]) for r in graph.knn_edges(cells, 5, first_reach=reach).collect()}
    assert got == want


def test_knn_more_than_sample(spark):
    cells, rows = cloud(spark, n=6)
    assert graph.knn_edges(cells, 10).count() == 2 * 3 * 2


def test_barrier_and_samples(spark):
    rows = [("s1", "1", 0.0, 0.0, "A", "x"), ("s2", "2", 0.1, 0.0, "A", "x"), ("s1", "3", 0.2, 0.0, "A", "y"), ("s1", "4", 0.3, 0.0, "A", "x")]
    cells = spark.createDataFrame(rows, SCHEMA)
    got = {(r[1], r[2]) for r in graph.radius_edges(cells, 1.0, same_compartment=True).collect()}
    assert got == {("1", "4"), ("4", "1")}
    checks = graph.validate_edges(graph.radius_edges(cells, 1.0), cells).first().asDict()
    assert not checks.pop("no_cross_compartment_edges") and all(checks.values())


def test_blocks_keep_profiles_inside(spark):
    cells, _ = cloud(spark)
    blocks = graph.spatial_blocks(cells, 100.0)
    moves = pm.permute_within_blocks(blocks, 4)
    where = {r["cell_id"]: (r["sample_id"], r["compartment"]) for r in blocks.collect()}
    rows = moves.collect()
    assert sorted(r["source_id"] for r in rows) == sorted(where)
    assert all(where[r["cell_id"]] == where[r["source_id"]] for r in rows)
    far = spark.createDataFrame([("s", str(i), 100.0 * i, 0.0, "A", "x") for i in range(3)], SCHEMA)
    assert all(r["cell_id"] == r["source_id"] for r in pm.permute_within_blocks(graph.spatial_blocks(far, 10.0)).collect())


def test_split_strata_give_the_same_permutation(spark):
    cells, _ = cloud(spark)
    plain = pm.permuted_labels(cells, ["sample_id"], 5).select("cell_id", "labels")
    split = pm.permuted_labels(cells, ["sample_id"], 5, limit=3).select("cell_id", "labels")
    assert plain.exceptAll(split).count() == 0
    tally = plain.select(F.posexplode("labels")).groupBy("pos", "col").count().collect()
    assert len({r["count"] for r in tally if r["col"] == "A"}) == 1
    later = pm.permuted_labels(cells, ["sample_id"], 3, first=3).select("cell_id", F.slice("labels", 2, 3).alias("l"))
    assert later.exceptAll(plain.select("cell_id", F.slice("labels", 4, 3).alias("l"))).count() == 0
