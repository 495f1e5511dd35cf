"""Label draws by bijection: permutations, evenly spread, independent of how cells are stored."""
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellwire.operators import cohort, graph, permutation


@pytest.mark.parametrize("size", [1, 2, 5, 64, 65, 67, 100, 1000])
def test_bijections(spark, size):
    strata = spark.createDataFrame([("a", size), ("b", size)], "name string, n long")
    keyed = permutation._keyed(strata, ["name"], "n", 1)
    spots = keyed.withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    moved = spots.select("name", "p", F.expr(f"transform(sequence(1L, 40L), b -> {permutation.bijection('p', 'b', 'n')})").alias("to")).collect()
    seen = {}
    for row in moved:
        for b, to in enumerate(row["to"]):
            seen.setdefault((row["name"], b), []).append(to)
    assert all(sorted(v) == list(range(size)) for v in seen.values())
    if size >= 64:
        assert len({tuple(v) for v in seen.values()}) == len(seen)


@pytest.mark.parametrize("size", [5, 70])
def test_positions_are_spread_evenly(spark, size):
    keyed = permutation._keyed(spark.createDataFrame([("a", size)], "name string, n long"), ["name"], "n", 7)
    rows = keyed.select(F.explode(F.sequence(F.lit(1).cast("long"), F.lit(6000).cast("long"))).alias("b"), "*")
    first = Counter(r[0] for r in rows.select(F.expr(permutation.bijection("0L", "b", "n"))).collect())
    expected = 6000 / size
    statistic = sum((first.get(k, 0) - expected) ** 2 / expected for k in range(size))
    assert statistic < size - 1 + 5 * (2 * (size - 1)) ** 0.5


def test_draws_differ_between_samples(spark):
    rows = [(s, f"c{k}", float(k), 0.0, "AB"[k % 2], "x") for s in ("S0", "S1") for k in range(40)]
    cells = spark.createDataFrame(rows, "sample_id string, cell_id string, x double, y double, `group` string, compartment string")
    drawn = permutation.permuted_labels(cells, ["sample_id"], 8)
    by = {}
    for r in drawn.collect():
        by.setdefault(r["sample_id"], {})[r["cell_id"]] = r["labels"]
    assert by["S0"] != by["S1"]
    for labels in by.values():
        table = np.array([labels[f"c{k}"] for k in range(40)])
        assert (table == "A").sum(axis=0).tolist() == [20] * 9
    codes = permutation.label_codes(cells)
    assert [tuple(r) for r in codes.orderBy("code").collect()] == [(0, "A"), (1, "B")]
    coded = {(r["sample_id"], r["cell_id"]): r["labels"] for r in permutation.permuted_labels(cells, ["sample_id"], 8, codes=codes).collect()}
    assert all(["AB"[c] for c in coded[s, k]] == v for s, labels in by.items() for k, v in labels.items())


def test_no_row_per_replicate_and_no_interaction_in_the_tile_join(spark):
    """Plans: draws explode nothing; the distance join has neither lr_index nor replicate among its keys."""
    rows = [("S0", f"c{k}", float(k), 0.0, "AB"[k % 2], "x") for k in range(40)]
    cells = spark.createDataFrame(rows, "sample_id string, cell_id string, x double, y double, `group` string, compartment string")
    plan = permutation.permuted_labels(cells, ["sample_id"], 8)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan and "Generate posexplode" not in plan


def test_names_of_blocks_do_not_run_together(spark):
    rows = [("a|b", "c", "1", 0.0, 0.0), ("a", "b|c", "2", 0.0, 0.0), ("a", None, "3", 0.0, 0.0), ("a", "", "4", 0.0, 0.0)]
    cells = spark.createDataFrame(rows, "sample_id string, compartment string, cell_id string, x double, y double")
    assert graph.spatial_blocks(cells, 5.0).select("block_id").distinct().count() == 4


def test_agreement_of_tiny_effects(spark):
    rows = [(3e-13, 2e-13), (3e-13, -2e-13), (1e-18, 0.5), (0.0, 0.0), (-1e-20, -3e-20)]
    got = [r[0] for r in spark.createDataFrame(rows, "a double, b double").select(cohort.agreement("a", "b")).collect()]
    assert got == [1.0, 0.0, 0.0, 1.0, 1.0]
    ranks = [r[0] for r in spark.createDataFrame([(1e-15,), (1e-15 * (1 + 1e-14),), (2e-15,)], "a double").select(cohort.significant("a")).collect()]
    assert ranks[0] == ranks[1] < ranks[2]
