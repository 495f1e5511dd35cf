"""Faults that must not pass in silence, and comparisons of very small scores."""
import numpy as np
import pytest

from cellwire import sources
from cellwire.operators import cohort, graph, permutation, session


def test_weak_scores_keep_their_p_value(spark):
    rows = [(0, 1, "A", "B", 2e-13), (1, 1, "A", "B", 3e-13), (2, 1, "A", "B", 4e-13), (3, 1, "A", "B", 2e-13 * (1 + 1e-15)), (4, 1, "A", "B", 1e-13)]
    scores = spark.createDataFrame(rows, "b int, lr_index int, sender_group string, receiver_group string, probability double")
    strict = permutation.summarize_nulls(scores, 4).first()
    assert (strict["n_reject"], strict["pvalue"]) == (2, 0.5)
    equal = permutation.summarize_nulls(scores, 4, tail="greater_equal").first()
    assert (equal["n_reject"], equal["pvalue"]) == (3, 0.75)


def cells_of_two_samples(spark):
    rows = [(s, f"c{k}", float(k), 0.0, "x") for s in ("S0", "S1") for k in range(3)]
    return spark.createDataFrame(rows, "sample_id string, cell_id string, x double, y double, compartment string")


def test_edges_are_known_by_sample_and_id(spark):
    cells = cells_of_two_samples(spark)
    good = graph.radius_edges(cells, 1.0)
    assert all(graph.validate_edges(good, cells).first().asDict().values())
    schema = "sample_id string, sender_id string, receiver_id string, distance double, weight double"
    own = cells.unionByName(spark.createDataFrame([("S1", "only", 9.0, 0.0, "x")], cells.schema))
    faults = {
        "ends_known": ("S0", "c0", "nobody", 1.0, 1.0), "no_cross_sample_edges": ("S0", "c0", "only", 1.0, 1.0),
        "no_self_edges": ("S0", "c0", "c0", 1.0, 1.0), "finite_nonnegative_distance": ("S0", "c0", "c2", -1.0, 1.0),
        "finite_nonnegative_weight": ("S0", "c0", "c2", 1.0, float("nan")), "no_duplicate_edges": ("S0", "c0", "c1", 1.0, 1.0),
    }
    for name, row in faults.items():
        found = graph.validate_edges(good.select(*[c.split()[0] for c in schema.split(", ")]).unionByName(spark.createDataFrame([row], schema)), own).first()
        assert not found[name], name


def test_unfinished_neighbour_rounds_are_an_error(spark):
    with pytest.raises(ValueError):
        graph.knn_edges(cells_of_two_samples(spark), 2, first_reach=0.01, max_rounds=2)


@pytest.mark.parametrize("body", ["3 2 5\n1 1 5\n2 1 7\n3 2 1\n3 1 2\n", "4 2 4\n1 1 5\n2 1 7\n3 2 1\n3 1 2\n", "3 2 2\n1 1 5\n9 1 7\n", "3 2 1\n1 3 5\n"])
def test_matrix_header_must_agree(spark, tmp_path, body):
    (tmp_path / "matrix.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n" + body)
    (tmp_path / "features.tsv").write_text("id1\tS\nid2\tS\nid3\tT\n")
    (tmp_path / "barcodes.tsv").write_text("b-1\nb-2\n")
    with pytest.raises(ValueError):
        sources.read_mex(spark, str(tmp_path))


def test_matrix_feature_ids_must_be_unique(spark, tmp_path):
    (tmp_path / "matrix.mtx").write_text("%%MatrixMarket\n2 1 1\n1 1 5\n")
    (tmp_path / "features.tsv").write_text("id1\tS\nid1\tT\n")
    (tmp_path / "barcodes.tsv").write_text("b-1\n")
    with pytest.raises(ValueError):
        sources.read_mex(spark, str(tmp_path))


def test_variance_ratio_search_is_open():
    assert cohort.search_theta(lambda t: (np.log10(max(t, 1e-9)) - 5) ** 2) == pytest.approx(1e5, rel=1e-3)
    assert cohort.search_theta(lambda t: t) == 0.0


def test_stored_tables_can_be_dropped(spark):
    before = set(session.stored_tables())
    session.materialize(spark.range(3).toDF("k"))
    new = [t for t in session.stored_tables() if t not in before]
    assert len(new) == 1
    session.drop_tables(spark, new)
    assert set(session.stored_tables()) == before
