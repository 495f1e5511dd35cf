import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellwire.operators import expression as ex
from cellwire.operators import interactions as ia
from cellwire.operators import permutation as pm
from cellwire.operators import scoring
from cellwire.plans import communication as comm

CELLS = "sample_id string, cell_id string, x double, y double, `group` string, compartment string"
LR = "lr_index int, interaction_name string, ligand string, receptor string, annotation string, agonist string, antagonist string, co_A_receptor string, co_I_receptor string"


def cells_of(spark, points, groups, sample="s"):
    return spark.createDataFrame([(sample, f"c{i}", float(x), float(y), g, "x") for i, ((x, y), g) in enumerate(zip(points, groups))], CELLS)


def expr_of(spark, genes, sample="s"):
    rows = [(sample, f"c{i}", g, float(v)) for g, vs in genes.items() for i, v in enumerate(vs) if v > 0]
    return spark.createDataFrame(rows, "sample_id string, cell_id string, gene string, value double")


def lr_of(spark, *rows):
    return spark.createDataFrame([(i + 1, *r, *[""] * (8 - len(r))) for i, r in enumerate(rows)], LR)


def names_of(spark, rows):
    return spark.createDataFrame(rows or [("none", "")], "name string, member string")


def genes_of(spark, names):
    return spark.createDataFrame([(n,) for n in names], "gene string")


def test_direct_edge_check(spark):
    cells = cells_of(spark, [(0, 0), (1, 0), (3, 0)], "AAB")
    expr = expr_of(spark, {"L": [1, .5, 0], "R": [0, 1, .5]})
    inter = ia.prepare_interactions(lr_of(spark, ("L_R", "L", "R", "Secreted Signaling")), genes_of(spark, "LR"), names_of(spark, []), names_of(spark, []))
    s = comm.Settings(tol=0, interaction_range=3, scale_distance=1, min_percent=0, min_cells=1)
    got = {(r["sender_group"], r["receiver_group"]): (r["probability"], r["active_edges"]) for r in comm.communication_records(expr, cells, inter, s).collect()}
    assert got[("A", "A")] == (pytest.approx(0.5833333333), 2)
    assert got[("A", "B")] == (pytest.approx(0.1666666667), 2)
    assert len(got) == 2


def random_section(n=60, copies=0, seed=11):
    rng = random.Random(seed)
    points = [(rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(n)] + [(5.0, 5.0)] * copies
    groups = [rng.choice("ABC") for _ in points]
    genes = {g: [max(0.0, rng.uniform(-1, 3)) for _ in points] for g in ("L", "R", "X", "Y", "AG", "AN", "CA", "CI")}
    return points, groups, genes


def direct_records(points, groups, genes, radius, contact=None, top=None):
    """Plain double loop over cells for one interaction with every cofactor role."""
    top = top or max(max(v) for v in genes.values())
    v = {g: np.array(x) / top for g, x in genes.items()}
    lig = np.where((v["L"] > 0) & (v["X"] > 0), np.sqrt(v["L"] * v["X"]), 0)
    rec = v["R"] * (1 + v["CA"]) / (1 + v["CI"])
    mod = (1 + v["AG"] / (.5 + v["AG"])) * (.5 / (.5 + v["AN"]))
    dist = np.array([[math.dist(a, b) for b in points] for a in points])
    keep = (dist > 0) & (dist <= radius)
    low = dist[keep].min()
    if contact:
        keep &= dist <= contact
    sums = {}
    for i in range(len(points)):
        for j in range(len(points)):
            if not (keep[i, j] or i == j):
                continue
            w = 1 / low if i == j else 1 / dist[i, j]
            product = lig[i] * rec[j]
            p = product / (.5 + product) * w * mod[i] * mod[j]
            if p > 0:
                sums.setdefault((groups[i], groups[j]), []).append(p)
    return {k: (np.mean(x), len(x)) for k, x in sums.items()}


@pytest.mark.parametrize("limit,copies", [(50_000, 0), (50_000, 15), (5, 15)])
@pytest.mark.parametrize("contact", [None, 1.0])
def test_communication_equals_double_loop(spark, limit, copies, contact):
    """Also with many cells at one location, through the crowded path."""
    points, groups, genes = random_section(copies=copies)
    lr = lr_of(spark, ("i", "LC", "R", "Cell-Cell Contact" if contact else "Secreted Signaling", "AGS", "ANS", "CAS", "CI"))
    inter = ia.prepare_interactions(
        lr, genes_of(spark, genes), names_of(spark, [("LC", "L"), ("LC", "X")]),
        names_of(spark, [("AGS", "AG"), ("ANS", "AN"), ("CAS", "CA"), ("CAS", "absent")]))
    s = comm.Settings(tol=0, interaction_range=2.5, scale_distance=1, contact_range=1.0, min_percent=0, min_cells=1, tile_limit=limit)
    got = comm.communication_records(expr_of(spark, genes), cells_of(spark, points, groups), inter, s).collect()
    want = direct_records(points, groups, genes, 2.5, contact)
    assert {(r["sender_group"], r["receiver_group"]) for r in got} == set(want)
    for r in got:
        mean, count = want[(r["sender_group"], r["receiver_group"])]
        assert r["active_edges"] == count and r["probability"] == pytest.approx(mean, rel=1e-9)


def test_ratio_scales_distances(spark):
    points, groups, genes = random_section()
    lr = lr_of(spark, ("i", "L", "R", "Secreted Signaling"))
    inter = ia.prepare_interactions(lr, genes_of(spark, genes), names_of(spark, []), names_of(spark, []))
    one = comm.communication_records(expr_of(spark, genes), cells_of(spark, points, groups), inter, comm.Settings(tol=0, interaction_range=2.5, min_percent=0, min_cells=1))
    half = [(x / 2, y / 2) for x, y in points]
    two = comm.communication_records(expr_of(spark, genes), cells_of(spark, half, groups), inter, comm.Settings(ratio=2, tol=0, interaction_range=2.5, min_percent=0, min_cells=1))
    pick = lambda df: sorted((r["sender_group"], r["receiver_group"], r["active_edges"], round(r["probability"], 9)) for r in df.collect())
    assert pick(one) == pick(two)


def test_trimean_and_large_path(spark):
    expr = expr_of(spark, {"g1": [0, 1, 2, 8, 0, 0, 4, 12], "g2": [1, 3, 5, 7, 2, 4, 6, 8]})
    cells = cells_of(spark, [(i, 0) for i in range(8)], "AAAABBBB")
    for limit in (1000, 2):
        got = {(r["gene"], r["group"]): r["value"] for r in ex.trimean_by_group(expr, cells, limit=limit).collect()}
        assert got == {("g1", "A"): 1.8125, ("g1", "B"): 2.5, ("g2", "A"): 4.0, ("g2", "B"): 5.0}


def test_simple_edges(spark):
    cells = cells_of(spark, [(i, 0) for i in range(4)], "AABB")
    expr = expr_of(spark, {"L": [2, 0, 4, 0], "R": [0, 3, 0, 5]})
    lr = lr_of(spark, ("L_R", "L", "R"))
    got = {(r["sender_id"], r["receiver_id"]): r for r in scoring.scored_edges(expr, cells, lr, 1.01, normalize=False).collect()}
    assert {k: v["molecular_product"] for k, v in got.items()} == {("c0", "c1"): 6, ("c2", "c1"): 12, ("c2", "c3"): 20}
    assert all(v["hill"] == pytest.approx(v["molecular_product"] / (.5 + v["molecular_product"])) for v in got.values())


def test_coverage(spark):
    lr = lr_of(spark, ("a", "L", "R"), ("b", "L", "complete"), ("c", "L", "partial"), ("d", "L", "absent"), ("e", "L", "empty"), ("f", "L", "ZERO"))
    complexes = names_of(spark, [("complete", "R"), ("complete", "R2"), ("partial", "R"), ("partial", "missing"), ("empty", "")])
    genes = genes_of(spark, ["L", "R", "R2", "ZERO"])
    audit = {r["lr_index"]: r for r in ia.coverage_audit(lr, genes, complexes, names_of(spark, [])).collect()}
    assert [audit[i]["valid"] for i in range(1, 7)] == [True, True, False, False, False, True]
    assert audit[5]["reason"] == "unresolved_receptor_definition"
    missing = ia.missing_genes(lr, genes, complexes, names_of(spark, [])).where("required").collect()
    assert {r["gene"] for r in missing} == {"missing", "absent"}
    with pytest.raises(ValueError):
        ia.prepare_interactions(lr, genes, complexes, names_of(spark, []))


def test_order_of_classes(spark):
    lr = lr_of(spark, ("a", "L", "R", "Cell-Cell Contact"), ("b", "L", "R", "Other"), ("c", "L", "R", "Secreted Signaling"), ("d", "L", "R", "ECM-Receptor"))
    got = [r["interaction_name"] for r in ia.order_interactions(lr).orderBy("lr_index").collect()]
    assert got == ["c", "d", "a", "b"]


def test_legacy_percent_strings(spark):
    rows = [("k", 11 / 90), ("k", 8 / 82), ("k", 3 / 63), ("m", 0.5), ("m", 0.0004), ("m", 0.0), ("w", 1.0), ("w", 0.0)]
    df = spark.createDataFrame(rows, "key string, f double")
    got = [r["t"] for r in comm.legacy_percent_strings(df, ["key"], "f", "t").orderBy("key", F.desc("f")).collect()]
    assert got == ["0.12", "0.10", "0.05", "5e-01", "4e-04", "0e+00", "1", "0"]
    assert "0.10" >= "0.1" and not 8 / 82 >= 0.1


def test_label_permutation_counts(spark):
    """p values follow from the labels that the permutation operator reports."""
    points, groups, genes = random_section(40)
    lr = lr_of(spark, ("i", "L", "R", "Secreted Signaling"))
    inter = ia.prepare_interactions(lr, genes_of(spark, genes), names_of(spark, []), names_of(spark, []))
    s = comm.Settings(tol=0, interaction_range=2.5, scale_distance=1, min_percent=0, min_cells=1, n_perm=15)
    cells = cells_of(spark, points, groups)
    got = {(r["sender_group"], r["receiver_group"]): r for r in comm.communication_records(expr_of(spark, genes), cells, inter, s).collect()}
    labels = {r["cell_id"]: r["labels"] for r in pm.permuted_labels(cells, ["sample_id"], 15, 1).collect()}
    bare = dict(genes, X=genes["L"], CA=[0] * 40, CI=[0] * 40, AG=[0] * 40, AN=[0] * 40)
    top = max(max(v) for v in genes.values())
    runs = [direct_records(points, [labels[f"c{i}"][b] for i in range(40)], bare, 2.5, top=top) for b in range(16)]
    for key, r in got.items():
        assert r["probability"] == pytest.approx(runs[0][key][0])
        assert r["pvalue"] == sum(run.get(key, (0,))[0] > runs[0][key][0] + 1e-12 for run in runs[1:]) / 15
