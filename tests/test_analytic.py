"""Stratified analytic, hybrid and adaptive tests against a direct numpy calculation."""
import math

import numpy as np
import pytest

from cellwire.operators import analytic as an
from cellwire.operators import permutation as pm
from cellwire.operators.interactions import prepare_interactions

PROBS, SHARES, H = np.array([.25, .5, .75]), np.array([.25, .5, .25]), 0.05


@pytest.fixture(scope="module")
def fixture(spark):
    rng = np.random.default_rng(7)
    rows, expr, data = [], [], {"L": [], "R": [], "Z": []}
    blocks, groups = [], []
    for b in range(8):
        for i in range(40):
            c = f"c{b:02d}{i:02d}"
            g = "AB"[i % 2] if b % 3 else "AAB"[i % 3]
            rows.append(("s", c, float(b), float(i), g, "x", f"b{b}"))
            blocks.append(b), groups.append(g)
            values = {"L": rng.gamma(3, .5) + b * .02, "R": rng.gamma(4, .4), "Z": rng.gamma(2) if rng.random() < .5 else 0.0}
            for gene, v in values.items():
                data[gene].append(v)
                if v > 0:
                    expr.append(("s", c, gene, float(v)))
    cells = spark.createDataFrame(rows, "sample_id string, cell_id string, x double, y double, `group` string, compartment string, block_id string")
    e = spark.createDataFrame(expr, "sample_id string, cell_id string, gene string, value double")
    support = spark.createDataFrame([(a, b, 10, 5.0, .5) for a in "AB" for b in "AB"],
                                    "sender_group string, receiver_group string, supported_edges long, sum_spatial_weight double, mean_spatial_weight double")
    lr = spark.createDataFrame([(1, "L_R", "L", "R", "S", "", "", "", ""), (2, "Z_R", "Z", "R", "S", "", "", "", ""), (3, "C", "LC", "R", "S", "", "", "", "")],
                               "lr_index int, interaction_name string, ligand string, receptor string, annotation string, agonist string, antagonist string, co_A_receptor string, co_I_receptor string")
    genes = spark.createDataFrame([("L",), ("R",), ("Z",)], "gene string")
    complexes = spark.createDataFrame([("LC", "L"), ("LC", "Z")], "name string, member string")
    inter = prepare_interactions(lr, genes, complexes, complexes.where("false"))
    top = max(max(v) for v in data.values())
    return cells, e, support, inter, {k: np.array(v) / top for k, v in data.items()}, np.array(blocks), np.array(groups)


def weighted(values, weights, probs):
    order = np.argsort(values, kind="stable")
    v, w = values[order], weights[order] / weights.sum()
    v, start = np.unique(v, return_index=True)
    w = np.add.reduceat(w, start)
    x = np.concatenate([[0], np.cumsum(w)[:-1]]) / (1 - w)
    x[0], x[-1] = 0, 1
    return np.interp(probs, x, v)


def expected(data, blocks, groups, sender, receiver):
    def influence(gene, g):
        w = np.array([np.mean(groups[blocks == b] == g) for b in blocks]) / np.sum(groups == g)
        q, lo, hi = (weighted(data[gene], w, PROBS + s) for s in (0, -H, H))
        dens = 2 * H / (hi - lo)
        return sum(SHARES[j] * (PROBS[j] - (data[gene] <= q[j])) / dens[j] for j in range(3)), SHARES @ q

    def trimean(gene, g):
        return np.array([.25, .5, .25]) @ np.quantile(data[gene][groups == g], PROBS)

    (fl, cl), (fr, cr) = influence("L", sender), influence("R", receiver)
    ns, nr = np.sum(groups == sender), np.sum(groups == receiver)
    vl = vr = vx = 0.0
    rl, rr = fl.copy(), fr.copy()
    for b in np.unique(blocks):
        m = blocks == b
        n, cs, ct = m.sum(), np.sum(groups[m] == sender), np.sum(groups[m] == receiver)
        vl += cs * (1 - cs / n) * np.var(fl[m], ddof=1)
        vr += ct * (1 - ct / n) * np.var(fr[m], ddof=1)
        vx -= cs * ct / n * np.cov(fl[m], fr[m])[0, 1]
        rl[m] -= fl[m].mean()
        rr[m] -= fr[m].mean()
    var = vl / ns ** 2 / cl ** 2 + vr / nr ** 2 / cr ** 2 + 2 * vx / (ns * nr) / (cl * cr)
    z = (math.log(trimean("L", sender)) + math.log(trimean("R", receiver)) - math.log(cl) - math.log(cr)) / math.sqrt(var)
    return z, math.sqrt(var), np.corrcoef(rl, rr)[0, 1]


def test_stratified(fixture):
    cells, e, support, inter, data, blocks, groups = fixture
    for limit in (1_000_000, 50):
        got = {(r["lr_index"], r["sender_group"], r["receiver_group"]): r for r in an.stratified_analytic_test(e, cells, support, inter, limit=limit).collect()}
        assert len(got) == 12
        for s, t in ("AB", "BA"):
            r = got[(1, s, t)]
            z, sd, cor = expected(data, blocks, groups, s, t)
            assert (r["analytic_z"], r["analytic_log_sd"], r["influence_correlation"]) == (pytest.approx(z), pytest.approx(sd), pytest.approx(cor))
            assert r["pvalue"] == pytest.approx(.5 * math.erfc(z / math.sqrt(2)))
            assert got[(2, s, t)]["fallback_reason"] == "ligand_excessive_zero_fraction"
            assert got[(3, s, t)]["fallback_reason"] == "non_simple_lr"
        assert got[(1, "A", "A")]["fallback_reason"] == "autocrine_pair"


def test_hybrid_confirms_every_call(fixture):
    cells, e, support, inter, *_ = fixture
    rows = an.hybrid_test(e, cells, support, inter, n_perm=19, alpha=.2).collect()
    assert len(rows) == 12
    for r in rows:
        if r["permutation_confirmed"]:
            assert r["pvalue"] == (r["n_reject"] + 1) / 20
        else:
            assert r["pvalue"] == 1 and r["analytic_pvalue"] > .21


def test_adaptive_counts_match_one_long_run(fixture):
    cells, e, support, inter, *_ = fixture
    adaptive = an.adaptive_test(e, cells, support, inter, min_permutations=10, batch_size=10, max_permutations=30).collect()
    by_record = lambda rows: {(r["lr_index"], r["sender_group"], r["receiver_group"]): r for r in rows}
    runs = {n: by_record(pm.block_permutation_test(e, cells, support, inter, n, tail="greater_equal").collect()) for n in (10, 20, 30)}
    assert len(adaptive) == 12
    for key, r in by_record(adaptive).items():
        assert r["n_reject"] == runs[r["permutations_used"]][key]["n_reject"]
        assert (r["decision"] == "significant") == (r["pvalue_upper"] <= .05)
        if r["stop_reason"] == "max_permutations":
            assert r["permutations_used"] == 30
        assert r["pvalue_lower"] <= r["pvalue"] <= r["pvalue_upper"]


def test_no_mixed_block_is_refused(fixture):
    cells, e, support, inter, *_ = fixture
    from pyspark.sql import functions as F
    alone = cells.withColumn("block_id", F.col("cell_id"))
    with pytest.raises(ValueError):
        pm.block_permutation_test(e, alone, support, inter, 5)
