"""Sums over edges for all replicates: no rows per edge, any sizes, crowded places."""
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cellwire.operators import graph, interactions, ranking, replicates
from cellwire.plans import communication as comm
from plans import metric, run
from test_scoring import cells_of, expr_of, genes_of, lr_of, names_of, random_section


def section(spark, n, copies, **settings):
    points, groups, genes = random_section(n, copies)
    inter = interactions.prepare_interactions(
        lr_of(spark, ("i", "L", "R", "Secreted Signaling"), ("j", "X", "Y", "Cell-Cell Contact")), genes_of(spark, genes),
        names_of(spark, []), names_of(spark, []))
    s = comm.Settings(tol=0, interaction_range=5, contact_range=2, scale_distance=1, min_percent=0, min_cells=1, n_perm=15, **settings)
    cells, expr = cells_of(spark, points, groups), expr_of(spark, genes)
    return comm.communication_records(ranking.materialize(expr), ranking.materialize(cells), inter, s)


def test_edges_of_replicates_are_no_rows(spark):
    cells = 300
    frame = section(spark, cells, 0)
    edges = sum(r.active_edges for r in frame.collect())
    _, nodes = run(frame)
    made = max(v for name in ("numOutputRows", "shuffleRecordsWritten") for n in ("Generate", "HashAggregate", "Project", "Exchange") for v in metric(nodes, n, name))
    assert made < edges  # Each edge used to be sixteen rows.


@pytest.mark.parametrize("copies", [0, 30])
def test_split_tiles_give_the_same_p_values(spark, copies):
    def records(limit):
        return {(r.lr_index, r.sender_group, r.receiver_group): (r.active_edges, r.pvalue, pytest.approx(r.probability))
                for r in section(spark, 60, copies, tile_limit=limit).collect()}

    assert records(512) == records(2) != {}


def side(rng, n, labels, key, receiver):
    rows = []
    for _ in range(n):
        which = sorted(rng.sample(range(1, 5), rng.randint(0, 4)))
        rows.append(dict(k0="s" if key < 2 else "t", k1=key, receiver=receiver, p0=float(rng.randint(0, 5)), p1=rng.uniform(0, 5), lr_index=which,
                         level=[rng.random() for _ in which], modulator=[rng.choice([0.0, 1.5]) for _ in which],
                         span=[1.0 if i == 2 else 2.0 for i in which], labels=[rng.randrange(labels) for _ in range(4)]))
    return sorted(rows, key=lambda r: r["p0"])


@pytest.mark.parametrize("labels", [1, 3, 300])
@pytest.mark.parametrize("pairs, held, candidates", [(1 << 12, 1 << 20, 1 << 20), (0, 1, 7), (1 << 12, 1, 1)])
def test_sums_equal_loops(monkeypatch, labels, pairs, held, candidates):
    for name, value in (("PAIRS", pairs), ("HELD", held), ("CANDIDATES", candidates)):
        monkeypatch.setattr(replicates, name, value)
    rng = random.Random(3)
    tiles = [(side(rng, a, labels, k, 0), side(rng, b, labels, k, 1)) for k, (a, b) in enumerate([(30, 20), (0, 5), (4, 0), (9, 12)])]
    rule, want = replicates.Scores(2.0, 0.5, 3.0, 0.5, 2.0, labels), {}
    for senders, receivers in tiles:
        for s in senders:
            for r in receivers:
                d = math.sqrt((s["p0"] - r["p0"]) ** 2 + (s["p1"] - r["p1"]) ** 2)
                for i in set(s["lr_index"]) & set(r["lr_index"]):
                    m, n = s["lr_index"].index(i), r["lr_index"].index(i)
                    x = (s["level"][m] * r["level"][n]) ** 2
                    if 0 < d <= min(2.0, s["span"][m]):
                        p = x / (0.25 + x) / (d * 0.5 * 3.0) * s["modulator"][m] * r["modulator"][n]
                        for b in range(4 if p > 0 else 0):
                            key = (s["k0"], i, b, s["labels"][b], r["labels"][b])
                            total, edges = want.get(key, (0.0, 0))
                            want[key] = total + p, edges + 1
    rows = [row for senders, receivers in tiles for row in senders + receivers]
    types = {"lr_index": pa.list_(pa.int32()), "labels": pa.list_(pa.int32()), "k0": pa.string(), "k1": pa.int64(), "receiver": pa.int32(), "p0": pa.float64(), "p1": pa.float64()}
    schema = pa.schema([(c, types.get(c, pa.list_(pa.float64()))) for c in rows[0]])
    batches = [pa.RecordBatch.from_pylist(rows[k:k + 11], schema) for k in range(0, len(rows), 11)]
    got = {}
    for batch in replicates.replicate_sums(iter(batches), ["k0", "k1"], 2, rule):
        for r in batch.to_pylist():
            key = r["sample_id"], r["lr_index"], r["b"], r["sender_group"], r["receiver_group"]
            total, edges = got.get(key, (0.0, 0))
            got[key] = total + r["total"], edges + r["active_edges"]
    assert got.keys() == want.keys() and len(want) > 4
    for key, (total, edges) in want.items():
        assert got[key][1] == edges and np.isclose(got[key][0], total, rtol=1e-12)


def test_smallest_distance_of_sparse_samples(spark):
    cells = spark.createDataFrame(
        [("near", 0.0, 0.0), ("near", 0.01, 0.0), ("near", 1.0, 0.0), ("far", 0.0, 0.0), ("far", 0.0, 0.0), ("far", 0.0, 0.9), ("far", 0.0, 1.95),
         ("alone", 0.0, 0.0), ("alone", 3.0, 0.0), (None, 0.0, 0.0), (None, 0.0, 0.5)], "sample_id string, x double, y double")
    for limit in (None, 1):
        got = {r.sample_id: r.min_distance for r in graph.minimum_distance(cells, 1.0, limit).collect()}
        assert got == {"near": 0.01, "far": 0.9}


def test_smallest_distance_is_searched_in_a_small_reach(spark):
    cells = ranking.materialize(spark.range(2000).selectExpr(
        "'s' AS sample_id", "pmod(xxhash64(1, id), 1000) / 100.0D AS x", "pmod(xxhash64(2, id), 1000) / 100.0D AS y"))
    from_all = graph.radius_edges(cells.withColumn("cell_id", F.monotonically_increasing_id()), 5.0).where("distance > 0").agg(F.min("distance")).first()[0]
    written = []
    keep = graph.materialize
    graph.materialize = lambda frame: (written.append(frame), keep(frame))[1]
    try:
        frame = graph.minimum_distance(cells, 5.0)
    finally:
        graph.materialize = keep
    assert frame.first()["min_distance"] == from_all
    assert len(written) == 1
    _, nodes = run(written[0])
    # A receiver meets the senders of four tiles of 0.6, not of 10.
    assert max(v for kind in ("Sort", "Shuffled", "Project") for v in metric(nodes, kind, "numOutputRows") or [0]) < 2000 * 100
