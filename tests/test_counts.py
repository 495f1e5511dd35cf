"""Binned counts, mixtures and file formats on small fixtures."""
import gzip

import pytest
from pyspark.sql import functions as F

from cellwire import sources
from cellwire.operators import counts as ct
from cellwire.operators import mixtures as mx
from cellwire.operators import sampling as sp
from cellwire.operators import validation as va

COUNTS = "barcode string, feature_id string, gene string, n long"
POSITIONS = "barcode string, in_tissue int, array_row long, array_col long"


def grid(spark, suffixes=("1",), zero=()):
    cells = [(r, c, s) for s in suffixes for r in range(4) for c in range(4)]
    name = lambda r, c, s: f"s_008um_{r:05d}_{c:05d}-{s}"
    counts = [(name(r, c, s), g, g, r * 4 + c + 1 + i) for r, c, s in cells for i, g in enumerate(("g1", "g2")) if (r, c) not in zero]
    positions = [(name(r, c, s), int((r, c) != (3, 3)), r, c) for r, c, s in cells]
    return spark.createDataFrame(counts, COUNTS), spark.createDataFrame(positions, POSITIONS)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_coarsening_conserves_counts_and_is_path_independent(spark):
    counts, positions = grid(spark)
    direct, step = ct.coarsen(counts, positions, 8, 32), ct.coarsen(counts, positions, 8, 16)
    twice = ct.coarsen(*step, 16, 32)
    assert rows(direct[0]) == rows(twice[0])
    assert direct[0].agg(F.sum("n")).first()[0] == counts.agg(F.sum("n")).first()[0]
    one = ct.with_coordinates(direct[1], 32).first()
    assert (one["x"], one["y"], one["source_bin_count"], one["barcode"]) == (16, 16, 16, "s_032um_00000_00000-1")
    report = ct.bin_equivalence(direct, twice).first().asDict()
    assert not any(report.values())
    with pytest.raises(ValueError):
        ct.coarsen(counts, positions, 8, 20)


def test_suffixes_stay_apart_and_zero_positions_set_tissue(spark):
    counts, positions = grid(spark, ("1", "2"))
    assert ct.coarsen(counts, positions, 8, 32)[1].count() == 2
    counts, positions = grid(spark, zero={(0, 0), (0, 1), (1, 0)})
    positions = positions.withColumn("in_tissue", F.when((F.col("array_row") == 0) & (F.col("array_col") == 0), 1).otherwise(0))
    coarse = {r["barcode"]: r for r in ct.coarsen(counts, positions, 8, 16)[1].collect()}
    first = coarse["s_016um_00000_00000-1"]
    assert (first["in_tissue"], first["source_bin_count"], first["source_position_count"]) == (1, 1, 4)


def test_position_and_count_validation(spark):
    counts, positions = grid(spark)
    clean = va.validate_positions(positions, 8).first().asDict()
    assert clean.pop("positions") == 16 and not any(clean.values())
    assert va.validate_positions(positions, 16).first()["size_mismatch"] == 16
    good = va.validate_counts(counts)
    va.require(good, "non_finite", "negative", "non_integer", "duplicate_keys")
    bad = va.validate_counts(counts.withColumn("n", F.col("n") - 1.5))
    with pytest.raises(ValueError):
        va.require(bad, "non_integer")


def test_feature_ids_are_filtered_before_symbols(spark):
    counts = spark.createDataFrame([("b", "id1", "S", 3), ("b", "id2", "S", 4), ("b", "id3", "T", 5)], COUNTS)
    allowed = spark.createDataFrame([("id1",), ("id3",), ("lost",)], "feature_id string")
    assert rows(ct.collapse_genes(ct.keep_features(counts, allowed))) == [("b", "S", 3), ("b", "T", 5)]
    assert rows(ct.unknown_features(allowed, counts)) == [("lost",)]


def test_dominant_bins(spark):
    weights = spark.createDataFrame([("b1", "A", .9), ("b1", "B", .1), ("b2", "B", .8), ("b2", "A", .2), ("b3", "A", .6), ("b3", "B", .4), ("b5", "A", .5), ("b5", "B", .5)],
                                    "barcode string, cell_type string, w double")
    ann = spark.createDataFrame([("b1", "ok", "A", .9), ("b2", "ok", "B", .8), ("b3", "ok", "A", .6), ("b4", "filtered", None, 0.0), ("b5", "ambiguous", None, .5), ("b6", "reject", None, 0.0)],
                                "barcode string, status string, dominant_type string, max_weight double")
    got = {r["barcode"]: r["exclusion_reason"] for r in mx.dominant_bins(ann, weights, .7).collect()}
    assert [got[f"b{i}"] for i in range(1, 7)] == ["retained", "retained", "below_min_weight"] + ["rctd_not_accepted"] * 3
    assert mx.weight_disagreements(ann, weights).count() == 0
    assert mx.weight_disagreements(ann.withColumn("max_weight", F.col("max_weight") - .1), weights).count() == 3
    counts = spark.createDataFrame([("b1", "L", "L", 10), ("b1", "N", "N", 90), ("b2", "L", "L", 3), ("b2", "N", "N", 47)], COUNTS)
    bins = spark.createDataFrame([(f"b{i}", float(i), 0.0) for i in range(1, 7)], "barcode string, x double, y double")
    expr, cells = mx.bins_as_cells(counts, bins, ann, weights, .7)
    import math
    values = {(r["cell_id"], r["gene"]): r["value"] for r in expr.collect()}
    assert values[("b1", "L")] == pytest.approx(math.log1p(1000)) and values[("b2", "L")] == pytest.approx(math.log1p(600))
    assert {r["cell_id"]: r["group"] for r in cells.collect()} == {"b1": "A", "b2": "B"}


def test_ties_are_ambiguous(spark):
    weights = mx.normalize_weights(spark.createDataFrame([("a", "X", 2.0), ("a", "Y", 2.0), ("b", "X", 3.0), ("b", "Y", 1.0)], "barcode string, cell_type string, w double"))
    bins = spark.createDataFrame([("a",), ("b",), ("c",)], "barcode string")
    got = {r["barcode"]: (r["status"], r["dominant_type"]) for r in mx.annotate_bins(bins, weights).collect()}
    assert got == {"a": ("ambiguous", None), "b": ("ok", "X"), "c": ("not_fit", None)}


def test_matrix_folder(spark, tmp_path):
    with gzip.open(tmp_path / "matrix.mtx.gz", "wt") as f:
        f.write("%%MatrixMarket matrix coordinate integer general\n%note\n3 2 4\n1 1 5\n2 1 7\n3 2 1\n3 1 2\n")
    (tmp_path / "features.tsv").write_text("id1\tS\tGene Expression\nid2\tS\nid3\tT\tAntibody\n")
    (tmp_path / "barcodes.tsv").write_text("b-1\nb-2\n")
    got = sources.read_mex(spark, str(tmp_path))
    assert rows(got) == [("b-1", "id1", "S", 5), ("b-1", "id2", "S", 7)]
    keep = spark.createDataFrame([("id2",)], "feature_id string")
    assert rows(sources.read_mex(spark, str(tmp_path), 1, keep)) == [("b-1", "id2", "id2", 7)]
    with pytest.raises(ValueError):
        sources.read_mex(spark, str(tmp_path), 1, spark.createDataFrame([("zz",)], "feature_id string"))


def test_position_formats(spark, tmp_path):
    bare, named = tmp_path / "list.csv", tmp_path / "named.csv"
    bare.write_text("b1,1,0,3,10.5,20\nb2,0,1,3,11,21\n")
    named.write_text("barcode,in_tissue,array_row,array_col\nb1,1,0,3\nb2,0,1,3\n")
    a, b = sources.read_positions(spark, str(bare)), sources.read_positions(spark, str(named))
    cols = ["barcode", "in_tissue", "array_row", "array_col"]
    assert rows(a.select(*cols)) == rows(b.select(*cols)) == [("b1", 1, 0, 3), ("b2", 0, 1, 3)]
    b.write.parquet(str(tmp_path / "p.parquet"))
    assert rows(sources.read_positions(spark, str(tmp_path / "p.parquet")).select(*cols)) == rows(b.select(*cols))


@pytest.mark.parametrize("head", ["\t1x1\t1x3", '""\t"1x1"\t"1x3"', "1x1\t1x3"])
def test_wide_counts(spark, tmp_path, head):
    path = tmp_path / "w.tsv"
    path.write_text(head + "\nA\t1\t0\nB\t0\t7\n")
    assert rows(sources.read_wide_counts(spark, str(path)).select("spot_id", "gene", "n")) == [("1x1", "A", 1), ("1x3", "B", 7)]


def test_samples_have_their_quotas(spark):
    cells = spark.createDataFrame([(f"c{i}", "aaaabbbccd"[i % 10]) for i in range(97)], "cell_id string, `group` string")
    for limit in (1_000_000, 5):
        sample = sp.stratified_sample(cells, 31, limit=limit)
        got = {r["group"]: r["count"] for r in sample.groupBy("group").count().collect()}
        assert got == {r["group"]: r["quota"] for r in sp.proportional_quotas(cells, 31).collect()} and sum(got.values()) == 31
    assert rows(sp.stratified_sample(cells, 31)) == rows(sp.stratified_sample(cells, 31, limit=5))


def test_stale_annotations_are_an_error(spark):
    weights = spark.createDataFrame([("b1", "A", .9), ("b1", "B", .1)], "barcode string, cell_type string, w double")
    stale = spark.createDataFrame([("b1", "ok", "A", .7)], "barcode string, status string, dominant_type string, max_weight double")
    counts = spark.createDataFrame([("b1", "L", "L", 10)], COUNTS)
    bins = spark.createDataFrame([("b1", 0.0, 0.0)], "barcode string, x double, y double")
    with pytest.raises(ValueError):
        mx.bins_as_cells(counts, bins, stale, weights, .5)


def test_binned_section_from_files(spark, tmp_path):
    """A matrix folder written in parts, read, collapsed, coarsened and cut to tissue as one call."""
    from cellwire.plans.bins import read_binned_section
    from cellwire.sources import write_mex

    counts = spark.createDataFrame([(f"b{r}{c}-1", f"id{k}", 1 + r + c + k) for r in range(4) for c in range(4) for k in range(3) if (r, c) != (3, 3)],
                                   "barcode string, feature_id string, n long").repartition(5)
    features = spark.createDataFrame([("id0", "S"), ("id1", "S"), ("id2", "T"), ("id3", "U")], "feature_id string, feature_name string").repartition(3)
    spots = [(f"b{r}{c}-1", int(r < 2 or c < 2), r, c, 0.0, 0.0) for r in range(4) for c in range(4)]
    barcodes = spark.createDataFrame([(s[0],) for s in spots], "barcode string").repartition(3)
    write_mex(counts, features, barcodes, f"{tmp_path}/mex")
    assert len(list((tmp_path / "mex" / "matrix.mtx").glob("part-*"))) > 2
    (tmp_path / "positions.csv").write_text("".join(",".join(map(str, s)) + "\n" for s in spots))
    summed, bins = read_binned_section(spark, f"{tmp_path}/mex", f"{tmp_path}/positions.csv", 2, 4)
    got = {(r["barcode"], r["gene"]): r["n"] for r in summed.collect()}
    want = {}
    for r in range(4):
        for c in range(4):
            if (r, c) != (3, 3) and (r < 2 or c < 2):
                key = f"s_004um_{r // 2:05d}_{c // 2:05d}-1"
                want[key, "S"] = want.get((key, "S"), 0) + 2 * (1 + r + c) + 1
                want[key, "T"] = want.get((key, "T"), 0) + 3 + r + c
    assert got == want
    assert {(r["x"], r["y"]) for r in bins.collect()} == {(2.0, 2.0), (6.0, 2.0), (2.0, 6.0)}
    with pytest.raises(ValueError):
        write_mex(counts, features.where("feature_id <> 'id1'"), barcodes, f"{tmp_path}/bad")


def test_wide_counts_in_parts(spark, tmp_path):
    from cellwire.sources import read_wide_counts, write_wide_counts

    long = spark.createDataFrame([(f"s{k % 7}", f"g{k % 11}", k % 5) for k in range(200)], "spot_id string, gene string, n long").repartition(4)
    write_wide_counts(long, f"{tmp_path}/wide")
    got = {(r["spot_id"], r["gene"]): r["n"] for r in read_wide_counts(spark, f"{tmp_path}/wide").collect()}
    want = {}
    for k in range(200):
        key = f"s{k % 7}", f"g{k % 11}"
        want[key] = want.get(key, 0) + k % 5
    assert got == {k: v for k, v in want.items() if v}


def test_blank_labels_are_unknown(spark):
    cells = spark.createDataFrame([(1,), (2,), (3,), (4,)], "k long")
    labels = spark.createDataFrame([(1, "T"), (2, " "), (3, None)], "k long, l string")
    assert {r["k"]: r["l"] for r in mx.transfer_labels(cells, labels, "k", "l").collect()} == {1: "T", 2: "Unknown", 3: "Unknown", 4: "Unknown"}
