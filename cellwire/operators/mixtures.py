"""Cell-type mixture weights per bin: normalisation, annotation, metrics and use as labels.

``weights(barcode, cell_type, w)`` holds positive weights only.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellwire.operators.expression import log_cp10k
from cellwire.operators.session import materialize

TIE = 1e-10
# Spot classes of two-type fits.
SPOT_CLASSES = ["reject", "singlet", "doublet_certain", "doublet_uncertain"]


def normalize_weights(weights: DataFrame) -> DataFrame:
    """Divide by the sum of the bin; bins without weight stay empty."""
    whole = W.partitionBy("barcode")
    return weights.where("w > 0").withColumn("w", F.col("w") / F.sum("w").over(whole))


def _summary(weights: DataFrame) -> DataFrame:
    """Largest weight, number of types that tie for it, and the type of the largest weight."""
    top = F.max("w").over(W.partitionBy("barcode"))
    return weights.withColumn("_top", top).groupBy("barcode").agg(
        F.max("w").alias("max_weight"),
        F.count(F.when(F.abs(F.col("w") - F.col("_top")) <= TIE, 1)).alias("_ties"),
        F.max_by("cell_type", "w").alias("_type"),
    )


def annotate_bins(bins: DataFrame, weights: DataFrame) -> DataFrame:
    """Status and dominant type of every bin. ``bins`` may carry a prior ``status``.

    A bin without weight was not fitted; a tie for the largest weight is ambiguous.
    """
    prior = F.col("status") if "status" in bins.columns else F.lit("ok")
    held = bins.join(_summary(weights), "barcode", "left").withColumn("_prior", prior)
    tied = F.col("_ties") > 1
    weight = F.coalesce("max_weight", F.lit(0.0))
    status = (
        F.when(F.col("_prior") != "ok", F.col("_prior")).when(weight <= 0, "not_fit")
        .when(tied, "ambiguous").otherwise("ok")
    )
    return held.withColumn("status", status).withColumn("max_weight", weight).withColumn(
        "dominant_type", F.when(F.col("status") == "ok", F.col("_type"))).drop("_prior", "_ties", "_type")


def pair_weights(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bins, weights) of two-type fits: barcode, spot_class, first_type, second_type, w_first, w_second."""
    rejected, single = F.col("spot_class") == "reject", F.col("spot_class") == "singlet"
    status = F.when(rejected, "reject").when(F.col("spot_class") == "doublet_uncertain", "ambiguous").otherwise("ok")
    bins = results.select(
        "barcode", "spot_class", F.when(~rejected, F.col("first_type")).alias("first_type"),
        F.when(~rejected & ~single, F.col("second_type")).alias("second_type"), status.alias("status"))
    entry = lambda t, w: F.struct(F.col(t).alias("cell_type"), w.alias("w"))
    long = results.where(~rejected).select("barcode", F.explode(F.array(
        entry("first_type", F.when(single, F.lit(1.0)).otherwise(F.col("w_first"))),
        entry("second_type", F.when(single, F.lit(0.0)).otherwise(F.col("w_second"))),
    )).alias("_e")).select("barcode", "_e.*")
    return bins, normalize_weights(long)


def multi_weights(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bins, weights) of multi-type fits: barcode, cell_type, w, confident."""
    bins = results.groupBy("barcode").agg(
        F.when(F.min(F.col("confident").cast("int")) == 1, "ok").otherwise("ambiguous").alias("status"))
    return bins, normalize_weights(results.select("barcode", "cell_type", "w"))


def weight_disagreements(annotations: DataFrame, weights: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Accepted bins whose claimed type or weight is not the largest weight of the table."""
    claimed = annotations.where("status = 'ok' AND dominant_type IS NOT NULL").join(
        weights.groupBy("barcode").agg(F.max("w").alias("_max")), "barcode")
    own = weights.select("barcode", F.col("cell_type").alias("dominant_type"), F.col("w").alias("_own"))
    held = claimed.join(own, ["barcode", "dominant_type"], "left").withColumn("_own", F.coalesce("_own", F.lit(0.0)))
    return held.where(
        (F.abs(F.col("_own") - F.col("max_weight")) > tolerance) | (F.abs(F.col("_own") - F.col("_max")) > tolerance)
    ).select("barcode", "dominant_type", "max_weight")


def dominant_bins(annotations: DataFrame, weights: DataFrame, min_weight: float = 0.5) -> DataFrame:
    """Inclusion and exclusion reason of every bin (fixed reason values)."""
    fitted = weights.where("w > 0").select("barcode").distinct().withColumn("_fit", F.lit(True))
    types = weights.select(F.col("cell_type").alias("dominant_type")).distinct().withColumn("_known", F.lit(True))
    held = annotations.join(fitted, "barcode", "left").join(types, "dominant_type", "left")
    accepted = F.coalesce(F.col("status") == "ok", F.lit(False))
    confident = (
        F.coalesce(F.col("_known"), F.lit(False)) & F.coalesce(F.col("_fit"), F.lit(False))
        & F.coalesce(F.col("max_weight").between(0, 1), F.lit(False))
    )
    reason = (
        F.when(~accepted, "rctd_not_accepted").when(~confident, "no_confident_type")
        .when(F.col("max_weight") < min_weight, "below_min_weight").otherwise("retained")
    )
    return held.withColumn("exclusion_reason", reason).withColumn(
        "included", F.col("exclusion_reason") == "retained").drop("_fit", "_known")


def bins_as_cells(
    counts: DataFrame,
    bins: DataFrame,
    annotations: DataFrame,
    weights: DataFrame,
    min_weight: float = 0.5,
    normalization: str = "log1p_cp10k",
) -> tuple[DataFrame, DataFrame]:
    """(expr, cells) of the retained bins, for the communication analysis with ratio 1.

    The library size is taken over all genes of the bin. ``bins`` has x and y and may have
    sample_id. Both results are stored once, since the analysis reads them several times. Annotations
    that disagree with ``weights`` are stale, which is an error.
    """
    stale = weight_disagreements(annotations, weights)
    if not stale.isEmpty():
        raise ValueError(f"annotations do not match the weights, first at {stale.first()['barcode']}")
    kept = dominant_bins(annotations, weights, min_weight).where("included").select("barcode", "dominant_type")
    sample = F.col("sample_id") if "sample_id" in bins.columns else F.lit("sample_1")
    cells = bins.join(kept, "barcode").select(
        sample.alias("sample_id"), F.col("barcode").cast("string").alias("cell_id"), "x", "y",
        F.col("dominant_type").alias("group"), F.lit("all").alias("compartment"))
    cells = materialize(cells)
    retained = counts.join(kept.select("barcode"), "barcode", "left_semi")
    values = log_cp10k(retained, ["barcode"]) if normalization == "log1p_cp10k" else retained.withColumn(
        "value", F.col("n").cast("double"))
    expr = values.where("value > 0").withColumn("cell_id", F.col("barcode").cast("string")).join(
        cells.select("sample_id", "cell_id"), "cell_id").select("sample_id", "cell_id", "gene", "value")
    return materialize(expr), cells


def mixture_metrics(annotations: DataFrame, weights: DataFrame) -> DataFrame:
    """Class shares, mean largest weight, gap of the top two, entropy, purity and balance."""
    order = W.partitionBy("barcode").orderBy(F.col("w").desc(), "cell_type")
    per = weights.withColumn("_k", F.row_number().over(order)).groupBy("barcode").agg(
        F.max(F.when(F.col("_k") == 1, F.col("w"))).alias("t1"),
        F.coalesce(F.max(F.when(F.col("_k") == 2, F.col("w"))), F.lit(0.0)).alias("t2"),
        F.sum(-F.col("w") * F.log2(F.col("w") + 1e-12)).alias("entropy"),
    )
    held = annotations.select("barcode", "spot_class").join(per, "barcode", "left")
    share = lambda c: 100 * F.avg((F.col("spot_class") == c).cast("double"))
    single = F.col("spot_class") == "singlet"
    return held.agg(
        F.count(F.lit(1)).alias("n_cells"), share("singlet").alias("pct_singlet"),
        (share("doublet_certain") + share("doublet_uncertain")).alias("pct_doublet"),
        share("doublet_certain").alias("pct_doublet_certain"), share("doublet_uncertain").alias("pct_doublet_uncertain"),
        F.avg("t1").alias("mean_max_weight"), F.avg(F.col("t1") - F.col("t2")).alias("mean_top2_gap"),
        F.avg("entropy").alias("mean_entropy"), F.avg(F.when(single, F.col("t1"))).alias("singlet_purity"),
        F.avg(F.when(~single, F.col("t2") / F.col("t1"))).alias("doublet_balance"),
    )


def contribution(weights: DataFrame, umi: DataFrame) -> DataFrame:
    """Share of the fitted counts that each type explains, and the fitted fraction of all counts."""
    fitted = umi.join(weights.select("barcode").distinct(), "barcode", "left_semi")
    total = fitted.agg(F.sum("umi")).scalar()
    return weights.join(umi, "barcode").groupBy("cell_type").agg(
        F.sum(F.col("w") * F.col("umi")).alias("_umi")
    ).withColumn("umi_weighted_contribution", F.col("_umi") / total).drop("_umi").withColumns({"fitted_umi": total, "fitted_umi_fraction": total / umi.agg(F.sum("umi")).scalar()})


def transfer_labels(cells: DataFrame, labels: DataFrame, key: str, label: str, unknown: str = "Unknown") -> DataFrame:
    """Labels by id; cells without one, or with a blank one, are ``Unknown``. Duplicate ids in ``labels`` are an error."""
    copies = labels.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    if not copies.where("_n > 1").isEmpty():
        raise ValueError(f"duplicate {key} in the label table")
    return cells.join(labels.select(key, label), key, "left").withColumn(
        label, F.when(F.trim(F.col(label).cast("string")) != "", F.col(label)).otherwise(F.lit(unknown)))


def lookup_grid(pixels: DataFrame, grid: DataFrame, factor: int = 4) -> DataFrame:
    """Cluster of each pixel from a grid ``factor`` times coarser; 0 where the grid has none."""
    placed = pixels.withColumns({
        "grid_row": F.floor(F.col("row") / factor), "grid_col": F.floor(F.col("col") / factor)})
    return placed.join(grid.select("grid_row", "grid_col", "cluster"), ["grid_row", "grid_col"], "left").withColumn(
        "cluster", F.coalesce("cluster", F.lit(0)))


def roll_up_cells(pixels: DataFrame, pixel_um: float = 2.0) -> DataFrame:
    """Centroid, pixel count and majority cluster per segmented cell; lowest cluster wins a tie.

    Votes are counted per (cell, cluster) first, so a large cell is never gathered in one place.
    """
    middle = lambda c: F.sum(F.col(c) * pixel_um + pixel_um / 2)
    votes = pixels.groupBy("label", "cluster").agg(
        F.count(F.lit(1)).alias("_n"), middle("col").alias("_x"), middle("row").alias("_y"))
    informative = F.col("cluster") > 0
    best = F.max(F.when(informative, F.struct("_n", (-F.col("cluster")).alias("_c"))))
    return votes.groupBy("label").agg(
        (F.sum("_x") / F.sum("_n")).alias("x"), (F.sum("_y") / F.sum("_n")).alias("y"),
        F.sum("_n").alias("segmentation_pixels"), best.alias("_b"),
    ).select(
        "label", "x", "y", "segmentation_pixels",
        F.when(F.col("_b").isNotNull(), F.format_string("RAW_cluster_%02d", (-F.col("_b._c")).cast("long"))).otherwise("Unknown").alias("group"),
        F.coalesce(F.col("_b._n"), F.lit(0)).alias("cluster_vote_pixels"),
        (F.coalesce(F.col("_b._n"), F.lit(0)) / F.col("segmentation_pixels")).alias("cluster_vote_fraction"),
    )
