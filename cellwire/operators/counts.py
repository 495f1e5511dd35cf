"""Binned and per-cell count tables: quality filters, coarsening, regions and audits.

Tables: ``counts(barcode, feature_id, gene, n)`` and
``positions(barcode, array_row, array_col, in_tissue)``. Every position is listed, also those
without a count.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellwire.functions.expressions import barcode_suffix
from cellwire.operators.ranking import quantiles, running

# Names of technical features.
CONTROL_FEATURES = "NegControl|Unassigned|Deprecated"
# Reason labels.
NO_LABEL = "missing_official_annotation"
FEW_COUNTS = "counts_below_threshold"
FEW_FEATURES = "features_below_threshold"


def library_sizes(counts: DataFrame, keys: Sequence[str] = ("barcode",)) -> DataFrame:
    """Total count and number of detected features per barcode."""
    return counts.groupBy(*keys).agg(
        F.sum("n").alias("umi"), F.countDistinct(F.when(F.col("n") > 0, F.col("gene"))).alias("n_genes"))


def cell_quality(
    counts: DataFrame, cells: DataFrame, min_counts: int, min_features: int, label: str = "group"
) -> DataFrame:
    """Counts, features and the joined exclusion reasons of every cell."""
    held = cells.join(library_sizes(counts), "barcode", "left").fillna(0, ["umi", "n_genes"])
    return held.withColumn("exclusion_reason", F.concat_ws(
        ";",
        F.when(F.col(label).isNull(), NO_LABEL),
        F.when(F.col("umi") < min_counts, FEW_COUNTS),
        F.when(F.col("n_genes") < min_features, FEW_FEATURES),
    ))


def filter_library(counts: DataFrame, threshold: float) -> DataFrame:
    """Counts of barcodes whose library exceeds the threshold."""
    kept = counts.groupBy("barcode").agg(F.sum("n").alias("umi")).where(F.col("umi") > threshold)
    return counts.join(kept.select("barcode"), "barcode", "left_semi")


def bin_eligibility(counts: DataFrame, bins: DataFrame, min_umi: int, min_genes: int) -> DataFrame:
    """Whether a bin has enough counts, and the first reason if not."""
    held = bins.select("barcode").join(library_sizes(counts), "barcode", "left").fillna(0, ["umi", "n_genes"])
    reason = (
        F.when(F.col("umi") <= 0, "zero_counts").when(F.col("umi") < min_umi, "low_umi")
        .when(F.col("n_genes") < min_genes, "low_genes")
    )
    return held.withColumn("filter_reason", reason).withColumn("eligible", F.col("filter_reason").isNull())


def in_tissue(counts: DataFrame, positions: DataFrame) -> DataFrame:
    return counts.join(positions.where("in_tissue = 1").select("barcode"), "barcode", "left_semi")


def keep_features(counts: DataFrame, allowed: DataFrame) -> DataFrame:
    """Keep the features of the allowed universe, by id and before any name mapping."""
    return counts.join(allowed.select("feature_id").distinct(), "feature_id", "left_semi")


def unknown_features(allowed: DataFrame, features: DataFrame) -> DataFrame:
    """Allowed ids that the count source does not list; any row is an input error."""
    return allowed.select("feature_id").distinct().join(features.select("feature_id"), "feature_id", "left_anti")


def drop_control_features(counts: DataFrame, column: str = "gene") -> DataFrame:
    return counts.where(~F.col(column).rlike(CONTROL_FEATURES))


def collapse_genes(counts: DataFrame) -> DataFrame:
    """Sum features that share a gene symbol."""
    return counts.groupBy("barcode", "gene").agg(F.sum("n").alias("n"))


def with_coordinates(positions: DataFrame, bin_size: float) -> DataFrame:
    """Bin centres on the array grid."""
    return positions.withColumns({
        "x": (F.col("array_col") + 0.5) * F.lit(float(bin_size)),
        "y": (F.col("array_row") + 0.5) * F.lit(float(bin_size)),
    })


def prepare_bins(counts: DataFrame, positions: DataFrame, bin_size: float, tissue_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """(counts, bins): counts of located bins and the centres of bins that have counts."""
    places = positions.where("in_tissue = 1") if tissue_only else positions
    kept = counts.join(places.select("barcode"), "barcode", "left_semi")
    bins = places.join(counts.select("barcode").distinct(), "barcode", "left_semi")
    return kept, with_coordinates(bins, bin_size)


def coarse_barcode(bin_size: int, factor: int) -> Column:
    return F.format_string(
        f"s_{bin_size:03d}um_%05d_%05d-%s", F.floor(F.col("array_row") / factor),
        F.floor(F.col("array_col") / factor), barcode_suffix(F.col("barcode").cast("string")))


def coarsen(
    counts: DataFrame, positions: DataFrame, bin_size: int, target: int
) -> tuple[DataFrame, DataFrame]:
    """Sum counts into square bins ``target`` wide; (counts, positions) of the coarse grid.

    A coarse bin is in tissue if any source position is, with or without counts. Tissue is never
    filtered before the sum. Barcode suffixes stay apart.
    """
    if target % bin_size:
        raise ValueError("the target bin size must be a multiple of the source bin size")
    factor = target // bin_size
    place = positions.withColumn("_target", coarse_barcode(target, factor))
    link = place.select("barcode", "_target")
    summed = counts.join(link, "barcode").groupBy(F.col("_target").alias("barcode"), "gene").agg(F.sum("n").alias("n"))
    observed = counts.select("barcode").distinct().withColumn("_seen", F.lit(1))
    grid = place.join(observed, "barcode", "left").groupBy(F.col("_target").alias("barcode")).agg(
        F.min(F.floor(F.col("array_row") / factor)).alias("array_row"),
        F.min(F.floor(F.col("array_col") / factor)).alias("array_col"),
        F.max("in_tissue").alias("in_tissue"),
        F.count("_seen").alias("source_bin_count"),
        F.count(F.lit(1)).alias("source_position_count"),
    ).withColumn("source_positions_complete", F.col("source_position_count") == factor * factor)
    return summed, grid


def bin_equivalence(
    left: tuple[DataFrame, DataFrame], right: tuple[DataFrame, DataFrame]
) -> DataFrame:
    """Equality report of two (counts, positions) pairs."""
    a = left[0].select("barcode", "gene", F.col("n").alias("_a"))
    b = right[0].select("barcode", "gene", F.col("n").alias("_b"))
    both = a.join(b, ["barcode", "gene"], "full")
    gap = F.abs(F.coalesce("_a", F.lit(0)) - F.coalesce("_b", F.lit(0)))

    def unmatched(x: DataFrame, y: DataFrame, key: str) -> Column:
        keys = [x.select(key).distinct().withColumn("_x", F.lit(1)), y.select(key).distinct().withColumn("_y", F.lit(1))]
        joined = keys[0].join(keys[1], key, "full")
        return joined.agg(F.count(F.when(F.col("_x").isNull() | F.col("_y").isNull(), 1))).scalar()

    masks = left[1].select("barcode", F.col("in_tissue").alias("_ta")).join(
        right[1].select("barcode", F.col("in_tissue").alias("_tb")), "barcode", "full")
    return both.agg(
        F.max(gap).cast("long").alias("max_count_difference"),
        F.count(F.when(gap > 0, 1)).alias("different_entries"),
    ).withColumns({
        "unmatched_genes": unmatched(left[0], right[0], "gene"),
        "unmatched_barcodes": unmatched(left[0], right[0], "barcode"),
        "mask_differences": masks.agg(F.count(F.when(~F.col("_ta").eqNullSafe(F.col("_tb")), 1))).scalar(),
    })


def region_windows(
    counts: DataFrame,
    positions: DataFrame,
    factor: int,
    rows: int,
    cols: int,
    min_umi: int,
    min_genes: int,
) -> DataFrame:
    """Sums over every window of ``rows`` x ``cols`` blocks that has positions.

    Positions collapse to blocks first; a block then adds to the windows that cover it.
    """
    sizes = library_sizes(counts)
    deep = (F.col("umi") >= min_umi) & (F.col("n_genes") >= min_genes) & (F.col("umi") > 0)
    blocks = positions.join(sizes, "barcode", "left").groupBy(
        F.floor(F.col("array_row") / factor).alias("_r"), F.floor(F.col("array_col") / factor).alias("_c")
    ).agg(
        F.count(F.lit(1)).alias("positions"), F.sum("in_tissue").alias("tissue"),
        F.count("umi").alias("observed"), F.count(F.when(deep, 1)).alias("deep"),
    )
    last = blocks.agg(F.struct(F.max("_r").alias("r"), F.max("_c").alias("c"))).scalar()
    spread = blocks.withColumn("row_start", F.explode(F.sequence(F.col("_r") - (rows - 1), F.col("_r")))) \
        .withColumn("col_start", F.explode(F.sequence(F.col("_c") - (cols - 1), F.col("_c"))))
    inside = spread.where(
        (F.col("row_start") >= 0) & (F.col("col_start") >= 0)
        & (F.col("row_start") <= last["r"] - (rows - 1)) & (F.col("col_start") <= last["c"] - (cols - 1)))
    expected = float(factor * factor * rows * cols)
    return inside.groupBy("row_start", "col_start").agg(
        F.sum("positions").alias("position_count"),
        (F.sum("tissue") / expected).alias("tissue_fraction"),
        (F.sum("observed") / expected).alias("observed_fraction"),
        (F.sum("deep") / expected).alias("depth_fraction"),
    )


def best_regions(
    windows: DataFrame, positions: DataFrame, factor: int, rows: int, cols: int, block_um: float,
    min_tissue: float, min_observed: float, min_depth: float, top: int | None = None,
) -> DataFrame:
    """Windows in order: eligible first, then nearest to the tissue median, deepest, most tissue; ``top`` limits the report."""
    tissue = positions.where("in_tissue = 1")
    middle = lambda c: quantiles(
        tissue.select((F.col(c) / factor).alias("v")), [], "v", [0.5], ["m"]).select("m").scalar()
    eligible = (
        (F.col("position_count") == factor * factor * rows * cols) & (F.col("tissue_fraction") >= min_tissue)
        & (F.col("observed_fraction") >= min_observed) & (F.col("depth_fraction") >= min_depth)
    )
    dr = F.col("row_start") + rows / 2 - middle("array_row")
    dc = F.col("col_start") + cols / 2 - middle("array_col")
    scored = windows.withColumns({"eligible": eligible, "distance_um": F.lit(float(block_um)) * F.sqrt(dr * dr + dc * dc)})
    last = (~F.col("eligible")).cast("long")
    order = [last, F.round("distance_um", 9), -F.col("depth_fraction"), -F.col("tissue_fraction"), F.col("row_start"), F.col("col_start")]
    if top is None:
        near_first = scored.withColumn("_ring", last * F.lit(10 ** 12) + F.floor("distance_um"))
        return running(near_first, [], order, F.lit(1), "rank", "_ring").withColumn("rank", F.col("rank").cast("int")).drop("_ring")
    # Only the top rows meet in this window.
    return scored.orderBy(*order).limit(top).withColumn("rank", F.row_number().over(W.orderBy(*order)))


def crop_region(positions: DataFrame, row_start: int, col_start: int, rows: int, cols: int, factor: int) -> DataFrame:
    """Positions inside a physical rectangle given in blocks of ``factor`` bins; the start may be a column."""
    return positions.where(
        F.col("array_row").between(row_start * factor, (row_start + rows) * factor - 1)
        & F.col("array_col").between(col_start * factor, (col_start + cols) * factor - 1))


def array_coordinates(spots: DataFrame, spot: str = "spot_id") -> DataFrame:
    """Coordinates of a hexagonal array from ids of the form <row>x<col>."""
    part = F.split(spot, "x")
    return spots.withColumns({
        "x": part[0].cast("double") * 0.5 * F.sqrt(F.lit(3.0)) * 100,
        "y": part[1].cast("double") * 0.5 * 100,
    })


def shared_genes(left: DataFrame, right: DataFrame, at_least: int | None = None) -> DataFrame:
    """Genes that both count tables list; fewer than ``at_least`` is an error."""
    both = left.select("gene").intersect(right.select("gene"))
    if at_least is not None and both.limit(at_least).count() < at_least:
        raise ValueError(f"fewer than {at_least} shared genes")
    return both


def shared_gene_audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """Counts inside and outside the shared genes, for both tables."""
    both = shared_genes(left, right).withColumn("_shared", F.lit(True))
    out = both.agg(F.count(F.lit(1)).alias("shared_genes"))
    for side, counts in (("left", left), ("right", right)):
        sums = counts.groupBy("gene").agg(F.sum("n").alias("_n")).join(both, "gene", "left").agg(
            F.struct(F.sum("_n").alias("full"), F.sum(F.when(F.col("_shared"), F.col("_n"))).alias("shared"))).scalar()
        out = out.withColumns({
            f"{side}_umi": sums["full"], f"{side}_shared_umi": sums["shared"],
            f"{side}_nonshared_fraction": (sums["full"] - sums["shared"]) / sums["full"],
        })
    return out


def one_sided(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one side has, tagged by the side."""
    return left.exceptAll(right).withColumn("side", F.lit("left_only")).unionByName(
        right.exceptAll(left).withColumn("side", F.lit("right_only")))


def quality_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """min, p05, p25, median, p75, p95 and max of each column, one row per column."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])).alias("_m")
    ).select("_m.metric", "_m.value")
    return quantiles(long, ["metric"], "value", [0, 0.05, 0.25, 0.5, 0.75, 0.95, 1],
                     ["min", "p05", "p25", "median", "p75", "p95", "max"])
