"""Binned sections as one call: from the files to located counts, and from annotated bins to communication."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellwire.operators import counts as ct
from cellwire.operators.interactions import prepare_interactions
from cellwire.operators.mixtures import bins_as_cells
from cellwire.plans.communication import Settings, communication_records
from cellwire.sources.readers import read_mex, read_positions


def binned_section(
    counts: DataFrame, positions: DataFrame, bin_size: int, target: int | None = None, tissue_only: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(counts, bins) of a section: features of one gene summed, bins summed to ``target`` width, tissue kept.

    ``counts(barcode, gene, n)``, ``positions(barcode, in_tissue, array_row, array_col)``. Tissue is decided on the
    coarse grid, never before the sum. ``bins`` has the centres of the bins that have counts.
    """
    genes, places, width = ct.collapse_genes(counts), positions, bin_size
    if target is not None and target != bin_size:
        genes, places = ct.coarsen(genes, positions, bin_size, target)
        width = target
    return ct.prepare_bins(genes, places, width, tissue_only)


def read_binned_section(
    spark: SparkSession, matrix: str, positions: str, bin_size: int, target: int | None = None,
    keep_ids: DataFrame | None = None, tissue_only: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """``binned_section`` of a sparse matrix folder and a position file; ``keep_ids(feature_id)`` is the feature universe."""
    found = read_mex(spark, matrix, keep_ids=keep_ids)
    return binned_section(found.select("barcode", "gene", "n"), read_positions(spark, positions), bin_size, target, tissue_only)


def bin_communication(
    counts: DataFrame, bins: DataFrame, annotations: DataFrame, weights: DataFrame, lr: DataFrame, complexes: DataFrame | None = None,
    cofactors: DataFrame | None = None, min_weight: float = 0.5, settings: Settings = Settings(), lr_missing: str = "filter",
) -> DataFrame:
    """Communication records between the bins of one dominant type; stale annotations are an error.

    ``lr`` needs lr_index, interaction_name, ligand, receptor and annotation; the dictionaries may be left out.
    """
    expr, cells = bins_as_cells(counts, bins, annotations, weights, min_weight)
    none = counts.sparkSession.createDataFrame([], "name string, member string")
    inter = prepare_interactions(lr, expr.select("gene").distinct(), none if complexes is None else complexes, none if cofactors is None else cofactors, lr_missing)
    return communication_records(expr, cells, inter, settings)
