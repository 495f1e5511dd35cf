"""Communication scores on edges and on group pairs."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwire.functions.expressions import hill, spatial_weight
from cellwire.operators import proximity as near
from cellwire.operators.expression import molecule_levels, scale_by_maximum
from cellwire.operators.graph import location_pairs
from cellwire.operators.interactions import Interactions
from cellwire.operators.ranking import complete_grid

CELL = ["sample_id", "cell_id"]


def simple_interactions(lr: DataFrame, genes: DataFrame) -> DataFrame:
    """Interactions whose ligand and receptor are measured genes, renumbered in order."""
    known = genes.select("gene").distinct()
    return (
        lr.join(known.withColumnRenamed("gene", "ligand"), "ligand", "left_semi")
        .join(known.withColumnRenamed("gene", "receptor"), "receptor", "left_semi")
    )


def _sides(expr: DataFrame, lr: DataFrame, normalize: bool, minimum: float):
    """Supported ligand and receptor values per (cell, interaction)."""
    scaled = scale_by_maximum(expr) if normalize else expr
    kept = scaled.where(F.col("value") > minimum)
    pair = lr.select("lr_index", "ligand", "receptor")
    ligands = kept.join(pair.select("lr_index", F.col("ligand").alias("gene")), "gene")
    receptors = kept.join(pair.select("lr_index", F.col("receptor").alias("gene")), "gene")
    columns = ["sample_id", "cell_id", "lr_index", "value"]
    return ligands.select(*columns), receptors.select(*columns)


def _located(side: DataFrame, cells: DataFrame, prefix: str, extra: Sequence[str] = ()) -> DataFrame:
    columns = [*CELL, *near.axes(cells), "group", *extra]
    joined = side.join(cells.select(*columns), CELL)
    return near.prefixed(joined, prefix, ["sample_id", "lr_index", "contact", "span"])


def scored_edges(
    expr: DataFrame,
    cells: DataFrame,
    lr: DataFrame,
    radius: float,
    weight: str = "binary",
    scale: float | None = None,
    kh: float = 0.5,
    n: float = 1.0,
    normalize: bool = True,
    min_expression: float = 0.0,
    limit: int = near.SENDERS_PER_TILE,
) -> DataFrame:
    """Supported edges of single-gene interactions with their molecular and spatial scores.

    Cells meet inside a tile per interaction, so the edge list is never shuffled.
    """
    ligands, receptors = _sides(expr, lr, normalize, min_expression)
    on, dims = ["sample_id", "lr_index"], near.axes(cells)
    crowded = near.crowded_tiles(
        near.prefixed(cells, "s", ["sample_id"]), ["sample_id"], F.lit(float(radius)), dims, limit)
    pairs = near.near_join(
        _located(ligands, cells, "s"), _located(receptors, cells, "r"), on, radius, dims,
        crowded, ["sample_id"],
    ).where(F.col("s_cell_id") != F.col("r_cell_id"))
    distance = F.sqrt("d2")
    product = F.col("s_value") * F.col("r_value")
    return pairs.withColumns({
        "distance": distance,
        "spatial_weight": spatial_weight(distance, weight, radius / 2 if scale is None else scale),
        "molecular_product": product,
        "hill": hill(product, kh, n),
    }).select(
        "lr_index", "sample_id", F.col("s_cell_id").alias("sender_id"),
        F.col("r_cell_id").alias("receiver_id"), F.col("s_group").alias("sender_group"),
        F.col("r_group").alias("receiver_group"), "distance", "spatial_weight",
        F.col("s_value").alias("ligand_expression"), F.col("r_value").alias("receptor_expression"),
        "molecular_product", "hill", (F.col("hill") * F.col("spatial_weight")).alias("spatial_score"),
    )


def simple_group_scores(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Supported edges, summed Hill response and spatial score per interaction and group pair."""
    return edges.groupBy(*keys, "lr_index", "sender_group", "receiver_group").agg(
        F.count(F.lit(1)).alias("supported_edges"), F.sum("hill").alias("sum_hill"),
        F.sum("spatial_score").alias("sum_spatial_score"),
        F.avg("spatial_score").alias("mean_spatial_score"),
    )


def interaction_diagnostics(
    expr: DataFrame,
    cells: DataFrame,
    lr: DataFrame,
    edges: DataFrame,
    degree: DataFrame,
    normalize: bool = True,
    min_expression: float = 0.0,
) -> DataFrame:
    """Per interaction: supported cells, visited out-edges, supported edges; empty ones included."""
    ligands, receptors = _sides(expr, lr, normalize, min_expression)
    out = ligands.join(degree, CELL).groupBy("lr_index").agg(
        F.count(F.lit(1)).alias("ligand_supported_cells"), F.sum("degree").alias("visited_out_edges"))
    into = receptors.groupBy("lr_index").agg(F.count(F.lit(1)).alias("receptor_supported_cells"))
    made = edges.groupBy("lr_index").agg(F.count(F.lit(1)).alias("supported_edges"))
    total = degree.agg(F.sum("degree")).scalar()
    joined = lr.select("lr_index", "interaction_name", "ligand", "receptor")
    for part in (out, into, made):
        joined = joined.join(part, "lr_index", "left")
    filled = joined.fillna(0, ["ligand_supported_cells", "visited_out_edges",
                               "receptor_supported_cells", "supported_edges"])
    return filled.withColumn("graph_edges", total).withColumn(
        "supported_fraction", F.when(total > 0, F.col("supported_edges") / total).otherwise(F.lit(0.0)))


def group_support(
    cells: DataFrame,
    radius: float,
    keys: Sequence[str] = (),
    same_compartment: bool = False,
    weight: str = "binary",
    scale: float | None = None,
    limit: int = near.SENDERS_PER_TILE,
) -> DataFrame:
    """Edges, summed and mean spatial weight per group pair."""
    pairs = location_pairs(cells, radius, ["group"], same_compartment, limit)
    w = spatial_weight(F.col("distance"), weight, radius / 2 if scale is None else scale)
    return pairs.groupBy(
        *keys, F.col("s_group").alias("sender_group"), F.col("r_group").alias("receiver_group")
    ).agg(F.sum("edges").alias("supported_edges"), F.sum(F.col("edges") * w).alias("sum_spatial_weight")
          ).withColumn("mean_spatial_weight", F.col("sum_spatial_weight") / F.col("supported_edges"))


def group_pair_scores(
    levels: DataFrame, support: DataFrame, keys: Sequence[str] = (), kh: float = 0.5, n: float = 1.0
) -> DataFrame:
    """Molecular probability of every supported pair and interaction with a positive score.

    ``levels`` comes from ``molecule_levels`` on group values with keys ``keys`` + group.
    """
    senders = levels.where("ligand_level > 0").select(
        *keys, "lr_index", F.col("group").alias("sender_group"), "ligand_level",
        F.col("modulator").alias("_ms"))
    receivers = levels.where("receptor_level > 0").select(
        *keys, "lr_index", F.col("group").alias("receiver_group"), "receptor_level",
        F.col("modulator").alias("_mr"))
    shared = [k for k in keys if k in support.columns]
    molecular = hill(F.col("ligand_level") * F.col("receptor_level"), kh, n) * F.col("_ms") * F.col("_mr")
    return (
        support.join(senders, [*shared, "sender_group"])
        .join(receivers, [*keys, "lr_index", "receiver_group"])
        .withColumn("probability", molecular).where("probability > 0")
        .drop("ligand_level", "receptor_level", "_ms", "_mr")
    )


def score_groups(
    group_values: DataFrame,
    support: DataFrame,
    interactions: Interactions,
    keys: Sequence[str] = (),
    kh: float = 0.5,
    n: float = 1.0,
) -> DataFrame:
    """Group-level scores: molecular probability and its spatially weighted variants."""
    levels = molecule_levels(group_values, interactions.members, [*keys, "group"], kh, n)
    scored = group_pair_scores(levels, support, keys, kh, n)
    return scored.join(interactions.lr.select("lr_index", "interaction_name", "ligand", "receptor"), "lr_index").withColumns({
        "mean_weighted_probability": F.col("probability") * F.col("mean_spatial_weight"),
        "sum_weighted_probability": F.col("probability") * F.col("sum_spatial_weight"),
    })


def score_matrix(scores: DataFrame, support: DataFrame, interactions: Interactions) -> DataFrame:
    """Scores of every supported pair and interaction, zeros written out."""
    name = F.concat_ws(
        ":", F.length("sender_group").cast("string"), F.col("sender_group"), F.col("receiver_group"))
    pairs = support.select("sender_group", "receiver_group").withColumn("pair", name)
    grid = complete_grid(pairs, interactions.lr, "pair", "lr_index").join(pairs, "pair")
    return grid.join(
        scores.select("lr_index", "sender_group", "receiver_group", "probability"),
        ["lr_index", "sender_group", "receiver_group"], "left",
    ).select("lr_index", "sender_group", "receiver_group",
             F.coalesce(F.col("probability"), F.lit(0.0)).alias("probability"))


def scores_of_records(scores: DataFrame, records: DataFrame) -> DataFrame:
    """Scores of the requested (interaction, sender, receiver) records only, zeros kept."""
    keys = ["lr_index", "sender_group", "receiver_group"]
    return records.select(*keys).join(scores.select(*keys, "probability"), keys, "left").fillna(
        0.0, ["probability"])
