"""Subsets of cells and other top-k or quota selections."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellwire.functions.expressions import hash_order
from cellwire.operators.ranking import quantiles, running
from cellwire.operators.session import ROWS_PER_TASK, exceeds


def _nearest(cells: DataFrame, cx: Column, cy: Column, size: int) -> DataFrame:
    """The ``size`` cells nearest a point; a top-k, so no full sort. Ties go by cell id."""
    d2 = (F.col("x") - cx) * (F.col("x") - cx) + (F.col("y") - cy) * (F.col("y") - cy)
    return cells.withColumn("d2", d2).orderBy(F.round("d2", 9), "cell_id").limit(size)


def central_subset(cells: DataFrame, size: int) -> DataFrame:
    """Cells nearest the mean coordinate."""
    middle = cells.agg(F.struct(F.avg("x").alias("x"), F.avg("y").alias("y"))).scalar()
    return _nearest(cells, middle["x"], middle["y"], size)


def nearest_anchor(cells: DataFrame, x_quantile: float) -> DataFrame:
    """The observed cell closest to (quantile of x, median of y)."""
    x = quantiles(cells, [], "x", [x_quantile], ["q"]).select("q").scalar()
    y = quantiles(cells, [], "y", [0.5], ["q"]).select("q").scalar()
    return _nearest(cells, x, y, 1)


def block_subset(cells: DataFrame, x_quantile: float, size: int) -> DataFrame:
    """Cells nearest the anchor of ``nearest_anchor``."""
    anchor = nearest_anchor(cells, x_quantile).select(F.struct("x", "y").alias("p")).scalar()
    return _nearest(cells, anchor["x"], anchor["y"], size)


def proportional_quotas(cells: DataFrame, size: int, label: str = "group") -> DataFrame:
    """Cells to draw per group: shares rounded down, the rest to the largest remainders."""
    tally = cells.groupBy(label).agg(F.count(F.lit(1)).alias("cells"))
    raw = F.lit(size) * F.col("cells") / tally.agg(F.sum("cells")).scalar()
    held = tally.withColumn("raw_quota", raw).withColumn("_floor", F.floor("raw_quota"))
    left = F.lit(size) - held.agg(F.sum("_floor")).scalar()
    # One row per group.
    order = W.orderBy(F.round(F.col("raw_quota") - F.col("_floor"), 9).desc(), label)
    extra = (F.row_number().over(order) <= left).cast("long")
    return held.withColumn("quota", F.col("_floor") + extra).drop("_floor")


def _hash_ranked(cells: DataFrame, label: str, seed: int, limit: int) -> DataFrame:
    """Position of every cell in the hash order of its group; large groups are cut by the hash."""
    held = cells.withColumn("_h", hash_order(seed, F.col("cell_id")))
    sizes = cells.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    part = None
    if exceeds(sizes, "_n", limit):
        held, part = held.withColumn("_part", F.substring("_h", 1, 3)), "_part"
    return running(held, [label], [F.col("_h"), F.col("cell_id")], F.lit(1), "_rank", part).drop("_h", "_part")


def stratified_sample(
    cells: DataFrame, size: int, seed: int = 1, label: str = "group", limit: int = ROWS_PER_TASK
) -> DataFrame:
    """Sample without replacement with proportional quotas."""
    quotas = proportional_quotas(cells, size, label).select(label, "quota")
    return _hash_ranked(cells, label, seed, limit).join(quotas, label).where("_rank <= quota").drop("_rank", "quota")


def downsample_types(
    cells: DataFrame, min_cells: int, max_cells: int, seed: int = 42, label: str = "group", limit: int = ROWS_PER_TASK
) -> DataFrame:
    """Drop rare types and draw at most ``max_cells`` of each other type; 0 keeps all."""
    kept = cells.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_cells)
    common = cells.join(kept.select(label), label, "left_semi")
    if max_cells <= 0:
        return common
    return _hash_ranked(common, label, seed, limit).where(F.col("_rank") <= max_cells).drop("_rank")


def lump_groups(cells: DataFrame, top: int = 5, label: str = "group", other: str = "Other") -> DataFrame:
    """Label with the most frequent groups and ``Other`` for the rest."""
    first = cells.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), label).limit(top)
    return cells.join(first.select(label, F.lit(True).alias("_top")), label, "left").withColumn(
        "label", F.when(F.col("_top"), F.col(label).cast("string")).otherwise(other)).drop("_top")
