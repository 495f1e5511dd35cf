"""Expression values: normalisation, group triMeans and per-interaction molecule levels.

Expression is ``expr(sample_id, cell_id, gene, value)`` with positive values only; an absent row
is a zero.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwire.functions.expressions import power
from cellwire.operators.ranking import order_statistics
from cellwire.operators.session import ROWS_PER_TASK, exceeds


def scale_by_maximum(expr: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Divide by the largest value of the whole table, or of each key."""
    top = F.max("value").alias("_max")
    if keys:
        scaled = expr.join(expr.groupBy(*keys).agg(top), list(keys))
    else:
        scaled = expr.withColumn("_max", expr.agg(top).scalar())
    return scaled.withColumn("value", F.col("value") / F.col("_max")).drop("_max")


def log_cp10k(counts: DataFrame, keys: Sequence[str], count: str = "n") -> DataFrame:
    """log1p of counts per ten thousand of the library over all genes."""
    library = counts.groupBy(*keys).agg(F.sum(count).alias("_library"))
    return counts.join(library, list(keys)).withColumn(
        "value", F.log1p(F.lit(1e4) * F.col(count) / F.col("_library"))
    ).drop("_library")


def _quantile(values: Column, n: Column, prob: float) -> Column:
    """Type-7 quantile of sorted positives plus the implied zeros up to ``n`` values."""
    position = (n - 1) * F.lit(prob) + 1
    low = F.floor(position)
    zeros = n - F.size(values)

    def at(rank: Column) -> Column:
        return F.when(rank <= zeros, F.lit(0.0)).otherwise(
            F.element_at(values, F.greatest(rank - zeros, F.lit(1)).cast("int")))

    share = position - low
    return at(low) * (1 - share) + at(F.least(low + 1, n)) * share


def zero_filled_quantiles(
    positives: DataFrame,
    sizes: DataFrame,
    keys: Sequence[str],
    size_keys: Sequence[str],
    probs: Sequence[float],
    names: Sequence[str],
    limit: int = ROWS_PER_TASK,
) -> DataFrame:
    """Exact quantiles per key over the positives and implied zeros.

    ``sizes(size_keys, n)`` is the number of values of each group. Where no group is larger than
    ``limit`` the positives of a group fit one sorted array; else they are ranked in buckets.
    """
    keys, size_keys = list(keys), list(size_keys)
    if exceeds(sizes, "n", limit):
        counted = positives.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("_c"))
        full = counted.select(*keys).distinct()
        full = full.join(sizes, size_keys) if size_keys else full.withColumn("n", sizes.select("n").scalar())
        return order_statistics(counted, keys, "value", "_c", full, probs, names, True)
    lists = positives.groupBy(*keys).agg(F.sort_array(F.collect_list("value")).alias("_v"))
    held = lists.join(sizes, size_keys) if size_keys else lists.withColumn("n", sizes.select("n").scalar())
    return held.select(*keys, *[_quantile(F.col("_v"), F.col("n"), p).alias(a) for p, a in zip(probs, names)])


def group_trimean(
    positives: DataFrame,
    sizes: DataFrame,
    keys: Sequence[str],
    size_keys: Sequence[str],
    limit: int = ROWS_PER_TASK,
) -> DataFrame:
    """TriMean per key; keys whose triMean is zero are left out, like every zero."""
    q = zero_filled_quantiles(positives, sizes, keys, size_keys, [0.25, 0.5, 0.75], ["_a", "_b", "_c"], limit)
    mean = (F.col("_a") + F.col("_b") + F.col("_b") + F.col("_c")) / F.lit(4.0)
    return q.select(*keys, mean.alias("value")).where("value > 0")


def group_sizes(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    return cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def trimean_by_group(
    expr: DataFrame, cells: DataFrame, keys: Sequence[str] = (), limit: int = ROWS_PER_TASK
) -> DataFrame:
    """Gene triMean of every cell group, over all cells of the group."""
    by = [*keys, "group"]
    labelled = expr.join(cells.select("sample_id", "cell_id", "group"), ["sample_id", "cell_id"])
    return group_trimean(labelled, group_sizes(cells, by), [*by, "gene"], by, limit)


def molecule_levels(
    values: DataFrame,
    members: DataFrame,
    keys: Sequence[str],
    kh: float = 0.5,
    n: float = 1.0,
    modulators: bool = True,
) -> DataFrame:
    """Ligand level, effective receptor level and modulator factor per (key, interaction).

    Complexes are geometric means that vanish when a subunit is absent; a measured single gene is
    taken as it is. Coreceptors scale the receptor; agonists and antagonists form ``modulator``.
    """
    v, role = F.col("value"), F.col("role")
    raised, kn = power(v, n), F.lit(float(kh) ** n)
    mine = lambda name: role == name

    def level(name: str) -> Column:
        whole = F.count(F.when(mine(name), 1)) == F.max(F.when(mine(name), F.col("required")))
        single = F.max(F.when(mine(name), F.col("direct")))
        mean = F.exp(F.sum(F.when(mine(name), F.log(v))) / F.max(F.when(mine(name), F.col("required"))))
        return F.when(whole, F.when(single, F.max(F.when(mine(name), v))).otherwise(mean))

    def product(name: str, factor: Column) -> Column:
        return F.coalesce(F.product(F.when(mine(name), factor)), F.lit(1.0))

    modulator = F.lit(1.0)
    if modulators:
        modulator = product("agonist", 1 + raised / (kn + raised)) * product("antagonist", kn / (kn + raised))
    grouped = values.join(members, "gene").groupBy(*keys, "lr_index").agg(
        level("ligand").alias("ligand_level"),
        (level("receptor") * product("co_A_receptor", 1 + v) / product("co_I_receptor", 1 + v)).alias("receptor_level"),
        modulator.alias("modulator"),
    )
    return grouped.where("ligand_level > 0 OR receptor_level > 0")
