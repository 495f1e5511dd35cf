"""Analytic and mixed tests of group-level scores.

The triMean of a random group is approximated through influence functions. An influence function
is a step function of the value with three steps, so only its jumps above the value of a zero
count; sums over the positive rows give all variances and covariances.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwire.functions.tails import exact_binomial_lower, exact_binomial_upper, normal_upper_tail
from cellwire.operators import permutation as pm
from cellwire.operators.expression import group_sizes, scale_by_maximum, trimean_by_group, zero_filled_quantiles
from cellwire.operators.interactions import Interactions
from cellwire.operators.ranking import running, value_bucket
from cellwire.operators.scoring import score_groups
from cellwire.operators.session import ROWS_PER_TASK, exceeds, materialize

CELL = ["sample_id", "cell_id"]
RECORD = ["lr_index", "sender_group", "receiver_group"]
PROBS, SHARES = (0.25, 0.5, 0.75), (0.25, 0.5, 0.25)
EPS = 2.0 ** -52
FALLBACK = "permutation_fallback_required"


def weighted_quantiles(
    rows: DataFrame, keys: Sequence[str], value: str, weight: str, probs: Sequence[float], names: Sequence[str],
    limit: int = ROWS_PER_TASK,
) -> DataFrame:
    """Interpolated quantiles with weights; with equal weights the type-7 quantiles.

    Equal values are merged; the plotting position of a value is the mass left of it over the mass
    of all other values.
    """
    keys = list(keys)
    positive = rows.where((F.col(weight) > 0) & F.col(value).isNotNull())
    spread = positive.groupBy(*keys).agg(
        F.sum(weight).alias("_total"), F.count(F.lit(1)).alias("_n"),
        (F.max(weight) - F.min(weight) <= F.max(weight) * EPS).alias("_equal"))
    merged = positive.groupBy(*keys, value).agg(F.sum(weight).alias("_w"), F.count(F.lit(1)).alias("_c"))
    return _weighted_from_merged(merged, spread, keys, value, probs, names, limit)


def _weighted_from_merged(merged, spread, keys, value, probs, names, limit) -> DataFrame:
    held = merged.join(spread, keys).withColumn("_w", F.col("_w") / F.col("_total"))
    bucket = None
    if exceeds(spread, "_n", limit):
        held, bucket = value_bucket(held, keys, value, "_bucket"), "_bucket"
    held = running(held, keys, [F.col(value)], F.col("_w"), "_mass", bucket)
    held = running(held, keys, [F.col(value)], F.col("_c"), "_last", bucket)
    left = F.greatest(F.col("_mass") - F.col("_w"), F.lit(0.0))
    held = held.withColumns({
        "_x": F.when(F.col("_last") == F.col("_c"), F.lit(0.0)).when(F.col("_last") == F.col("_n"), F.lit(1.0)).otherwise(
            left / F.greatest(F.lit(EPS), 1 - F.col("_w"))),
        "_first": F.col("_last") - F.col("_c") + 1,
    })
    point = F.struct(F.col("_x").alias("x"), F.col(value).alias("v"))
    aggs = []
    for i, p in enumerate(probs):
        rank = (F.col("_n") - 1) * F.lit(float(p)) + 1
        low = F.floor(rank)
        inside = lambda r: (F.col("_first") <= r) & (F.col("_last") >= r)
        aggs += [
            F.max(F.when(F.col("_x") <= p, point)).alias(f"_lo{i}"), F.min(F.when(F.col("_x") > p, point)).alias(f"_hi{i}"),
            F.max(F.when(inside(low), F.col(value))).alias(f"_a{i}"),
            F.max(F.when(inside(F.least(low + 1, F.col("_n"))), F.col(value))).alias(f"_b{i}"), F.max(rank - low).alias(f"_f{i}"),
        ]
    out = held.groupBy(*keys).agg(F.first("_equal").alias("_equal"), *aggs)
    columns = []
    for i, (p, name) in enumerate(zip(probs, names)):
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        share = (F.lit(float(p)) - lo["x"]) / (hi["x"] - lo["x"])
        interpolated = F.when(hi.isNull(), lo["v"]).otherwise(lo["v"] + share * (hi["v"] - lo["v"]))
        plain = F.col(f"_a{i}") * (1 - F.col(f"_f{i}")) + F.col(f"_b{i}") * F.col(f"_f{i}")
        columns.append(F.when(F.col("_equal"), plain).otherwise(interpolated).alias(name))
    return out.select(*keys, *columns)


def _quantile_names(window: float) -> tuple[list[float], list[str]]:
    probs = [*PROBS, *[p - window for p in PROBS], *[p + window for p in PROBS]]
    return probs, [f"q{i}" for i in range(3)] + [f"l{i}" for i in range(3)] + [f"u{i}" for i in range(3)]


def _steps(window: float) -> list[Column]:
    """Height of each jump: triMean weight over the density at the quartile."""
    return [F.lit(s) * (F.col(f"u{i}") - F.col(f"l{i}")) / F.lit(2 * window) for i, s in enumerate(SHARES)]


def _jump(window: float, reached: bool = False) -> Column:
    """Influence of a value: the steps of the quartiles below it, with ``reached`` also of those at it."""
    value = F.col("value")
    parts = [F.when(value >= F.col(f"q{i}") if reached else value > F.col(f"q{i}"), s).otherwise(F.lit(0.0)) for i, s in enumerate(_steps(window))]
    return reduce(lambda a, b: a + b, parts)


def _center() -> Column:
    return reduce(lambda a, b: a + b, [F.lit(s) * F.col(f"q{i}") for i, s in enumerate(SHARES)])


def _gene_reason(window: float, max_zero: float, max_tie: float) -> Column:
    density = [F.lit(2 * window) / (F.col(f"u{i}") - F.col(f"l{i}")) for i in range(3)]
    flat = reduce(lambda a, b: a | b, [(F.col(f"u{i}") <= F.col(f"l{i}")) for i in range(3)])
    unstable = flat | reduce(lambda a, b: a | b, [F.when(~flat, x <= EPS ** 0.5).otherwise(True) for x in density])
    low = reduce(lambda a, b: a | b, [F.col(f"q{i}") <= 0 for i in range(3)])
    tied = reduce(lambda a, b: a | b, [F.col(f"tie{i}") > max_tie for i in range(3)])
    return (
        F.when(F.col("zero_fraction") > max_zero, "excessive_zero_fraction").when(low, "zero_or_invalid_quartile")
        .when(tied, "excessive_quartile_ties").when(unstable, "unstable_quantile_density")
    )


def _single_genes(inter: Interactions) -> DataFrame:
    """Ligand and receptor gene of the interactions without complexes and modulators."""
    simple = inter.lr.where("simple").select("lr_index")
    pick = lambda r: inter.members.where(F.col("role") == r).select("lr_index", F.col("gene").alias(f"{r}_gene"))
    return simple.join(pick("ligand"), "lr_index").join(pick("receptor"), "lr_index")


def _observed(expr: DataFrame, cells: DataFrame, support: DataFrame, inter: Interactions, kh: float, n: float):
    """(scaled values of the referenced genes, group triMeans, active records); each stored once."""
    scaled = materialize(scale_by_maximum(expr).join(inter.members.select("gene").distinct(), "gene", "left_semi"))
    values = materialize(trimean_by_group(scaled, cells))
    scores = score_groups(values, support, inter, (), kh, n)
    return scaled, values, scores.select(*RECORD, "interaction_name", "supported_edges", "probability")


def _with_observed(records: DataFrame, values: DataFrame) -> DataFrame:
    pick = lambda r, g, a: values.select(F.col("gene").alias(f"{r}_gene"), F.col("group").alias(f"{g}_group"), F.col("value").alias(a))
    return records.join(pick("ligand", "sender", "_ol"), ["ligand_gene", "sender_group"], "left").join(
        pick("receptor", "receiver", "_or"), ["receptor_gene", "receiver_group"], "left")


def _finish(held: DataFrame, reason: Column, mode: str, extra: Sequence[str], max_corr: float, min_variance: float, dependence: str) -> DataFrame:
    """Common end of both tests: guards on correlation and variance, z, p, mode and reason."""
    log_variance = (
        F.col("_vl") / (F.col("_cl") * F.col("_cl")) + F.col("_vr") / (F.col("_cr") * F.col("_cr"))
        + 2 * F.col("_vx") / (F.col("_cl") * F.col("_cr"))
    )
    held = held.withColumn("_lv", log_variance).withColumn("_reason", reason)
    strong = F.col("influence_correlation").isNull() | F.isnan("influence_correlation") | (F.abs("influence_correlation") > max_corr)
    why = (
        F.when(F.col("_reason").isNotNull(), F.col("_reason")).when(strong, dependence)
        .when(F.col("_lv").isNull() | F.isnan("_lv") | (F.col("_lv") <= min_variance), "degenerate_delta_variance")
        .when(~F.coalesce((F.col("_ol") > 0) & (F.col("_or") > 0), F.lit(False)), "zero_observed_component")
    )
    z = (F.log("_ol") + F.log("_or") - F.log("_cl") - F.log("_cr")) / F.sqrt("_lv")
    held = held.withColumn("fallback_reason", why)
    ok = F.col("fallback_reason").isNull()
    held = held.withColumns({
        "analytic_z": F.when(ok, z), "analytic_log_sd": F.when(ok, F.sqrt("_lv")),
        "influence_correlation": F.when(F.col("_reason").isNull(), F.col("influence_correlation")),
        "inference_mode": F.when(ok, mode).otherwise(FALLBACK)})
    return held.withColumn("pvalue", normal_upper_tail("analytic_z")).select(
        *RECORD, "interaction_name", "supported_edges", "probability", "pvalue", "analytic_z", "analytic_log_sd",
        "influence_correlation", *extra, "inference_mode", "fallback_reason")


def analytic_test(
    expr: DataFrame, blocks: DataFrame, support: DataFrame, inter: Interactions, kh: float = 0.5, n: float = 1.0,
    min_group_size: int = 30, density_window: float = 0.05, max_tie_fraction: float = 0.1, max_zero_fraction: float = 0.1,
    max_abs_correlation: float = 0.8, min_log_variance: float = 1e-12, limit: int = ROWS_PER_TASK,
) -> DataFrame:
    """Normal approximation under one exchangeable population; reasons where it does not apply."""
    scaled, values, active = _observed(expr, blocks, support, inter, kh, n)
    cells = blocks.count()
    single = _single_genes(inter)
    used = single.select(F.col("ligand_gene").alias("gene")).unionByName(single.select(F.col("receptor_gene").alias("gene"))).distinct()
    rows = scaled.join(used, "gene", "left_semi").select("gene", *CELL, "value")
    probs, names = _quantile_names(density_window)
    total = blocks.agg(F.count(F.lit(1)).alias("n"))
    q = materialize(zero_filled_quantiles(rows, total, ["gene"], [], probs, names, limit))
    jumps = rows.join(q, "gene").withColumn("j", _jump(density_window))
    ties = [(F.count(F.when(F.col("value") == F.col(f"q{i}"), 1)) / float(cells)).alias(f"tie{i}") for i in range(3)]
    stats = jumps.groupBy("gene").agg(
        ((cells - F.count(F.lit(1))) / float(cells)).alias("zero_fraction"), *ties,
        F.sum("j").alias("sj"), F.sum(F.col("j") * F.col("j")).alias("sjj")).join(q, "gene")
    stats = materialize(stats.select(
        "gene", _gene_reason(density_window, max_zero_fraction, max_tie_fraction).alias("reason"), _center().alias("center"),
        "sj", ((F.col("sjj") - F.col("sj") * F.col("sj") / cells) / (cells - 1)).alias("var")))
    pick = lambda r: stats.select(F.col("gene").alias(f"{r}_gene"), *[F.col(c).alias(f"{r}_{c}") for c in ("reason", "center", "sj", "var")])
    side = lambda r: jumps.select(F.col("gene").alias(f"{r}_gene"), *CELL, F.col("j").alias(f"j_{r}")).where(F.col(f"j_{r}") != 0)
    cross = single.join(side("ligand"), "ligand_gene").join(side("receptor"), ["receptor_gene", *CELL]).groupBy("lr_index").agg(
        F.sum(F.col("j_ligand") * F.col("j_receptor")).alias("slr"))
    pairs = single.join(pick("ligand"), "ligand_gene", "left").join(pick("receptor"), "receptor_gene", "left").join(cross, "lr_index", "left")
    cov = (F.coalesce("slr", F.lit(0.0)) - F.col("ligand_sj") * F.col("receptor_sj") / cells) / (cells - 1)
    pairs = pairs.withColumn("cov", cov)
    sizes = group_sizes(blocks, ["group"])
    held = active.join(pairs, "lr_index", "left")
    for side_name in ("sender", "receiver"):
        held = held.join(sizes.select(F.col("group").alias(f"{side_name}_group"), F.col("n").alias(f"_n_{side_name}")), f"{side_name}_group")
    held = _with_observed(held, values).withColumns({
        "_cl": F.col("ligand_center"), "_cr": F.col("receptor_center"),
        "_vl": (1 / F.col("_n_sender") - 1.0 / cells) * F.col("ligand_var"),
        "_vr": (1 / F.col("_n_receiver") - 1.0 / cells) * F.col("receptor_var"),
        "_vx": -F.col("cov") / cells,
        "influence_correlation": F.when((F.col("ligand_var") > 0) & (F.col("receptor_var") > 0),
                                        F.col("cov") / F.sqrt(F.col("ligand_var") * F.col("receptor_var")))})
    several = blocks.select("block_id").distinct().limit(2).count() > 1
    reason = (
        F.when(F.lit(several), "spatially_stratified_null").when(F.col("ligand_gene").isNull(), "non_simple_lr")
        .when(F.col("sender_group") == F.col("receiver_group"), "autocrine_pair")
        .when((F.col("_n_sender") < min_group_size) | (F.col("_n_receiver") < min_group_size), "small_group")
        .when(F.col("ligand_reason").isNotNull(), F.concat(F.lit("ligand_"), "ligand_reason"))
        .when(F.col("receptor_reason").isNotNull(), F.concat(F.lit("receptor_"), "receptor_reason"))
    )
    return _finish(held, reason, "experimental_analytic", [], max_abs_correlation, min_log_variance, "strong_ligand_receptor_dependence")


def stratified_analytic_test(
    expr: DataFrame, blocks: DataFrame, support: DataFrame, inter: Interactions, kh: float = 0.5, n: float = 1.0,
    min_group_size: int = 30, min_shared_blocks: int = 5, density_window: float = 0.05, max_tie_fraction: float = 0.1,
    max_zero_fraction: float = 0.1, max_abs_correlation: float = 0.8, min_log_variance: float = 1e-12,
    limit: int = ROWS_PER_TASK,
) -> DataFrame:
    """Normal approximation under permutation inside blocks, with block-wise finite populations."""
    scaled, values, active = _observed(expr, blocks, support, inter, kh, n)
    single = _single_genes(inter)
    block_sizes = group_sizes(blocks, ["block_id"]).withColumnRenamed("n", "nb")
    groups = group_sizes(blocks, ["group"]).withColumnRenamed("n", "ng")
    tally = materialize(
        blocks.groupBy("block_id", "group").agg(F.count(F.lit(1)).alias("c")).join(block_sizes, "block_id").join(groups, "group")
        .withColumn("w", F.col("c") / F.col("nb") / F.col("ng")))
    sides = {}
    for s in ("sender", "receiver"):
        sides[s] = tally.select("block_id", "nb", F.col("group").alias(f"{s}_group"), F.col("c").alias(f"c_{s}"), F.col("ng").alias(f"n_{s}"))
    shared = sides["sender"].where("nb > 1").join(sides["receiver"].drop("nb"), "block_id").groupBy(
        "sender_group", "receiver_group").agg(F.count(F.lit(1)).alias("shared_blocks"))
    held = active.join(single, "lr_index", "left").join(shared, ["sender_group", "receiver_group"], "left").fillna(0, ["shared_blocks"])
    for s in ("sender", "receiver"):
        held = held.join(groups.select(F.col("group").alias(f"{s}_group"), F.col("ng").alias(f"_n_{s}")), f"{s}_group")
    screen = (
        F.when(F.col("ligand_gene").isNull(), "non_simple_lr").when(F.col("sender_group") == F.col("receiver_group"), "autocrine_pair")
        .when((F.col("_n_sender") < min_group_size) | (F.col("_n_receiver") < min_group_size), "small_group")
        .when(F.col("shared_blocks") < min_shared_blocks, "insufficient_shared_blocks")
    )
    held = materialize(held.withColumn("_screen", screen))
    open_records = held.where("_screen IS NULL")
    wanted = open_records.select(F.col("ligand_gene").alias("gene"), F.col("sender_group").alias("group")).unionByName(
        open_records.select(F.col("receptor_gene").alias("gene"), F.col("receiver_group").alias("group"))).distinct()
    placed = materialize(scaled.join(blocks.select(*CELL, "block_id"), CELL).select("gene", *CELL, "block_id", "value"))
    # Weighted quantiles per (gene, group): positives with their weights and one row for the zeros.
    parts = tally.groupBy("group").agg(
        F.sum("nb").alias("_n"), (F.max("w") - F.min("w") <= F.max("w") * EPS).alias("_equal"), F.lit(1.0).alias("_total"))
    positive = placed.join(wanted, "gene").join(tally.select("block_id", "group", "w"), ["block_id", "group"]).groupBy(
        "gene", "group", "value").agg(F.sum("w").alias("_w"), F.count(F.lit(1)).alias("_c"))
    zeros = wanted.join(positive.groupBy("gene", "group").agg(F.sum("_w").alias("_pw"), F.sum("_c").alias("_pc")), ["gene", "group"], "left").join(
        parts.select("group", "_n"), "group").select(
        "gene", "group", F.lit(0.0).alias("value"), (1 - F.coalesce("_pw", F.lit(0.0))).alias("_w"), (F.col("_n") - F.coalesce("_pc", F.lit(0))).alias("_c")).where("_c > 0")
    merged = materialize(positive.unionByName(zeros))
    spread = wanted.join(parts, "group")
    probs, names = _quantile_names(density_window)
    q = _weighted_from_merged(merged, spread, ["gene", "group"], "value", probs, names, limit)
    ties = [F.coalesce(F.sum(F.when(F.col("value") == F.col(f"q{i}"), F.col("_w"))), F.lit(0.0)).alias(f"tie{i}") for i in range(3)]
    q = materialize(q)
    checked = merged.join(q, ["gene", "group"]).groupBy("gene", "group").agg(
        F.coalesce(F.sum(F.when(F.col("value") == 0, F.col("_w"))), F.lit(0.0)).alias("zero_fraction"), *ties).join(q, ["gene", "group"])
    checked = materialize(checked.select("gene", "group", _gene_reason(density_window, max_zero_fraction, max_tie_fraction).alias("reason"),
                                         _center().alias("center"), *names))
    # A value counts only by how many quartiles of its gene lie below it. These codes, one per cell and gene whatever the
    # number of groups, are counted per block, alone and jointly for the two genes of an interaction.
    usable = checked.where("reason IS NULL")
    cuts = usable.groupBy("gene").agg(F.collect_set("q0").alias("a"), F.collect_set("q1").alias("b"), F.collect_set("q2").alias("c")).select(
        "gene", F.array_sort(F.array_union(F.array_union("a", "b"), "c")).alias("cuts"))
    coded = placed.join(cuts, "gene").withColumn("code", F.size(F.filter("cuts", lambda t: t < F.col("value")))).where("code > 0")
    coded = materialize(coded.select("gene", *CELL, "block_id", "code"))
    heights = usable.join(cuts, "gene").select("*", F.posexplode("cuts").alias("_p", "value")).select(
        "gene", "group", (F.col("_p") + 1).alias("code"), _jump(density_window, reached=True).alias("j")).where("j != 0")
    heights = materialize(heights)
    counts = coded.groupBy("gene", "block_id", "code").agg(F.count(F.lit(1)).alias("k"))
    per_block = materialize(counts.join(heights, ["gene", "code"]).groupBy("gene", "group", "block_id").agg(
        F.sum(F.col("k") * F.col("j")).alias("sj"), F.sum(F.col("k") * F.col("j") * F.col("j")).alias("sjj")).join(block_sizes, "block_id"))
    within = F.col("sjj") - F.col("sj") * F.col("sj") / F.col("nb")
    counted = per_block.join(tally.select("block_id", "group", "c", "ng"), ["block_id", "group"], "left")
    inner = (F.col("nb") > 1) & (F.col("c") > 0) & (F.col("c") < F.col("nb"))
    spread_stats = counted.groupBy("gene", "group").agg(
        F.sum(within).alias("resid"),
        F.coalesce(F.sum(F.when(inner, F.col("c") * (1 - F.col("c") / F.col("nb")) * within / (F.col("nb") - 1) / (F.col("ng") * F.col("ng")))), F.lit(0.0)).alias("var"))
    table = checked.select("gene", "group", "reason", "center").join(spread_stats, ["gene", "group"], "left").fillna(0.0, ["resid", "var"])

    def pick(role: str, side: str) -> DataFrame:
        return table.select(F.col("gene").alias(f"{role}_gene"), F.col("group").alias(f"{side}_group"),
                            *[F.col(c).alias(f"{role}_{c}") for c in ("reason", "center", "resid", "var")])

    held = held.join(pick("ligand", "sender"), ["ligand_gene", "sender_group"], "left").join(pick("receptor", "receiver"), ["receptor_gene", "receiver_group"], "left")
    ready = held.where("_screen IS NULL AND ligand_reason IS NULL AND receptor_reason IS NULL").select(*RECORD, "ligand_gene", "receptor_gene")
    keys = [*RECORD, "block_id"]
    side = lambda role, name: coded.select(F.col("gene").alias(f"{role}_gene"), *CELL, "block_id", F.col("code").alias(name))
    pairs = ready.select("lr_index", "ligand_gene", "receptor_gene").distinct()
    joint = pairs.join(side("ligand", "lc"), "ligand_gene").join(side("receptor", "rc").drop("block_id"), ["receptor_gene", *CELL]).groupBy(
        "lr_index", "ligand_gene", "receptor_gene", "block_id", "lc", "rc").agg(F.count(F.lit(1)).alias("k"))
    tall = lambda role, code, group, name: heights.select(
        F.col("gene").alias(f"{role}_gene"), F.col("code").alias(code), F.col("group").alias(group), F.col("j").alias(name))
    half = joint.join(tall("ligand", "lc", "sender_group", "jl"), ["ligand_gene", "lc"]).groupBy(
        "lr_index", "receptor_gene", "block_id", "rc", "sender_group").agg(F.sum(F.col("k") * F.col("jl")).alias("kl"))
    products = half.join(tall("receptor", "rc", "receiver_group", "jr"), ["receptor_gene", "rc"]).groupBy(*keys).agg(
        F.sum(F.col("kl") * F.col("jr")).alias("slr")).join(ready.select(*RECORD), RECORD, "left_semi")
    bl = per_block.select(F.col("gene").alias("ligand_gene"), F.col("group").alias("sender_group"), "block_id", "nb", F.col("sj").alias("sl"))
    br = per_block.select(F.col("gene").alias("receptor_gene"), F.col("group").alias("receiver_group"), "block_id", F.col("sj").alias("sr"))
    means = ready.join(bl, ["ligand_gene", "sender_group"]).join(br, ["receptor_gene", "receiver_group", "block_id"])
    joint = means.join(products, keys, "left").join(sides["sender"].drop("nb"), ["block_id", "sender_group"], "left").join(
        sides["receiver"].drop("nb"), ["block_id", "receiver_group"], "left")
    moved = F.coalesce("slr", F.lit(0.0)) - F.col("sl") * F.col("sr") / F.col("nb")
    both = (F.col("nb") > 1) & (F.col("c_sender") > 0) & (F.col("c_receiver") > 0)
    cross = joint.groupBy(*RECORD).agg(
        F.sum(moved).alias("_resid"),
        F.sum(F.when(both, -F.col("c_sender") * F.col("c_receiver") / F.col("nb") * moved / (F.col("nb") - 1) / (F.col("n_sender") * F.col("n_receiver")))).alias("_vx"))
    held = held.join(cross, RECORD, "left").fillna(0.0, ["_resid", "_vx"])
    held = _with_observed(held, values).withColumns({
        "_cl": F.col("ligand_center"), "_cr": F.col("receptor_center"), "_vl": F.col("ligand_var"), "_vr": F.col("receptor_var"),
        "influence_correlation": F.when((F.col("ligand_resid") > 0) & (F.col("receptor_resid") > 0),
                                        F.col("_resid") / F.sqrt(F.col("ligand_resid") * F.col("receptor_resid")))})
    reason = (
        F.when(F.col("_screen").isNotNull(), F.col("_screen"))
        .when(F.col("ligand_reason").isNotNull(), F.concat(F.lit("ligand_"), "ligand_reason"))
        .when(F.col("receptor_reason").isNotNull(), F.concat(F.lit("receptor_"), "receptor_reason"))
    )
    return _finish(held, reason, "experimental_stratified_analytic", ["shared_blocks"], max_abs_correlation, min_log_variance,
                   "strong_block_residual_ligand_receptor_dependence")


def hybrid_test(
    expr: DataFrame, blocks: DataFrame, support: DataFrame, inter: Interactions, n_perm: int = 999, seed: int = 1,
    alpha: float = 0.05, screening_margin: float = 0.01, tail: str = "greater_equal", finite_correction: bool = True,
    kh: float = 0.5, n: float = 1.0, **options,
) -> DataFrame:
    """Analytic screen: clearly large p values become 1, every other record is permuted."""
    if not 0 < alpha < 1 or screening_margin < 0 or alpha + screening_margin >= 1:
        raise ValueError("alpha and alpha + screening_margin must lie in (0, 1)")
    first = materialize(stratified_analytic_test(expr, blocks, support, inter, kh, n, **options))
    eligible = F.col("inference_mode") == "experimental_stratified_analytic"
    screened = F.coalesce(eligible & (F.col("pvalue") > alpha + screening_margin), F.lit(False))
    marked = first.withColumn("_screened", screened)
    todo = marked.where("NOT _screened").select(*RECORD)
    tested = pm.block_permutation_test(
        expr, blocks, support, inter, n_perm, seed, kh, n, todo, tail, finite_correction
    ).select(*RECORD, "n_reject", F.col("pvalue").alias("_p"))
    held = marked.join(tested, RECORD, "left")
    mode = (
        F.when(F.col("_screened"), "experimental_hybrid_screened_nonsignificant")
        .when(eligible, "experimental_hybrid_permutation_candidate").otherwise("experimental_hybrid_permutation_fallback")
    )
    return held.withColumns({
        "analytic_pvalue": F.col("pvalue"), "pvalue": F.when(F.col("_screened"), F.lit(1.0)).otherwise(F.col("_p")),
        "permutation_confirmed": ~F.col("_screened"), "inference_mode": mode}).drop("_screened", "_p")


def adaptive_test(
    expr: DataFrame, blocks: DataFrame, support: DataFrame, inter: Interactions, min_permutations: int = 100,
    batch_size: int = 100, max_permutations: int = 1000, seed: int = 1, alpha: float = 0.05, confidence: float = 0.99,
    tail: str = "greater_equal", kh: float = 0.5, n: float = 1.0,
) -> DataFrame:
    """Permutation in batches; a record stops once its interval for p excludes ``alpha``.

    Every batch is one job over the records that are still open; the state is one row per record.
    """
    if max_permutations < min_permutations or min(min_permutations, batch_size) < 1 or not 0 < alpha < 1 or not 0 < confidence < 1:
        raise ValueError("invalid permutation limits, alpha or confidence")
    batches = -(-max_permutations // batch_size) + 1
    level = F.lit(1 - (1 - confidence) / batches)
    done, opened, closed = 0, None, None
    while done < max_permutations:
        size = min(batch_size, max_permutations - done)
        result = pm.block_permutation_test(
            expr, blocks, support, inter, size, seed, kh, n, opened, tail, first=done + 1)
        state = result.select(*RECORD, "probability", "n_reject")
        if opened is not None:
            before = opened.select(*RECORD, F.col("n_reject").alias("_before"))
            state = state.join(before, RECORD).withColumn("n_reject", F.col("n_reject") + F.col("_before")).drop("_before")
        done += size
        used = F.lit(float(done))
        state = state.withColumn("permutations_used", F.lit(done))
        if done >= min_permutations:
            shift = lambda bound: (bound * used + 1) / (used + 1)
            hits = F.col("n_reject").cast("double")
            state = state.withColumns({
                "pvalue_lower": shift(exact_binomial_lower(hits, used, level)),
                "pvalue_upper": shift(exact_binomial_upper(hits, used, level))})
        else:
            state = state.withColumns({"pvalue_lower": F.lit(None).cast("double"), "pvalue_upper": F.lit(None).cast("double")})
        reason = F.when(F.col("pvalue_upper") <= alpha, "pvalue_upper_at_or_below_alpha").when(
            F.col("pvalue_lower") > alpha, "pvalue_lower_above_alpha")
        if done >= max_permutations:
            reason = reason.otherwise("max_permutations")
        state = materialize(state.withColumn("stop_reason", reason))
        stopped = state.where("stop_reason IS NOT NULL")
        closed = stopped if closed is None else closed.unionByName(stopped)
        opened = state.where("stop_reason IS NULL").select(*RECORD, "n_reject")
        if opened.isEmpty():
            break
    return closed.withColumns({
        "pvalue": (F.col("n_reject") + 1) / (F.col("permutations_used") + 1),
        "decision": F.when(F.col("pvalue_upper") <= alpha, "significant").otherwise("not_significant")})
