"""Edge-mean communication probability per (sample, interaction, sender group, receiver group).

The plan is built around one distance join of cells: senders and receivers carry the levels of all
their interactions as arrays and meet in spatial tiles keyed by (sample, tile), edges are scored
inside the join stage and partially aggregated to group pairs before the next exchange. The edge list
itself is neither stored nor shuffled.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellwire.functions.expressions import hill
from cellwire.operators import proximity as near
from cellwire.operators.expression import molecule_levels, scale_by_maximum
from cellwire.operators.graph import minimum_distance
from cellwire.operators.interactions import Interactions, mark_contact, order_interactions, prepare_interactions
from cellwire.operators.permutation import exceeds_score, label_codes, permuted_labels
from cellwire.operators.replicates import Scores, sums_of_sides
from cellwire.operators.session import materialize

CELL = ["sample_id", "cell_id"]
PAIR = ["sample_id", "lr_index", "sender_group", "receiver_group"]


@dataclass(frozen=True)
class Settings:
    """Parameters of the analysis; distances are in micrometres, coordinates times ``ratio``."""

    ratio: float = 1.0
    tol: float = 5.0
    interaction_range: float = 250.0
    scale_distance: float = 0.01
    contact_range: float = 10.0
    kh: float = 0.5
    n: float = 1.0
    use_modulators: bool = True
    contact_dependent: bool = True
    contact_forced: bool = False
    min_percent: float = 0.1
    min_cells: int = 5
    percent_filter: str = "numeric"
    n_perm: int = 0
    seed: int = 1
    # Pairs carry all interactions and replicates, so a task holds fewer senders than in a plain join.
    tile_limit: int = near.SENDERS_PER_TILE // 8

    def __post_init__(self):
        if not 0 <= self.min_percent <= 1:
            raise ValueError("min_percent must lie between 0 and 1")
        if min(self.ratio, self.kh, self.n, self.scale_distance) <= 0 or self.min_cells < 1:
            raise ValueError("ratio, kh, n, scale_distance and min_cells must be positive")
        if self.percent_filter not in ("numeric", "legacy"):
            raise ValueError(f"unknown percent filter: {self.percent_filter}")

    @property
    def radius(self) -> float:
        return (self.interaction_range + self.tol) / self.ratio

    @property
    def contact_radius(self) -> float:
        return min((self.contact_range + self.tol) / self.ratio, self.radius)


def legacy_percent_strings(fractions: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """Fractions as text with one significant digit for the smallest, one format per key.

    All values of a key share the number of decimals that the smallest non-zero value needs; when
    that fixed form is wider than the scientific one, all are scientific.
    """
    v = F.col(column)
    exponent = F.floor(F.log10(v))
    digit = F.rint(v / F.pow(F.lit(10.0), exponent))
    exponent = F.when(digit >= 10, exponent + 1).otherwise(exponent)
    digit = F.when(digit >= 10, F.lit(1.0)).otherwise(digit)
    whole = W.partitionBy(*keys)
    decimals = F.coalesce(F.max(F.when(v > 0, F.greatest(-exponent, F.lit(0)))).over(whole), F.lit(0)).cast("int")
    out = fractions.withColumn("_d", decimals)
    fixed = F.expr(f"format_number({column}, _d)")
    scientific = F.when(v > 0, F.format_string(
        "%.0fe%s%02d", digit, F.when(exponent < 0, "-").otherwise("+"), F.abs(exponent))).otherwise("0e+00")
    return out.withColumn(name, F.when(F.col("_d") > 3, scientific).otherwise(fixed)).drop("_d")


def _levels(expr: DataFrame, cells: DataFrame, inter: Interactions, s: Settings) -> DataFrame:
    """Molecule levels with the interaction's reach, one row per (cell, interaction).

    Stored once: the arrays of both sides, self edges and the percent filter each read a few columns.
    """
    scaled = scale_by_maximum(expr, ["sample_id"])
    levels = molecule_levels(scaled, inter.members, CELL, s.kh, s.n, s.use_modulators)
    lr = mark_contact(inter.lr, s.contact_dependent, s.contact_forced).select("lr_index", "contact")
    reach = F.when(F.col("contact"), F.lit(s.contact_radius)).otherwise(F.lit(s.radius))
    return materialize(levels.join(lr, "lr_index").select(*levels.columns, reach.alias("span")))


def _side(levels: DataFrame, places: DataFrame, side: str, level: str) -> DataFrame:
    """One row per cell with arrays of its interactions: which, level, modulator and reach."""
    held = levels.where(F.col(level) > 0).groupBy(*CELL).agg(
        F.sort_array(F.collect_list(F.struct("lr_index", F.col(level).alias("level"), "modulator", "span"))).alias("of"))
    arrays = [F.col("of")[c].alias(c) for c in ("lr_index", "level", "modulator", "span")]
    names = [c for c in places.columns if c not in CELL]
    return near.prefixed(held.join(places, CELL).select(*CELL, *names, *arrays), side, ["sample_id"])


def _pairs(
    levels: DataFrame, cells: DataFrame, s: Settings, label: str, limit: int, meet: near.Meet | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """Cells with levels that are neighbours, or what ``meet`` makes of them, and the crowded tiles."""
    dims = near.axes(cells)
    places = cells.select(*CELL, *dims, label)
    senders, receivers = _side(levels, places, "s", "ligand_level"), _side(levels, places, "r", "receptor_level")
    points = near.prefixed(cells.select("sample_id", "cell_id", *dims), "s", ["sample_id"])
    crowded = near.crowded_tiles(points, ["sample_id"], F.lit(s.radius), dims, limit)
    return near.strict_near_join(
        senders, receivers, points, ["sample_id"], s.radius, dims, ["sample_id"], crowded, limit, meet), crowded


def _probability(s: Settings, weight: Column, left: Column, right: Column, modulators: Column) -> Column:
    return hill(left * right, s.kh, s.n) * weight * modulators


def _scored(terms: DataFrame) -> DataFrame:
    return terms.where((F.col("p") > 0) & (F.col("p") < float("inf")))


def _edge_terms(levels: DataFrame, cells: DataFrame, s: Settings, label: str) -> DataFrame:
    """Scored edges as (sample, interaction, both labels, probability), self edges included.

    Cells meet once, whatever the number of interactions: each side carries an array per cell, and the interactions
    of a pair are those of the sender that the receiver has too.
    """
    pairs, crowded = _pairs(levels, cells, s, label, s.tile_limit)

    weight = 1.0 / (F.sqrt("d2") * F.lit(s.ratio) * F.lit(s.scale_distance))
    both = F.arrays_zip("s_lr_index", "s_level", "s_modulator", "s_span")
    met = pairs.where(F.arrays_overlap("s_lr_index", "r_lr_index")).select(
        "sample_id", f"s_{label}", f"r_{label}", "d2", "r_lr_index", "r_level", "r_modulator", F.explode(both).alias("e"))
    spot = F.array_position("r_lr_index", F.col("e.s_lr_index")).cast("int")
    met = met.withColumn("_at", spot).where((F.col("_at") > 0) & (F.sqrt("d2") <= F.col("e.s_span")))
    mine = lambda c: F.element_at(c, F.col("_at"))
    edges = met.select(
        "sample_id", F.col("e.s_lr_index").alias("lr_index"), f"s_{label}", f"r_{label}",
        _probability(s, weight, F.col("e.s_level"), mine("r_level"), F.col("e.s_modulator") * mine("r_modulator")).alias("p"))
    return _scored(edges.unionByName(_self_terms(levels, cells, s, label, crowded)))


def _self_terms(levels: DataFrame, cells: DataFrame, s: Settings, label: str, crowded: DataFrame | None) -> DataFrame:
    """Every cell that has both sides of an interaction, as an edge of the smallest distance of its sample."""
    nearest = minimum_distance(cells, s.radius, None if crowded is None else s.tile_limit)
    own = levels.where("ligand_level > 0 AND receptor_level > 0").join(nearest, "sample_id").join(cells.select(*CELL, label), CELL)
    self_weight = 1.0 / (F.col("min_distance") * F.lit(s.ratio) * F.lit(s.scale_distance))
    return own.select(
        "sample_id", "lr_index", F.col(label).alias(f"s_{label}"), F.col(label).alias(f"r_{label}"),
        _probability(s, self_weight, F.col("ligand_level"), F.col("receptor_level"), F.col("modulator") * F.col("modulator")).alias("p"))


def _replicate_sums(levels: DataFrame, cells: DataFrame, s: Settings, labels: int) -> DataFrame:
    """Sum and number of scored edges per interaction, replicate and pair of label codes.

    Edges never become rows: the cells of a tile meet as arrays, which takes four times the senders in one task.
    """
    dims = near.axes(cells)
    rule = Scores(s.radius, s.ratio, s.scale_distance, s.kh, s.n, labels)
    sums, crowded = _pairs(
        levels, cells, s, "labels", 4 * s.tile_limit, lambda left, right, keys: sums_of_sides(left, right, keys, dims, rule))
    both = F.posexplode(F.arrays_zip("s_labels", "r_labels")).alias("b", "_g")
    selves = _scored(_self_terms(levels, cells, s, "labels", crowded)).select("sample_id", "lr_index", "p", both).select(
        "sample_id", "lr_index", "b", F.col("_g.s_labels").alias("sender_group"), F.col("_g.r_labels").alias("receiver_group"),
        F.col("p").alias("total"), F.lit(1).cast("long").alias("active_edges"))
    return sums.unionByName(selves).groupBy("sample_id", "lr_index", "b", "sender_group", "receiver_group").agg(
        F.sum("total").alias("total"), F.sum("active_edges").alias("active_edges")).select(
        "sample_id", "lr_index", "b", "sender_group", "receiver_group",
        (F.col("total") / F.col("active_edges")).alias("probability"), "active_edges")


def _percent_mask(levels: DataFrame, cells: DataFrame, s: Settings, keys: list[str]) -> DataFrame:
    """Group fractions with positive ligand and receptor, and whether they pass (``ok_s``, ``ok_r``)."""
    label = "labels" if keys else "group"
    placed = levels.select("sample_id", "cell_id", "lr_index", "ligand_level", "receptor_level").join(cells.select(*CELL, label), CELL)
    given = F.posexplode("labels").alias("b", "g") if keys else F.col("group").alias("g")
    spread = placed.select("sample_id", "lr_index", "ligand_level", "receptor_level", given)
    true = F.col("labels")[0] if keys else F.col("group")
    sizes = cells.groupBy("sample_id", true.alias("g")).agg(F.count(F.lit(1)).alias("_size"))
    positive = spread.groupBy("sample_id", "lr_index", *keys, "g").agg(
        F.count(F.when(F.col("ligand_level") > 0, 1)).alias("_l"),
        F.count(F.when(F.col("receptor_level") > 0, 1)).alias("_r"),
    ).join(sizes, ["sample_id", "g"])
    shares = positive.withColumn("_fl", F.col("_l") / F.col("_size")).withColumn("_fr", F.col("_r") / F.col("_size"))
    if s.percent_filter == "numeric":
        ok = {"ok_s": F.col("_fl") >= s.min_percent, "ok_r": F.col("_fr") >= s.min_percent}
    else:
        by = ["sample_id", "lr_index", *keys]
        shares = legacy_percent_strings(legacy_percent_strings(shares, by, "_fl", "_tl"), by, "_fr", "_tr")
        threshold = repr(float(s.min_percent))
        threshold = threshold[:-2] if threshold.endswith(".0") else threshold
        ok = {"ok_s": F.col("_tl") >= threshold, "ok_r": F.col("_tr") >= threshold}
    return shares.withColumns(ok).select("sample_id", "lr_index", *keys, "g", "ok_s", "ok_r")


def _filtered(sums: DataFrame, levels: DataFrame, cells: DataFrame, s: Settings, keys: list[str]) -> DataFrame:
    """Apply both group filters to aggregated pairs."""
    by = ["sample_id", "lr_index", *keys]
    links = sums.withColumn(
        "_out", F.sum("active_edges").over(W.partitionBy(*by, "sender_group"))
    ).withColumn("_in", F.sum("active_edges").over(W.partitionBy(*by, "receiver_group")))
    kept = links.where((F.col("_out") >= s.min_cells) & (F.col("_in") >= s.min_cells)).drop("_out", "_in")
    if s.min_percent == 0:
        return kept
    mask = _percent_mask(levels, cells, s, keys)
    send = mask.where("ok_s").select(*by, F.col("g").alias("sender_group"))
    take = mask.where("ok_r").select(*by, F.col("g").alias("receiver_group"))
    return kept.join(send, [*by, "sender_group"], "left_semi").join(take, [*by, "receiver_group"], "left_semi")


def communication_records(
    expr: DataFrame, cells: DataFrame, interactions: Interactions, settings: Settings = Settings()
) -> DataFrame:
    """Probability, p value and active edges of every group pair that passes the filters.

    Samples are independent sections. With ``n_perm`` the group labels are permuted within each
    sample while edges and edge scores stay fixed.
    """
    s = settings
    if s.n_perm == 0:
        levels = _levels(expr, cells, interactions, s)
        terms = _edge_terms(levels, cells, s, "group")
        sums = terms.groupBy(
            "sample_id", "lr_index", F.col("s_group").alias("sender_group"), F.col("r_group").alias("receiver_group")
        ).agg(F.avg("p").alias("probability"), F.count(F.lit(1)).alias("active_edges"))
        records = _filtered(sums, levels, cells, s, []).withColumn("pvalue", F.lit(None).cast("double"))
    else:
        codes = materialize(label_codes(cells))
        labelled = materialize(permuted_labels(cells, ["sample_id"], s.n_perm, s.seed, codes=codes))
        levels = _levels(expr, cells, interactions, s)
        sums = _replicate_sums(levels, labelled, s, codes.count())
        kept = _filtered(sums, levels, labelled, s, ["b"])
        whole = W.partitionBy(*PAIR)
        observed = F.max(F.when(F.col("b") == 0, F.col("probability"))).over(whole)
        exceeding = (F.col("b") > 0) & exceeds_score(F.col("probability"), F.col("_obs"))
        records = kept.withColumn("_obs", observed).where(F.col("_obs").isNotNull()).groupBy(*PAIR).agg(
            F.max("_obs").alias("probability"),
            F.max(F.when(F.col("b") == 0, F.col("active_edges"))).alias("active_edges"),
            (F.count(F.when(exceeding, 1)) / float(s.n_perm)).alias("pvalue"),
        )
        for side in ("sender_group", "receiver_group"):
            named = codes.select(F.col("code").alias(side), F.col("group").alias("_name"))
            records = records.join(named, side).withColumn(side, F.col("_name")).drop("_name")
    names = interactions.lr.select("lr_index", "interaction_name", "ligand", "receptor")
    return records.join(names, "lr_index").select(
        "sample_id", "lr_index", "interaction_name", "ligand", "receptor",
        "sender_group", "receiver_group", "probability", "pvalue", "active_edges")


def communication(
    expr: DataFrame,
    cells: DataFrame,
    lr: DataFrame,
    complexes: DataFrame,
    cofactors: DataFrame,
    genes: DataFrame | None = None,
    settings: Settings = Settings(),
    lr_missing: str = "error",
) -> DataFrame:
    """Resolve the interaction table and score it; ``genes`` defaults to those with a value."""
    measured = genes if genes is not None else expr.select("gene").distinct()
    inter = prepare_interactions(lr, measured, complexes, cofactors, lr_missing)
    inter = prepare_interactions(order_interactions(inter.lr).drop(
        "has_agonist", "has_antagonist", "simple"), measured, complexes, cofactors, "filter")
    return communication_records(expr, cells, inter, settings)


def active_edges_per_interaction(
    expr: DataFrame, cells: DataFrame, interactions: Interactions, settings: Settings = Settings()
) -> DataFrame:
    """Active edges per interaction with the minimum distance and self weight of the sample."""
    s = settings
    levels = _levels(expr, cells, interactions, s)
    counts = _edge_terms(levels, cells, s, "group").groupBy("sample_id", "lr_index").agg(
        F.count(F.lit(1)).alias("active_edges"))
    nearest = minimum_distance(cells, s.radius, s.tile_limit).withColumn("min_distance", F.col("min_distance") * s.ratio)
    return counts.join(nearest, "sample_id").withColumn(
        "self_spatial_weight", 1.0 / (F.col("min_distance") * F.lit(s.scale_distance)))
