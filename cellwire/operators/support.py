"""Condition support of features: counts, classes, and stability under one section per patient."""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwire.operators.ranking import running
from cellwire.operators.session import materialize, spread

# Points of a characteristic function that one exchanged row stands for.
POINTS_PER_ROW = 4096

# The four exclusive classes, in their order.
CLASSES = [
    "pf_restricted",
    "control_restricted",
    "shared",
    "other",
]


def support_counts(scores: DataFrame, units: DataFrame, disease: str = "Disease", control: str = "Control") -> DataFrame:
    """Nonzero sections and patients with any / all sections nonzero, per feature and condition."""
    sizes = units.groupBy("patient_id").agg(F.first("condition").alias("condition"), F.count(F.lit(1)).alias("_n"))
    present = scores.where("score > 0").join(units.select("section_id", "patient_id"), "section_id").groupBy(
        "feature_id", "patient_id").agg(F.count(F.lit(1)).alias("_k")).join(sizes, "patient_id")
    columns = []
    for tag, c in (("pf", disease), ("control", control)):
        mine = F.col("condition") == c
        columns += [
            F.coalesce(F.sum(F.when(mine, F.col("_k"))), F.lit(0)).alias(f"{tag}_nonzero_sections"),
            F.count(F.when(mine, 1)).alias(f"{tag}_nonzero_patients"),
            F.count(F.when(mine & (F.col("_k") == F.col("_n")), 1)).alias(f"{tag}_all_sections_patients"),
        ]
    return present.groupBy("feature_id").agg(*columns)


def patient_totals(units: DataFrame, disease: str = "Disease", control: str = "Control") -> tuple[int, int]:
    """Number of patients per condition: two numbers."""
    per = units.groupBy("patient_id").agg(F.first("condition").alias("condition"))
    row = per.agg(F.count(F.when(F.col("condition") == disease, 1)), F.count(F.when(F.col("condition") == control, 1))).first()
    return row[0], row[1]


def single_section_patients(units: DataFrame) -> DataFrame:
    per = units.groupBy("patient_id").agg(F.first("condition").alias("condition"), F.count(F.lit(1)).alias("_n"))
    return per.groupBy("condition").agg(F.count(F.lit(1)).alias("patients"), F.count(F.when(F.col("_n") == 1, 1)).alias("single_section_patients"))


def minima(percent: int, npf: int, nc: int) -> tuple[int, int]:
    """Smallest patient numbers that reach the percentage, in integer arithmetic."""
    return (percent * npf + 99) // 100, (percent * nc + 99) // 100


def support_class(pf: Column, control: Column, percent: int, npf: int, nc: int) -> Column:
    pf_min, c_min = minima(percent, npf, nc)
    return (
        F.when((pf >= pf_min) & (control >= c_min), "shared").when((control >= c_min) & (pf == 0), "control_restricted")
        .when((pf >= pf_min) & (control == 0), "pf_restricted").otherwise("other")
    )


def classify_support(counts: DataFrame, percents: Sequence[int], npf: int, nc: int) -> DataFrame:
    """Class of every feature at every threshold, in long form."""
    spread = counts.select("feature_id", "pf_nonzero_patients", "control_nonzero_patients", F.explode(F.array(*[
        F.struct(F.lit(p).alias("threshold_percent"),
                 support_class(F.col("pf_nonzero_patients"), F.col("control_nonzero_patients"), p, npf, nc).alias("support_class"))
        for p in percents])).alias("_c"))
    return spread.select("feature_id", "_c.*")


def threshold_counts(classes: DataFrame) -> DataFrame:
    return classes.groupBy("threshold_percent", "support_class").agg(F.count(F.lit(1)).alias("features"))


def threshold_transitions(classes: DataFrame, main: int) -> DataFrame:
    """From the class at the main threshold to the class at every threshold."""
    base = classes.where(F.col("threshold_percent") == main).select("feature_id", F.col("support_class").alias("from_class"))
    return classes.join(base, "feature_id").groupBy(
        "from_class", F.col("threshold_percent").alias("to_threshold"), F.col("support_class").alias("to_class")
    ).agg(F.count(F.lit(1)).alias("features"))


# ---- one section per patient ------------------------------------------------------------------
def _numbered_sections(units: DataFrame) -> DataFrame:
    """Sections with their 0-based number inside the patient and the patient's section count.

    Numbered along a hash, whose first digits cut a patient with very many sections into parts.
    """
    hashed = units.select("patient_id", "section_id", "condition", F.md5(F.col("section_id").cast("string")).alias("_h")).withColumn(
        "_part", F.substring("_h", 1, 2))
    held = running(hashed, ["patient_id"], [F.col("_h"), F.col("section_id")], F.lit(1), "_i", "_part").drop("_h", "_part")
    sizes = units.groupBy("patient_id").agg(F.count(F.lit(1)).alias("_n"))
    return held.withColumn("_i", F.col("_i") - 1).join(sizes, "patient_id")


def random_choices(units: DataFrame, repetitions: int, seed: int = 1) -> DataFrame:
    """One section per patient for every repetition, drawn by a hash of repetition and patient."""
    sizes = units.groupBy("patient_id").agg(F.count(F.lit(1)).alias("_n"))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("choice").cast("string"), F.col("patient_id").cast("string")))
    drawn = sizes.withColumn("choice", F.explode(F.sequence(F.lit(1), F.lit(repetitions)))).withColumn(
        "_i", F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.col("_n")).drop("_n")
    return drawn.join(_numbered_sections(units).drop("_n"), ["patient_id", "_i"]).drop("_i")


def enumerate_choices(units: DataFrame, max_choices: int = 1_000_000) -> DataFrame:
    """Every choice of one section per patient, as a mixed-radix number; refused above the limit.

    Use ``exact_class_probabilities`` where there are too many: it needs no enumeration.
    """
    sizes = units.groupBy("patient_id").agg(F.count(F.lit(1)).alias("_n"))
    logs = sizes.agg(F.sum(F.log("_n")).alias("l"), F.product("_n").alias("p")).first()
    if logs["l"] > math.log(max_choices):
        raise ValueError("too many choices to enumerate")
    total = int(round(logs["p"]))
    several = running(sizes.where("_n > 1"), [], [F.col("patient_id")], F.log("_n"), "_l").withColumn(
        "_stride", F.round(F.exp(F.col("_l") - F.log("_n"))).cast("long"))
    strides = sizes.join(several.select("patient_id", "_stride"), "patient_id", "left").fillna(1, ["_stride"])
    chosen = strides.withColumn("choice", F.explode(F.sequence(F.lit(1), F.lit(total)))).withColumn(
        "_i", F.floor((F.col("choice") - 1) / F.col("_stride")) % F.col("_n")).drop("_n", "_stride")
    return chosen.join(_numbered_sections(units).drop("_n"), ["patient_id", "_i"]).drop("_i")


def choice_supports(scores: DataFrame, choices: DataFrame, disease: str = "Disease") -> DataFrame:
    """Nonzero patients per condition, choice and feature; pairs without any are absent."""
    present = scores.where("score > 0").select("section_id", "feature_id")
    case = F.col("condition") == disease
    return choices.join(present, "section_id").groupBy("choice", "feature_id").agg(
        F.count(F.when(case, 1)).alias("pf"), F.count(F.when(~case, 1)).alias("control"))


def choice_class_shares(
    supports: DataFrame, baseline: DataFrame, repetitions: int, percent: int, npf: int, nc: int
) -> DataFrame:
    """Class shares over the choices, retention of the baseline class, modal class and support range.

    A choice without any nonzero section counts as support (0, 0).
    """
    label = support_class(F.col("pf"), F.col("control"), percent, npf, nc)
    zero = support_class(F.lit(0), F.lit(0), percent, npf, nc)
    held = supports.withColumn("_c", label).groupBy("feature_id").agg(
        *[F.count(F.when(F.col("_c") == c, 1)).alias(f"n_{c}") for c in CLASSES], F.count(F.lit(1)).alias("_seen"),
        *[f(c).alias(f"{c}_{name}") for c in ("pf", "control") for name, f in (("min", F.min), ("max", F.max), ("sum", F.sum))])
    held = baseline.select("feature_id", "support_class").join(held, "feature_id", "left").fillna(0)
    unseen = F.lit(repetitions) - F.col("_seen")
    for c in CLASSES:
        held = held.withColumn(f"n_{c}", F.col(f"n_{c}") + F.when(zero == c, unseen).otherwise(0))
    top = F.greatest(*[F.col(f"n_{c}") for c in CLASSES])
    modal = F.coalesce(*[F.when(F.col(f"n_{c}") == top, c) for c in CLASSES])
    ties = sum(((F.col(f"n_{c}") == top).cast("int") for c in CLASSES), F.lit(0)) > 1
    own = F.coalesce(*[F.when(F.col("support_class") == c, F.col(f"n_{c}")) for c in CLASSES])
    ranges = []
    for c in ("pf", "control"):
        ranges += [F.when(unseen > 0, F.lit(0)).otherwise(F.col(f"{c}_min")).alias(f"{c}_min"), F.col(f"{c}_max"),
                   (F.col(f"{c}_sum") / float(repetitions)).alias(f"{c}_mean")]
    return held.select(
        "feature_id", "support_class", *[(F.col(f"n_{c}") / float(repetitions)).alias(f"p_{c}") for c in CLASSES],
        (own / float(repetitions)).alias("retention"), modal.alias("modal_class"), ties.alias("modal_tie"), *ranges)


def exact_class_probabilities(
    scores: DataFrame, units: DataFrame, percent: int, disease: str = "Disease", control: str = "Control"
) -> DataFrame:
    """Exact class probabilities under one random section per patient, without enumeration.

    The number of supporting patients is a sum of independent indicators. Its tail is taken from
    the characteristic function, which is a product over patients and hence a plain aggregate over
    the distinct patient probabilities with their counts.
    """
    npf, nc = patient_totals(units, disease, control)
    pf_min, c_min = minima(percent, npf, nc)
    sizes = units.groupBy("patient_id").agg(F.first("condition").alias("condition"), F.count(F.lit(1)).alias("_n"))
    present = scores.where("score > 0").join(units.select("section_id", "patient_id"), "section_id").groupBy(
        "feature_id", "patient_id").agg(F.count(F.lit(1)).alias("_k")).join(sizes, "patient_id")
    levels = present.groupBy("feature_id", "condition", (F.col("_k") / F.col("_n")).alias("p")).agg(F.count(F.lit(1)).alias("c"))
    totals = levels.groupBy("feature_id", "condition").agg(
        F.sum("c").alias("N"),
        F.when(F.max("p") >= 1, F.lit(0.0)).otherwise(F.exp(F.sum(F.col("c") * F.log1p(-F.least(F.col("p"), F.lit(1 - 1e-16)))))).alias("none"),
        F.collect_list(F.struct("p", "c")).alias("_levels"))
    totals = materialize(totals)
    # One row per stretch of points: each point carries its sums through the levels alone, and none is aggregated but in the tail.
    stretch = F.col("_part") * POINTS_PER_ROW
    parts = totals.select("feature_id", "condition", "N", "_levels", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("N") / POINTS_PER_ROW))).alias("_part"))
    points = spread(parts, "feature_id", "condition", "_part").select(
        "feature_id", "condition", "N", "_levels", F.explode(F.sequence(stretch, F.least(F.col("N"), stretch + POINTS_PER_ROW - 1))).alias("l"))
    angle = F.lit(2 * math.pi) * F.col("l") / (F.col("N") + 1)

    def size_of(total: Column, level: Column) -> Column:
        re, im = 1 - level["p"] + level["p"] * F.cos("_a"), level["p"] * F.sin("_a")
        norm = re * re + im * im
        return total + F.when(norm < 1e-28, F.lit(-1e6)).otherwise(level["c"] * F.lit(0.5) * F.log(norm))

    def turn_of(total: Column, level: Column) -> Column:
        return total + level["c"] * F.atan2(level["p"] * F.sin("_a"), 1 - level["p"] + level["p"] * F.cos("_a"))

    phi = points.withColumn("_a", angle).withColumns({
        "_m": F.aggregate("_levels", F.lit(0.0), size_of), "_t": F.aggregate("_levels", F.lit(0.0), turn_of)}).drop("_levels")
    least = F.when(F.col("condition") == disease, F.lit(pf_min)).otherwise(F.lit(c_min))
    # Sum of exp(-i a k) for k = t .. N in closed form, times the characteristic function.
    ar, ai = F.cos(F.col("_a") * least) - 1, -F.sin(F.col("_a") * least)
    br, bi = 1 - F.cos("_a"), F.sin("_a")
    scale = br * br + bi * bi
    gr, gi = (ar * br + ai * bi) / scale, (ai * br - ar * bi) / scale
    size = F.exp("_m")
    term = F.when(F.col("l") == 0, (F.col("N") - least + 1).cast("double")).otherwise(
        size * (F.cos("_t") * gr - F.sin("_t") * gi))
    tail = phi.groupBy("feature_id", "condition", "N").agg((F.sum(term) / (F.first("N") + 1)).alias("_tail")).withColumn(
        "tail", F.when(least <= 0, 1.0).when(least > F.col("N"), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_tail")))))
    both = tail.join(totals.drop("N", "_levels"), ["feature_id", "condition"])
    side = lambda name, cond, missing: F.coalesce(F.max(F.when(F.col("condition") == cond, F.col(name))), F.lit(missing))
    wide = both.groupBy("feature_id").agg(
        side("tail", disease, 0.0 if pf_min > 0 else 1.0).alias("pt"), side("none", disease, 1.0).alias("p0"),
        side("tail", control, 0.0 if c_min > 0 else 1.0).alias("ct"), side("none", control, 1.0).alias("c0"))
    out = wide.select("feature_id", (F.col("pt") * F.col("c0")).alias("p_pf_restricted"),
                      (F.col("ct") * F.col("p0")).alias("p_control_restricted"), (F.col("pt") * F.col("ct")).alias("p_shared"))
    return out.withColumn("p_other", 1 - F.col("p_pf_restricted") - F.col("p_control_restricted") - F.col("p_shared"))
