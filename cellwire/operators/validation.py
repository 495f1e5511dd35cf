"""Input checks as tables: a row of counts or booleans instead of an error per record."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwire.functions.expressions import barcode_suffix, feature_key

# Fixed format of grid barcodes: s_<size>um_<row>_<col>-<suffix>.
GRID_BARCODE = r"^s_([0-9]+)um_([0-9]+)_([0-9]+)-([0-9]+)$"


def require(checks: DataFrame, *columns: str) -> None:
    """Raise when a one-row checks table has a failed check (false or a non-zero count)."""
    row = checks.select(*columns).first().asDict()
    failed = [k for k, v in row.items() if v is False or (not isinstance(v, bool) and v not in (0, None))]
    if failed:
        raise ValueError("failed checks: " + ", ".join(failed))


def validate_labels(cells: DataFrame, levels: DataFrame, label: str = "group") -> DataFrame:
    """Missing labels and levels that no cell uses."""
    unused = levels.select(label).distinct().join(cells.select(label), label, "left_anti")
    return cells.agg(
        F.count(F.lit(1)).alias("cells"), F.count(F.when(F.col(label).isNull(), 1)).alias("missing_labels"),
        F.countDistinct(label).alias("groups"),
    ).withColumn("unused_levels", unused.agg(F.count(F.lit(1))).scalar())


def key_alignment(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that only one of two tables has."""
    l, r = left.select(*keys).distinct(), right.select(*keys).distinct()
    both = l.withColumn("_l", F.lit(1)).join(r.withColumn("_r", F.lit(1)), list(keys), "full")
    return both.agg(
        F.count("_l").alias("left_keys"), F.count("_r").alias("right_keys"),
        F.count(F.when(F.col("_r").isNull(), 1)).alias("left_only"),
        F.count(F.when(F.col("_l").isNull(), 1)).alias("right_only"),
    )


def validate_counts(counts: DataFrame, value: str = "n", keys: Sequence[str] = ("barcode", "feature_id")) -> DataFrame:
    """Counts must be finite, non-negative integers with unique (barcode, feature) names."""
    v = F.col(value).cast("double")
    bad = {
        "non_finite": v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")),
        "negative": v < 0,
        "non_integer": v != F.floor(v),
        "empty_names": F.greatest(*[
            (F.coalesce(F.length(F.col(k).cast("string")), F.lit(0)) == 0).cast("int") for k in keys]) == 1,
    }
    copies = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return counts.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count(F.when(c, 1)).alias(k) for k, c in bad.items()]
    ).withColumn("duplicate_keys", copies.agg(F.count(F.lit(1))).scalar())


def validate_positions(positions: DataFrame, bin_size: int) -> DataFrame:
    """Unique barcodes, unique grid places per suffix, and agreement with grid barcodes."""
    name = F.col("barcode").cast("string")
    held = positions.withColumn("_suffix", barcode_suffix(name))
    part = lambda i: F.regexp_extract(name, GRID_BARCODE, i).cast("long")
    known = name.rlike(GRID_BARCODE)
    places = held.groupBy("array_row", "array_col", "_suffix").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    names = positions.groupBy("barcode").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    size = lambda df: df.agg(F.count(F.lit(1))).scalar()
    return positions.agg(
        F.count(F.lit(1)).alias("positions"),
        F.count(F.when(F.col("barcode").isNull() | (name == ""), 1)).alias("missing_barcodes"),
        F.count(F.when(F.col("array_row").isNull() | F.col("array_col").isNull() | (F.col("array_row") < 0)
                       | (F.col("array_col") < 0), 1)).alias("bad_grid"),
        F.count(F.when(~F.coalesce(F.col("in_tissue").isin(0, 1), F.lit(False)), 1)).alias("bad_tissue"),
        F.count(F.when(known & (part(1) != bin_size), 1)).alias("size_mismatch"),
        F.count(F.when(known & ((part(2) != F.col("array_row")) | (part(3) != F.col("array_col"))), 1)).alias("grid_mismatch"),
    ).withColumn("duplicate_barcodes", size(names)).withColumn("duplicate_places", size(places))


def validate_records(records: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Score records: no missing names, finite non-negative scores, unique feature per sample."""
    names = ["sender_group", "receiver_group", "interaction_name"]
    p = F.col("probability")
    missing = F.greatest(*[F.col(c).isNull().cast("int") for c in names]) == 1
    keyed = records.withColumn("_key", feature_key(*names)).groupBy(sample, "_key").agg(F.count(F.lit(1)).alias("_n"))
    return records.agg(
        F.count(F.lit(1)).alias("records"), F.count(F.when(missing, 1)).alias("missing_names"),
        F.count(F.when(p.isNull() | F.isnan(p) | (F.abs(p) == float("inf")), 1)).alias("non_finite"),
        F.count(F.when(p < 0, 1)).alias("negative"),
    ).withColumn("duplicate_features", keyed.where("_n > 1").agg(F.count(F.lit(1))).scalar())


def varying_within(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Keys and columns whose value is not constant within the key."""
    spread = df.select(key, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("_c"))
    return spread.groupBy(key, F.col("_c.column").alias("column")).agg(
        F.countDistinct(F.coalesce(F.col("_c.value"), F.lit(""))).alias("distinct_values")).where("distinct_values > 1")
