"""Scalar expressions: every function takes and returns Columns and stays inside codegen."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def power(value: Column, exponent: float) -> Column:
    return value if exponent == 1 else F.pow(value, F.lit(float(exponent)))


def hill(product: Column, kh: float, n: float) -> Column:
    """Saturating response x^n / (Kh^n + x^n)."""
    raised = power(product, n)
    return raised / (F.lit(float(kh) ** n) + raised)


def spatial_weight(distance: Column, kind: str = "binary", scale: float | Column = 1.0) -> Column:
    """Edge weight as a function of distance: binary, gaussian or exponential decay."""
    scale = scale if isinstance(scale, Column) else F.lit(float(scale))
    if kind == "binary":
        return F.lit(1.0)
    if kind == "gaussian":
        return F.exp(-(distance * distance) / (F.lit(2.0) * scale * scale))
    if kind == "exponential":
        return F.exp(-distance / scale)
    raise ValueError(f"unsupported weight function: {kind}")


def feature_key(sender: str, receiver: str, interaction: str) -> Column:
    """Length-prefixed key, so that no separator inside a name can make two keys equal."""
    parts = []
    for name in (sender, receiver, interaction):
        parts += [F.length(name).cast("string"), F.col(name)]
    return F.concat_ws(":", *parts)


def barcode_suffix(barcode: Column) -> Column:
    """Trailing "-<digits>" part of a barcode; "1" where there is none."""
    found = F.regexp_extract(barcode, r"-([0-9]+)$", 1)
    return F.when(found == "", F.lit("1")).otherwise(found)


def hash_order(seed: int, *columns: Column) -> Column:
    """Reproducible pseudo-random sort key: md5 of the seed and the columns."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in columns]))
