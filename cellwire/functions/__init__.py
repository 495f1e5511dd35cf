"""Column expressions shared by the operators."""
from cellwire.functions.expressions import (  # noqa: F401
    barcode_suffix,
    feature_key,
    hash_order,
    hill,
    spatial_weight,
)
