"""Readers and writers of the file formats that the analyses exchange."""
from cellwire.sources.readers import (  # noqa: F401
    read_features,
    read_mex,
    read_positions,
    read_wide_counts,
)
from cellwire.sources.writers import (  # noqa: F401
    rebuild_zero_filled,
    write_mex,
    write_nonzero,
    write_records,
    write_wide_counts,
)
