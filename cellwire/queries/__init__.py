"""Registered analyses over the given tables, each with the SQL that checks it."""
from cellwire.queries.registry import ORACLES, QUERIES  # noqa: F401
from cellwire.queries import (  # noqa: F401
    agreement_queries,
    cohort_queries,
    counts_queries,
    graph_queries,
    scoring_queries,
    testing_queries,
)
