"""DataFrame operators. Each takes and returns DataFrames and builds a lazy plan unless stated."""
