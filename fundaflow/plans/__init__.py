"""Compositions of operators: one call per run of the chain."""
