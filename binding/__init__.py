"""Domain tables derived from the provided parquet tables, and their SQL twins."""
