"""Column-level helpers and fixed value lists."""
