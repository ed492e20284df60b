"""Data quality, profiling and table governance operators for Spark DataFrames."""
