"""Where plans start: generated numbers, rows in memory, typed empty tables, DataFrames and Parquet files."""

from millrace.sources.tables import custom, dataframe, empty, memory, numbers, parquet

__all__ = ["custom", "dataframe", "empty", "memory", "numbers", "parquet"]
