"""millrace: a small, strictly typed query layer over Spark DataFrames."""

__version__ = "0.1.0"
