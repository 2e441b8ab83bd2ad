"""Privacy-preserving analytics over text tables, on Spark DataFrames."""

__version__ = "0.1.0"
