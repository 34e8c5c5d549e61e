"""tickgraph: reactive time-series graphs compiled to Spark DataFrames."""

__version__ = "0.1.0"
