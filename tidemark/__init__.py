"""tidemark: place-based evidence as Spark DataFrames."""

__version__ = "0.1.0"
