"""A document normaliser and text-pipeline engine on Spark DataFrames."""

__version__ = "0.1.0"
