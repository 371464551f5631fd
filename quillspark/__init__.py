"""Text-corpus cleaning, search, evaluation and reconciliation as Spark DataFrames."""

__version__ = "0.1.0"
