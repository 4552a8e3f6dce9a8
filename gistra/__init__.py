"""gistra: mergeable summaries and similarity operators as Spark DataFrame plans."""

__version__ = "0.1.0"
