"""Point-in-time narrative analytics on Spark: sources, operators, plans, streaming."""

__version__ = "0.1.0"
