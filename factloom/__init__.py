"""Security-fact analytics on Spark: every relation is a DataFrame keyed by repository."""

__version__ = "0.1.0"
