"""tabforge — tabular profiling, preprocessing, model comparison and run-history
analytics expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
