"""Register fusion on Spark: cleaning, linking, deduplicating and fusing asset registers."""

__version__ = "0.1.0"
