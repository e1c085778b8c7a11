"""Click-stream enrichment and page metrics on Spark DataFrames."""

from footfall.config import Settings

__all__ = ["Settings"]
