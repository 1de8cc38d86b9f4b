"""Market-share and share-shift analytics on Spark DataFrames."""

from sharetide.config import Settings

__all__ = ["Settings"]
