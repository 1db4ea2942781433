"""pairmill: build and judge text-summarization corpora with Spark DataFrames."""

__version__ = "0.1.0"
