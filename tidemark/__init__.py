"""Tidemark: finding and following trends in social text with Spark DataFrames."""
