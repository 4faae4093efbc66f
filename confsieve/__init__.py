"""Configuration audit analytics on Spark DataFrames."""
