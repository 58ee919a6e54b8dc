"""A query engine on Spark DataFrames."""
