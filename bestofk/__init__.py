"""Best-of-K evaluation analytics on Spark DataFrames."""
