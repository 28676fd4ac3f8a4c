"""Fleet-state analytics over clusters of a replicated key-value store, on Spark DataFrames."""
