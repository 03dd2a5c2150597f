"""attestor: evidence analytics on Spark DataFrames."""
