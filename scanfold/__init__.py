"""Code-compliance analytics on Spark DataFrames."""
