"""Commerce product analytics on Spark DataFrames."""
