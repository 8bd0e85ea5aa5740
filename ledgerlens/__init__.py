"""Public-spending analytics on Spark DataFrames."""
