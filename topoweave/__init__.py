"""Code-topology analytics on Spark DataFrames."""
