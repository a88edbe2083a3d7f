"""Circuit and corpus analytics on Spark DataFrames."""
