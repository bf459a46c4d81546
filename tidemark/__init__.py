"""Point-in-time forecast analytics on Spark DataFrames."""
