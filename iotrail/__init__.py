"""Storage-I/O event analytics on Spark DataFrames."""
