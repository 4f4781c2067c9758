"""waymark: trajectory-efficiency analytics on Spark DataFrames."""
