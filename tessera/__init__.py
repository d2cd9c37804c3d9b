"""Survey microdata analytics on Spark DataFrames."""
