"""Timeline and transcript analytics on Spark DataFrames."""
