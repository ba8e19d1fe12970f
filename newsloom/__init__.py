"""Text and trend analytics on Spark DataFrames."""
