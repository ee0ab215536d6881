"""Application-record analytics on Spark DataFrames."""
