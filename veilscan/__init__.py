"""Personal-data discovery and corpus analytics on Spark DataFrames."""
