"""Event-camera analytics on Spark DataFrames."""
