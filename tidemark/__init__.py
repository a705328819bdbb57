"""Point-in-time analytics on Spark DataFrames and Structured Streaming."""
