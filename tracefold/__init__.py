"""Process conformance analytics on Spark DataFrames and Structured Streaming."""
