"""A retrieval-evaluation engine on Spark DataFrames."""
