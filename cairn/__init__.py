"""A retrieval engine over Spark DataFrames."""
