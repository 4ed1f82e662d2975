"""quillon: similarity search and retrieval operators over Spark DataFrames."""
