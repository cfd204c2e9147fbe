"""cairn: exact vector search and text indexing on Spark DataFrames."""
