"""foliant: document-catalog analytics on Spark DataFrames."""
