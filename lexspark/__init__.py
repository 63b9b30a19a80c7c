"""Document analytics, retrieval evaluation and training-data operators on Spark DataFrames."""
