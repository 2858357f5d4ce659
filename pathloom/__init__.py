"""Property graphs to chat training data, expressed as Spark DataFrames."""
