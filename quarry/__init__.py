"""Data mining and training-data operators on Spark DataFrames."""
