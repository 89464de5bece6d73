"""Signal-block operators and training-text operators on Spark DataFrames."""
