"""Learning-assessment analytics on Spark: DataFrames in, DataFrames out."""
