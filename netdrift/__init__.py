"""Time-varying connectedness and training-data jobs on Spark DataFrames."""
