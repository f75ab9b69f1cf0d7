"""Four-dimensional scanning electron microscopy data as Spark DataFrames."""
