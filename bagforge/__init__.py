"""Analytics over counted feature fingerprints, on Spark DataFrames."""
