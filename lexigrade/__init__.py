"""Reading difficulty of technical prose at corpus scale, on Spark DataFrames."""
