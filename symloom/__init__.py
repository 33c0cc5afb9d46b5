"""Symbol-sequence alignment and profiling on Spark DataFrames."""
