"""Time-versioned artifact graph and corpus operators on Spark DataFrames."""
