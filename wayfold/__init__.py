"""wayfold: trajectory analytics on Spark DataFrames and Spark SQL."""
