"""Analytics and corpus processing on Spark DataFrames."""
