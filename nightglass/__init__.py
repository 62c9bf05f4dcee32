"""Analytics of astronomical image collections on Spark DataFrames."""
