"""textloom: text measurement and data preparation on Spark DataFrames."""
