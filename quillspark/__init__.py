"""Full-text search and ranking on Spark DataFrames."""
