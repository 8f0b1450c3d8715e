"""Historical-text analytics as Spark DataFrames."""
