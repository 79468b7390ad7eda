"""Training-data operators on Spark DataFrames.  Nothing else in the library imports this package."""
