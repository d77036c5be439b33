"""Training-data operators on Spark DataFrames (nothing else in the library imports this subpackage)."""
