"""Survey-geometry and training-data operators written for Spark DataFrames."""
