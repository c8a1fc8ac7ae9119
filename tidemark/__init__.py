"""Event-detection analytics and corpus operators on Spark DataFrames."""
