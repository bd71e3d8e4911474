"""Media-library, subtitle and recognition analytics on Spark DataFrames."""
