"""starloom: astronomical frame and star-catalogue analytics on Spark DataFrames."""
