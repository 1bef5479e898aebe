"""Business analytics on Spark DataFrames: profiling, metrics, trends, segments and simple models."""
