"""Lodestar: corpus, evaluation and relational analytics on Spark DataFrames."""
