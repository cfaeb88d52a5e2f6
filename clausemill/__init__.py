"""Clause retrieval, assessment analytics and corpus preparation on Spark DataFrames."""
