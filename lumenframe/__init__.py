"""Dataframe queries and code-corpus table jobs on Spark."""
