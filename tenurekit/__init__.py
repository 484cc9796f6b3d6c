"""Subscription-lifetime analytics as Spark jobs: DataFrames and parameters in, a DataFrame out."""
