"""Operators on DataFrames that encoders lead to."""
