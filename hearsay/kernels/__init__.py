"""Encoders in plain Python, for what Catalyst's expressions can't say. Nothing here knows Spark."""
