"""Phonetic matching for Spark DataFrames."""
