"""Readers of rule files, and rules as DataFrames."""
