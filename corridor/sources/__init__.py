"""Readers of the domain's files as DataFrames."""
