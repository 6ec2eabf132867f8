"""Scalar column functions: built-in expressions alone, no Python workers."""
