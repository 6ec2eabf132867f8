"""Streaming forms of event operators."""
