"""Streaming of the geographic engine."""
