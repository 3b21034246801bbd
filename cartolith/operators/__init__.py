"""Operators of the geographic engine."""
