"""Spark-first engine for geographic and business feeds."""
