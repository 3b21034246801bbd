"""Sources of the geographic engine."""
