"""Functions of the geographic engine."""
