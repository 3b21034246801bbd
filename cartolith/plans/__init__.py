"""Plans of the geographic engine."""
