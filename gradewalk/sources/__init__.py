"""sources of the accessibility engine."""
