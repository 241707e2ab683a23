"""operators of the accessibility engine."""
