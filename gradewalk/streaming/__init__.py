"""streaming of the accessibility engine."""
