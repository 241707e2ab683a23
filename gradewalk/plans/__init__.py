"""plans of the accessibility engine."""
