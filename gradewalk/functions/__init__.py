"""functions of the accessibility engine."""
