"""Composite queries built from the operators, and the registered query catalogue."""
