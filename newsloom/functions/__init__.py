"""Column functions: one for each deterministic kernel."""
