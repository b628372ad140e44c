"""Column functions, and aggregates as columns."""
