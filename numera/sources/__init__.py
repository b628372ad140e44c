"""Readers of the tables, and series, matrices and graphs derived from them."""
