"""Numerical analytics on Spark: DataFrame operators, functions, plans, streams and a small command language."""
