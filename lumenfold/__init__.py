"""Adaptive numerical integration and the analytics around it, on PySpark DataFrames."""
