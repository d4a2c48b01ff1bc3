"""Plumbline: data validation for large tabular microdata, on Spark."""
