"""Variant-cohort analytics as lazy PySpark DataFrame operators."""
