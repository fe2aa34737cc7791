"""Chronoloom: time-ordered record analytics as lazy PySpark plans."""
