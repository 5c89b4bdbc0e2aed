"""Spark jobs for three-way outcome prediction on fixture data."""
