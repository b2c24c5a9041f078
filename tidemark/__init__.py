"""Anchored-event cohorts, labels, features and dataset checks on PySpark."""
