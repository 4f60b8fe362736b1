"""Trajectory analytics on PySpark: ordered-sequence, spatial and feature operators."""
