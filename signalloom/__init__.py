"""Ordered-signal analytics on PySpark: rows of float arrays keyed by stream and position."""
