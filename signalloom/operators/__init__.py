"""Relational and per-stream operators."""
