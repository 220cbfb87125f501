"""Operators for training-data pipelines over text tables (see the README for the list)."""
