"""Bars and signals over streams."""
