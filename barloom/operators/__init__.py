"""Operators over bars: DataFrame in, DataFrame out."""
