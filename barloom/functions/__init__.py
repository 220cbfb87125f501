"""Column functions and window helpers that the operators share."""
