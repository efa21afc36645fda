"""Column functions: rolling windows, exponential averages, statistics."""
