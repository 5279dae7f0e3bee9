"""Column functions: names, times, scores."""
