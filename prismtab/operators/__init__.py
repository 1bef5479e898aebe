"""Analytics operators. Each takes a DataFrame and returns a DataFrame."""
