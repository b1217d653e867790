"""The analytics jobs. Each takes a DataFrame and column roles and returns a DataFrame."""
