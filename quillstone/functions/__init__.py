"""Column expressions and the distributed helpers that the jobs share."""
