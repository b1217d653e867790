"""Table analytics as Spark jobs: profiling, cleaning, sales, clinical and model jobs."""
