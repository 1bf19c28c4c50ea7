"""The registered query catalogue: Spark callables and their SQL."""
