"""Column expressions; every one is made of built-in Spark functions."""
