"""Column functions: every one is a Spark SQL expression, none runs Python per row."""
