"""tracewright: Spark operators for large collections of one-dimensional instrument signals."""
