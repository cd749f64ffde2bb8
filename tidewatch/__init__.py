"""Customer-retention analytics expressed as Spark DataFrame, ML and Structured Streaming jobs."""
