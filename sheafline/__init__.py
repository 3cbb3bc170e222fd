"""Document-intelligence analytics as Spark DataFrame jobs."""
