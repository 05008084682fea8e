"""Trade-journal analytics as Spark DataFrame jobs."""
