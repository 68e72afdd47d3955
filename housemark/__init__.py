"""Price-paid pipeline, run log and run analytics as Spark DataFrame jobs."""
