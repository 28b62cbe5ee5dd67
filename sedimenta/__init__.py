"""Evidence-to-graph analytics as plain Spark DataFrame jobs."""
