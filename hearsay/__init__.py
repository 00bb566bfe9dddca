"""hearsay: public-opinion event analytics as plain Spark DataFrame jobs."""
