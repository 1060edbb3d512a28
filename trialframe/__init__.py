"""Trial-recording analytics as Spark DataFrame programs."""
