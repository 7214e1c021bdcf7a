"""Transit-delay analytics as Spark jobs."""
