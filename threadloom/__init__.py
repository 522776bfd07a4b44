"""Session-context analytics and corpus preparation as Spark jobs."""
