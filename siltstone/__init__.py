"""siltstone: a Spark-first engine for web-content analytics and retrieval."""
