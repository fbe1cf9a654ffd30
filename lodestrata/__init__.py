"""Evidence retrieval analytics over many assets and many questions at once, as Spark DataFrame operations."""
