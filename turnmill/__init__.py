"""turnmill: transcript and retrieval-evaluation analytics as Spark DataFrame jobs."""
