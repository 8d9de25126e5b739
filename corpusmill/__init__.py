"""corpusmill: document, event and training-corpus analytics as Spark jobs."""
