"""lexivec: hybrid retrieval and graph-trace analytics as PySpark DataFrame pipelines."""
