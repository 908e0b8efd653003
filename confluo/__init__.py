"""confluo: a Spark-first engine for conversation streams and text corpora."""
