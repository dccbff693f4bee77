"""Retrieval, corpus indexing and training-data preparation on PySpark."""
