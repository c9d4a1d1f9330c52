"""Retrieval and analytics over document corpora as Spark DataFrame operators."""
