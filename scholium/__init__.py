"""Bibliometric and training-data analytics as composable Spark operators."""
